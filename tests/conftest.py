import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
# Python workers of a local session find the package as the driver does
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    return local_session("tests")


@pytest.fixture(scope="session")
def tables(spark):
    from tidemark.sources.tables import Tables

    return Tables(spark, SF)


@pytest.fixture(scope="session")
def bars(spark, tables):
    """The weekly bars, written once."""
    from tidemark.sources.storage import stage

    return stage(tables.bars_w, "test_bars")


def rows(df, *keys):
    """Rows as sorted tuples, doubles to 8 significant places."""
    def norm(v):
        if isinstance(v, float):
            return float(f"{v:.9g}") + 0.0
        return v

    columns = sorted(df.columns)
    out = [tuple(norm(r[c]) for c in columns) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
