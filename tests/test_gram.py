"""Pairwise correlations of many columns against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import prep
from tidemark.plans.gram import pair_corr


def table(n, width, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width)) + 1e4
    base[:, 1] = base[:, 0] * 2 + rng.normal(size=n) * 1e-3
    base[:, 2] = 7.1
    frame = pd.DataFrame(base, columns=[f"f{k}" for k in range(width)])
    return frame.mask(pd.DataFrame(rng.random((n, width)) < 0.1, columns=frame.columns))


def test_pairs_equal_pandas_with_gaps(spark):
    pdf = table(700, 12)
    pdf["empty"] = np.nan
    got = {(r["i"], r["j"]): r["corr"] for r in pair_corr(spark.createDataFrame(pdf).replace(float("nan"), None).repartition(5), list(pdf.columns)).collect()}
    want = pdf.drop(columns="f2").corr()
    for (i, j), r in got.items():
        a, b = pdf.columns[i], pdf.columns[j]
        if "f2" in (a, b) or "empty" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-9)
    assert {(i, j) for i in range(12) for j in range(i)} <= set(got)
    empty = spark.createDataFrame(pdf.head(3)).limit(0)
    assert pair_corr(empty, ["f0", "f1"]).count() == 0


def test_five_hundred_features_in_one_job(spark):
    pdf = table(300, 500)
    names = list(pdf.columns)
    long = spark.createDataFrame([([None if np.isnan(v) else float(v) for v in row],) for row in pdf.to_numpy()], "x array<double>")
    df = long.select(*[F.col("x")[k].alias(n) for k, n in enumerate(names)])
    assert [(r["i"], r["j"]) for r in pair_corr(df, names).filter(F.abs("corr") > 0.95).collect()] == [(1, 0)]


def test_selection_over_many_features(spark):
    pdf = table(200, 40)
    names = list(pdf.columns)
    pdf["target"] = pdf["f0"].fillna(0) + 1.0
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    out = {r["feature"]: r for r in prep.select_features(df, names, "target", k=20).collect()}
    assert len(out) == 40 and out["f1"]["reason"] == "correlated" and out["f2"]["reason"] == "variance"
    assert sum(r["selected"] for r in out.values()) == 20
    assert prep.validate_features(df, names).first()["correlated_pairs"] == "f0~f1"


def test_profile_of_one_feature_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "a double, t double")
    r = prep.feature_profile(df, ["a"], "t").first()
    assert r["target_corr"] == -1.0 and r["earlier"] == []
    assert prep.feature_profile(df.limit(0), ["a"], None).first()["variance"] is None
