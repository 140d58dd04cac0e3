"""Import every catalog module once."""

from importlib import import_module

MODULES = ["fixture_sql", "breadth", "indicators", "scalars", "signals", "evaluation", "prep", "runlog", "storage"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"tidemark.catalog.{name}")
