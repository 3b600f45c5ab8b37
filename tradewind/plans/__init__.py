"""Registered queries, grouped by the kind of work they do."""

from importlib import import_module

MODULES = ["flagship", "scans", "cleaning", "joins", "aggregates", "windows", "sets", "resampling", "features", "models", "selection", "verification", "streams"]


def load_all() -> None:
    for m in MODULES:
        import_module(f"{__name__}.{m}")
