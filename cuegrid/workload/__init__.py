"""Registered queries over the driver tables, with their check SQL."""

from importlib import import_module

MODULES = ("tables", "scalars", "sequences", "overlaps", "catalogue", "reconcile", "quality", "regions", "sources", "streams")


def load():
    """(queries, check SQL) after importing every query module."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    from cuegrid.workload.registry import CHECKS, QUERIES
    return QUERIES, CHECKS
