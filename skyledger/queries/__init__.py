"""Registered queries, each with the SQL text it is checked against."""

from importlib import import_module

_MODULES = (
    "layers", "positions", "spatial", "tracks", "visibility", "ledger", "storage", "checks",
    "streams",
)


def registry():
    """All registered queries by name."""
    from skyledger.queries import base

    for module in _MODULES:
        import_module(f"skyledger.queries.{module}")
    return base.REGISTRY
