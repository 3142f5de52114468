"""All registered queries, one module per part of the inventory."""

from importlib import import_module

MODULES = ["features", "candidates", "joins", "projections", "windows", "policies", "learning", "streams", "monitoring", "storage"]


def load():
    """Import every query module and return the two registries."""
    for module in MODULES:
        import_module(f"recloom.queries.{module}")
    from recloom.queries.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
