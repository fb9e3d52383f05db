"""Named queries, one per operator, grouped by topic."""

from importlib import import_module

MODULES = ("cleaning", "along", "contacts", "potential", "domains", "secondary", "checks", "files", "flagship")


def load() -> tuple[dict, dict]:
    """Import all topics and return (queries, SQL twins)."""
    from foldframe.catalog.base import ORACLES, QUERIES

    for m in MODULES:
        import_module(f"foldframe.catalog.{m}")
    return QUERIES, ORACLES
