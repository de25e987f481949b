"""All queries: importing this module registers them."""

from importlib import import_module

from tessera.plans.base import QUERIES, SQL

for _name in ("scans", "relations", "profiles", "statistics", "similar", "runs"):
    import_module(f"tessera.plans.{_name}")

__all__ = ["QUERIES", "SQL"]
