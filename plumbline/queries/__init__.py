"""Every operator applied to whole driver tables, with its SQL."""

from importlib import import_module

from plumbline.registry import ORACLES, QUERIES

for _name in ("attacks", "audit", "blueprints", "coupling", "decorated", "discovery", "dynamics", "fidelity", "flagship", "floors", "generation", "jointly", "lint", "networks", "noise", "privacy", "profiles", "related", "relational", "relations", "shaped", "sources", "streams", "tails", "typing"):
    import_module(f"plumbline.queries.{_name}")

__all__ = ["ORACLES", "QUERIES"]
