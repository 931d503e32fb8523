"""Query catalogue; importing the package registers every family."""

from importlib import import_module

from tracelode.queries.registry import ORACLES, QUERIES

FAMILIES = (
    "sequences",
    "alignment",
    "payloads",
    "matching",
    "detection",
    "inference",
    "views",
    "recovery",
    "periods_and_windows",
    "models",
    "scenarios",
)

for _family in FAMILIES:
    import_module(f"tracelode.queries.{_family}")

__all__ = ["ORACLES", "QUERIES"]
