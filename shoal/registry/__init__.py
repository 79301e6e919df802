"""All registered queries; importing the modules registers them."""

from shoal.registry import building, embedding, exact, files, fusing, scoring, splitting  # noqa: F401
from shoal.registry.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
