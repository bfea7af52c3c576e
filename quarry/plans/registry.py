"""All queries of the engine's own operators."""

from quarry.plans import catalog
from quarry.plans.queries import ORACLES, QUERIES

assert catalog.__name__  # it adds its own to them

__all__ = ["ORACLES", "QUERIES"]
