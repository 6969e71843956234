"""Named queries over the test tables."""

from sift.plans import quality, search_queries
from sift.plans.search_queries import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]

QUERIES: dict = {**quality.QUERIES, **search_queries.QUERIES}
ORACLES: dict = {**quality.ORACLES, **search_queries.ORACLES}
