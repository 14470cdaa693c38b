"""Queries over the driver tables; importing this package registers all of them."""

from merchlens.plans import catalog_queries, enrich_queries, score_queries, trend_queries  # noqa: F401
from merchlens.plans.registry import ORACLE, QUERIES  # noqa: F401
