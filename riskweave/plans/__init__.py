"""All registered queries."""

from riskweave.plans import (assoc_queries, model_queries, profile_queries,  # noqa: F401
                             score_queries, source_queries)
from riskweave.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
