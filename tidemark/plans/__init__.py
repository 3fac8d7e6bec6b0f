"""All queries and their SQL, by name."""

from tidemark.plans import analytics, feeds, scalar, tables  # noqa: F401  each adds its queries
from tidemark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
