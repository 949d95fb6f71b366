"""All core queries and their SQL."""

from lodestone.plans import facts, programs  # noqa: F401 (they register their queries)
from lodestone.plans.bindings import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
