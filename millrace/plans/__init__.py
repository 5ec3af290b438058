"""Named queries over the shared tables, each with SQL that gives the same rows where SQL can say it."""

from millrace.plans import analytics, models, monitoring  # noqa: F401
from millrace.plans.views import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
