"""The library's queries and the SQL that states what each computes."""

from tripweave.plans import files, relational, structure  # noqa: F401
from tripweave.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
