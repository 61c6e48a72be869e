"""All registered queries with their SQL."""

from foliant.plans import landed, scalars, streams, tables, texts  # noqa: F401
from foliant.plans._registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
