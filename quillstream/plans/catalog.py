"""All queries of the library by name, with the SQL that says what they return."""

from . import composite, relational, scalars, scans  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
