"""Named queries over the driver's tables, each with the SQL that gives the same rows.

Modules register queries with :func:`query`; importing this package collects
them all in QUERIES and SQL.
"""

from . import aggregates, composites, functions, graphs, joins, ranking, scans, streams, windows  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
