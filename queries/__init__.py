"""Registered queries and the SQL each one is checked against."""

from queries import (
    aggregates,
    charts,
    cleaning,
    columns,
    encoding,
    flagship,
    joins,
    ml,
    ordering,
    profiling,
    scalars,
    tests_stats,
)
from queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
