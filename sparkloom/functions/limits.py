"""Limits of queries and tools, as plain numbers and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_limit(n: int | None) -> int:
    """H2: 10 unless given, 1 to 100."""
    return min(max(10 if n is None else n, 1), 100)


def overfetch(limit: int) -> int:
    """H3: candidates a result."""
    return next((k for top, k in ((10, 5), (25, 4), (50, 3)) if limit <= top), 2)


def prefetch(n: int) -> int:
    """H4: entries of each ranked list."""
    return max(1, n) * 4


def effective_limit(requested: int | None, tool_max: int | None) -> int:
    """H5."""
    return min(requested if requested and requested > 0 else 5, tool_max if tool_max and tool_max > 0 else 5)


def max_chunk_limit(n: int | None) -> int:
    """H6: 5 unless given, 1 to 50."""
    return min(max(5 if n is None else n, 1), 50)


def limit_column(n: Column) -> Column:
    return F.least(F.greatest(F.coalesce(n, F.lit(10)), F.lit(1)), F.lit(100))


def overfetch_column(limit: Column) -> Column:
    return F.when(limit <= 10, 5).when(limit <= 25, 4).when(limit <= 50, 3).otherwise(2)


def effective_limit_column(requested: Column, tool_max: Column) -> Column:
    five = F.lit(5)
    return F.least(F.when(requested > 0, requested).otherwise(five), F.when(tool_max > 0, tool_max).otherwise(five))
