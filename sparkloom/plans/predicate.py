"""Where clauses: JSON filters compiled to column expressions."""

from __future__ import annotations

import sys
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = sys.float_info.epsilon


class FilterError(ValueError):
    """A where clause that has no meaning."""


def _kind(df: DataFrame, key: str) -> str | None:
    return dict(df.dtypes).get(key)


def _equals(df: DataFrame, key: str, value) -> Column:
    """A missing column, a null and a value of another type match nothing: 3 is not '3', and true is not 1."""
    kind = _kind(df, key)
    if isinstance(value, bool):
        return F.coalesce(F.col(f"`{key}`") == F.lit(value), F.lit(False)) if kind == "boolean" else F.lit(False)
    if isinstance(value, str):
        return F.coalesce(F.col(f"`{key}`") == F.lit(value), F.lit(False)) if kind == "string" else F.lit(False)
    if isinstance(value, int):
        return F.coalesce(F.col(f"`{key}`") == F.lit(value), F.lit(False)) if kind in ("tinyint", "smallint", "int", "bigint") else F.lit(False)
    if isinstance(value, float):
        number = kind in ("float", "double", "tinyint", "smallint", "int", "bigint") or bool(kind) and kind.startswith("decimal")
        return F.coalesce(F.col(f"`{key}`").cast("double").between(value - EPSILON, value + EPSILON), F.lit(False)) if number else F.lit(False)
    raise FilterError(f"a value of type {type(value).__name__} can't be matched: {key}")


def _all(parts: list[Column]) -> Column:
    return reduce(and_, parts) if parts else F.lit(True)


def compile_filter(df: DataFrame, where) -> Column:
    """`$and` goes before `$or`, and both before plain keys, which are then ignored; an empty clause matches everything."""
    if not isinstance(where, dict):
        raise FilterError("a where clause is an object")
    for op, how in (("$and", and_), ("$or", or_)):
        if op in where:
            if not isinstance(where[op], list) or not all(isinstance(x, dict) for x in where[op]):
                raise FilterError(f"{op} takes a list of objects")
            parts = [compile_filter(df, x) for x in where[op]]
            return reduce(how, parts) if parts else F.lit(True)
    return _all([_equals(df, k, v) for k, v in where.items()])


def filtered(df: DataFrame, where=None) -> DataFrame:
    """No clause, no filter."""
    return df if where is None or where == {} else df.where(compile_filter(df, where))


def but_not(condition: Column, excluded: Column) -> Column:
    """Rows of the condition, without those of which the other is known to hold."""
    return condition & ~F.coalesce(excluded, F.lit(False))
