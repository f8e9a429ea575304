"""Aggregation helpers: keyed combination, extremes by value, global top-k, sums, fixed-size samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMBINERS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def keyed_combine(df: DataFrame, key: str, value: str, combiner: str | Callable[[Column], Column] = "sum", name: str = "value") -> DataFrame:
    """(key, name): values of a key combined; Spark pre-aggregates on the sending side."""
    fn = COMBINERS[combiner] if isinstance(combiner, str) else combiner
    return df.groupBy(key).agg(fn(F.col(value)).alias(name))


def arg_extreme(df: DataFrame, key: str, value: str, largest: bool = True) -> DataFrame:
    """One row (key, value): the row of largest (smallest) value; ties go to the smaller key; no rows give nulls."""
    order = F.struct(F.col(value), -F.col(key)) if largest else F.struct(F.col(value), F.col(key))
    pick = F.max_by if largest else F.min_by
    return df.where(F.col(value).isNotNull()).agg(pick(F.col(key), order).alias(key), (F.max if largest else F.min)(F.col(value)).alias(value))


def global_top(df: DataFrame, key: str, value: str, k: int, largest: bool = True) -> DataFrame:
    """The k rows of largest (smallest) value over all; ties go to the smaller key."""
    return df.select(key, value).orderBy(F.desc(value) if largest else F.asc(value), key).limit(k)


def sum_count(df: DataFrame, value: str) -> DataFrame:
    """One row (sum_value, n)."""
    return df.agg(F.sum(value).alias("sum_value"), F.count(F.lit(1)).alias("n"))


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, chosen by integer arithmetic on the key: the same rows in every run."""
    order = F.expr(f"pmod(`{key}` * 1103515245 + {12345 + seed * 7919}, 2147483648)")
    return df.orderBy(order, key).limit(n)
