"""Set operations (U-01 ... U-04)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_same_signature(a: DataFrame, b: DataFrame, tag: str | None = None) -> DataFrame:
    """Concatenate two results whose column sets are equal (U-01); refuses otherwise."""
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError(f"column sets differ: {sorted(a.columns)} vs {sorted(b.columns)}")
    if tag:
        a, b = a.withColumn(tag, F.lit("a")), b.withColumn(tag, F.lit("b"))
    return a.unionByName(b)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """UNION (U-02)."""
    return a.unionByName(b).distinct()


def difference(observed: DataFrame, allowed: DataFrame, cols: list[str]) -> DataFrame:
    """Observed values not in the allowed set (U-03), NULL-safe via a left anti join."""
    cond = None
    for c in cols:
        e = observed[c].eqNullSafe(allowed[c])
        cond = e if cond is None else cond & e
    return observed.select(*cols).distinct().join(allowed.select(*cols).distinct(), cond, "left_anti")


def set_equality(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Two-way anti joins: counts only in a, only in b, and whether the sets are equal (U-04)."""
    only_a = difference(a, b, cols).agg(F.count(F.lit(1)).alias("only_left"))
    only_b = difference(b, a, cols).agg(F.count(F.lit(1)).alias("only_right"))
    return only_a.crossJoin(only_b).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))
