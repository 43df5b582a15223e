"""Sorts, limits and top-k (L-01 ... L-06).

Global top-k uses ``orderBy(...).limit(k)``, which Spark plans as
TakeOrderedAndProject: each partition keeps its own k best rows and only those
reach the final merge, so no full sort or single-task shuffle happens.

Per-group top-k on possibly huge groups is done in two levels: rows are first
ranked inside (group, salt) buckets, each bucket keeps its k best, and the
survivors (at most ``salt_buckets * k`` per group) are ranked again per group.
The result is exact (a row in the group's top k is in its bucket's top k) and
no task ever holds a whole hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Top-k by measure with a deterministic tiebreak already in ``order`` (L-01/L-02)."""
    return df.orderBy(*order).limit(k)


def row_cap(df: DataFrame, n: int) -> DataFrame:
    """Row cap (L-04)."""
    return df.limit(n)


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    rank_col: str = "rank_in_group", salt_buckets: int = 64,
                    salt_on: list[str] | None = None) -> DataFrame:
    """Exact per-group top-k with a salted first level (L-05)."""
    salt_src = salt_on or [c for c in df.columns if c not in group_cols]
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*salt_src), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group_cols, "__salt").orderBy(*order)
    level1 = salted.withColumn("__r1", F.row_number().over(w1)).filter(F.col("__r1") <= k)
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return (level1.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k)
            .drop("__salt", "__r1"))


def first_k_categories(df: DataFrame, key: str, order_col: str, k: int) -> DataFrame:
    """The first k distinct keys by first appearance (L-06), as a small frame.

    First appearance = minimum of ``order_col`` per key (one aggregation), then
    a global top-k over the distinct keys.
    """
    firsts = df.groupBy(key).agg(F.min(order_col).alias("__first"))
    return firsts.orderBy("__first", key).limit(k).withColumn(
        "series_rank", F.row_number().over(Window.orderBy("__first", key)).cast("long")).drop("__first")
