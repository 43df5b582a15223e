"""Exact distinct counts that merge (A-31, A-37).

Ids are numbered densely once; the numbers of a group and month become bitmaps of 32,768 bits each
(4 KB), stored as a table. A distinct count over any set of months or groups is then an OR of stored
bitmaps and a count of bits, without the facts: COUNT(DISTINCT ...) of each part cannot be added, bitmaps can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.operators.numbering import numbered, stored


def dense_ids(values: DataFrame, column: str) -> DataFrame:
    """(column, dense_id): every distinct non-null value with a number from 1; a table."""
    return numbered(values.select(column).where(F.col(column).isNotNull()).distinct(), [F.col(column)], "dense_id")


def distinct_bitmaps(facts: DataFrame, groups: list[str], column: str, ids: DataFrame) -> DataFrame:
    """(groups, bucket, bitmap): the dense ids met in every group; a table. Null ids are not counted.

    Pairs are made distinct before the bitmaps are built, so a group that holds a large share of
    the facts brings each of its ids once, and its bitmaps are dealt by bucket.
    """
    met = facts.where(F.col(column).isNotNull()).select(*groups, column).distinct().join(ids, column)
    bits = met.groupBy(*groups, F.bitmap_bucket_number("dense_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("dense_id")).alias("bitmap"))
    return stored(bits, "distinct-bitmaps")


def distinct_over(bitmaps: DataFrame, groups: list[str | Column], name: str) -> DataFrame:
    """(groups, name): the distinct count of the union of all bitmaps of each group."""
    merged = bitmaps.groupBy(*groups, "bucket").agg(F.bitmap_or_agg("bitmap").alias("_b"))
    keys = [c for c in merged.columns if c not in ("bucket", "_b")]
    return merged.groupBy(*keys).agg(F.sum(F.bitmap_count("_b")).cast("long").alias(name))
