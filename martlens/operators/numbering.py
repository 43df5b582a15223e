"""Numbers 1, 2, 3 ... over a whole ordered table without one task that sees all of it.

Rows are range-partitioned by the order and sorted inside their partition, so a row's number
is its place in its partition plus the rows of all partitions before. Places and partitions
are written with the rows (a table in the shared folder), so the counts that give the offsets
and the rows they are added to are the same ones, also after a lost executor.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlens.session import app_key, ensure_checkpoint_dir

_PLACE_BITS = 33  # monotonically_increasing_id: the partition above, the row of the partition below


def stored(df: DataFrame, what: str) -> DataFrame:
    """df as written to a fresh table of the session's shared folder and read again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{app_key(spark)}/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def numbered(df: DataFrame, order: Sequence[Column], name: str = "n") -> DataFrame:
    """Input columns plus ``name``, the row's number (long, from 1) in the given order.

    Rows equal in the whole order get different numbers, in no particular order; name a
    unique last column where that matters. An input column called ``name`` is replaced;
    an empty table stays empty.
    """
    rows = df.drop(name, "_part", "_place").withColumn("_tie", F.monotonically_increasing_id())
    keys = [*order, F.col("_tie")]
    placed = stored(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))), "numbered")
    # one row per partition: the only global window
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part").rowsBetween(
        Window.unboundedPreceding, 0)) - F.col("_size")).alias("_before"))
    return placed.join(F.broadcast(before), "_part") \
        .withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Input columns plus inclusive running sums (long) of the given columns over the whole ordered table.

    Every range partition sums on its own, and one row per partition carries what the partitions before
    it hold: a prefix sum that no key, however large, brings into one task. Columns of the
    same names are replaced; nulls count as 0; equal rows are in no particular order.
    """
    names = list(sums)
    rows = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in {*names, "_part", "_place"}),
                     *(F.coalesce(c, F.lit(0)).cast("long").alias(f"_v_{n}") for n, c in sums.items()))
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*order, F.col("_tie")]
    placed = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
                    .withColumn("_part", F.spark_partition_id())
                    .withColumn("_place", F.monotonically_increasing_id()), "running")
    here = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    parts = placed.groupBy("_part").agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)  # one row per partition
    before = parts.select("_part", *((F.sum(f"_s_{n}").over(upto) - F.col(f"_s_{n}")).alias(f"_b_{n}") for n in names))
    out = placed.join(F.broadcast(before), "_part").withColumns(
        {n: F.col(f"_b_{n}") + F.sum(f"_v_{n}").over(here) for n in names})
    return out.drop("_part", "_place", *(f"{p}{n}" for n in names for p in ("_v_", "_b_")))
