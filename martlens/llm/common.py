"""Shared pieces of the text operators: intermediate tables and columns.

Intermediate results are Parquet tables below the session's ``spark.checkpoint.dir``
(one folder per application), so a lost executor never costs more than the stage
that was running, and no lineage grows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.session import app_key, ensure_checkpoint_dir


def folder(spark: SparkSession, what: str) -> str:
    """A new folder name in the shared folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{app_key(spark)}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back."""
    path = folder(df.sparkSession, what)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def most_frequent(counts: DataFrame, n: str, bound: int) -> DataFrame:
    """The rows of the largest counts in column n, at most ``bound`` of them: those above a count
    that a histogram over sixteenths of powers of two gives, so no sorted lists reach the driver."""
    step = F.floor(16 * F.log2(F.col(n))).cast("int")
    bins = sorted(((r.step, r.rows) for r in counts.where(F.col(n) > 0).groupBy(step.alias("step"))
                   .agg(F.count("*").alias("rows")).collect()), reverse=True)
    least, total = None, 0
    for at, rows in bins:
        total += rows
        if total > bound:
            break
        least = at
    return counts.where((F.col(n) > 0) & (step >= least)) if least is not None else counts.limit(0)


def crc_fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in fold 0 as the text ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Rows of the facts that ``join_by_count`` may broadcast: no more can each have this share of all rows.
HOT_SHARE = 4096
_HOT_ROWS = 1000


def join_by_count(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of rows with facts that has one row per key. ``count`` says in how many of the ``total``
    rows a key occurs, so at most HOT_SHARE keys can have a HOT_SHARE-th of them: those are broadcast,
    and every other key is small enough for one task of a shuffle join. Keys must not be null."""
    hot = F.col(count) >= max(_HOT_ROWS, -(-total // HOT_SHARE))
    few = F.broadcast(facts.where(hot).drop(count))
    return rows.join(few, key).unionByName(
        rows.join(few.select(key), key, "left_anti").join(facts.where(~hot).drop(count), key))
