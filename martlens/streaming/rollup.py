"""Streaming run-log rollup (T-03): per user-day run, tokens, steps, failures, providers by first use.

All measures add up, so no state is kept: every micro-batch is rolled up to
(user, day, provider) rows and written under its batch id, a retried batch
replacing its own rows. Reading sums the batches. An event counts however late
it arrives, and nothing waits for a watermark.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.plans.logs import SECONDS_PER_DAY, US, epoch_us
from martlens.session import ensure_checkpoint_dir


def per_provider(events: DataFrame) -> DataFrame:
    """(run, provider) totals of a batch of events."""
    ev = events.select("user_id", "event_id", "event_type", "value", epoch_us("ts").alias("__us"))
    tokens = F.when(F.col("event_type") != "view", F.floor(F.col("value") * 100).cast("long"))
    day_no = F.floor(F.col("__us") / US / SECONDS_PER_DAY).cast("long")
    return (ev.groupBy((F.col("user_id") * 100000 + day_no).alias("run_id"), F.col("event_type").alias("provider"))
            .agg(F.sum(F.coalesce(tokens, F.lit(0))).cast("long").alias("tokens"),
                 F.count(F.lit(1)).alias("steps"),
                 F.count(F.when(F.col("event_type") == "error", 1)).alias("failed_steps"),
                 F.min(F.struct("__us", "event_id")).alias("first_use")))


def rollup_runs(per_provider: DataFrame) -> DataFrame:
    """Run totals from (run, provider) rows; providers ordered by first use (bounded per run)."""
    return per_provider.groupBy("run_id").agg(
        F.sum("tokens").cast("long").alias("total_tokens"), F.sum("steps").alias("steps"),
        F.sum("failed_steps").alias("failed_steps"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_use", "provider"))),
                                 lambda s: s["provider"]), ",").alias("providers_used"))


def run_once(spark: SparkSession, source_dir: str, schema, root: str | None = None,
             glob: str | None = None) -> DataFrame:
    """Process everything in ``source_dir`` once (availableNow) and read the rolled-up runs back."""
    root = root or os.path.join(ensure_checkpoint_dir(spark), f"rollup-{uuid.uuid4().hex[:10]}")
    sink, ckpt = os.path.join(root, "sink"), os.path.join(root, "checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        per_provider(batch).write.mode("overwrite").parquet(os.path.join(sink, f"batch_id={batch_id}"))

    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    q = (reader.parquet(source_dir).writeStream.foreachBatch(write).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    parts = spark.read.parquet(sink)
    return rollup_runs(parts.groupBy("run_id", "provider").agg(
        *(F.sum(c).cast("long").alias(c) for c in ("tokens", "steps", "failed_steps")),
        F.min("first_use").alias("first_use")))
