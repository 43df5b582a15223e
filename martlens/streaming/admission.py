"""Streaming admission (T-01) with per-user state.

Each micro-batch is grouped by user; the group function sorts the user's new
events by time, drops events older than the last one already decided for that
user (late arrivals, reason ``late``), and runs the same admission rule as the
batch job with the user's admitted timestamps of the last day as state. The
state holds at most ``per_day`` timestamps per user and expires with the
event-time watermark once a user has been idle for a day. Arrivals behind the
watermark (one day) never reach the operator: Spark drops them, so a decision
is never revised by data that comes too late.
"""

from __future__ import annotations

import os
import uuid
from collections import deque
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from martlens.plans.logs import SECONDS_PER_DAY, US, admit_sequence, epoch_us
from martlens.session import ensure_checkpoint_dir

OUTPUT_SCHEMA = "event_id long, user_id long, admitted boolean, reason string, retry_after long"
STATE_SCHEMA = "hits array<long>, last_us long"


def _admit_group(per_minute: int, per_day: int):
    def fn(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits, last = (deque(state.get[0] or []), state.get[1]) if state.exists else (deque(), None)
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["__us", "event_id"], kind="stable")
        late = pdf["__us"] < last if last is not None else pd.Series(False, index=pdf.index)
        on_time = pdf[~late]
        res = admit_sequence(on_time["__us"].tolist(), per_minute, per_day, hits)
        out = pd.DataFrame({"event_id": on_time["event_id"].values, "user_id": on_time["user_id"].values,
                            "admitted": [r[0] for r in res], "reason": [r[1] for r in res],
                            "retry_after": [r[2] for r in res]})
        dropped = pdf[late]
        if len(dropped):
            out = pd.concat([out, pd.DataFrame({"event_id": dropped["event_id"].values,
                                                "user_id": dropped["user_id"].values, "admitted": False,
                                                "reason": "late", "retry_after": 0})], ignore_index=True)
        out = out.astype({"event_id": "int64", "user_id": "int64", "admitted": "bool", "reason": "object",
                          "retry_after": "int64"})
        newest = int(on_time["__us"].max()) if len(on_time) else last
        keep = [h for h in hits if newest is None or newest - h <= SECONDS_PER_DAY * US]
        state.update((keep, newest))
        if newest is not None:
            state.setTimeoutTimestamp(newest // 1000 + SECONDS_PER_DAY * 1000)
        yield out
    return fn


def admission_stream(stream: DataFrame, per_minute: int, per_day: int) -> DataFrame:
    """Streaming DataFrame of admission decisions from a stream of events."""
    ev = stream.select("event_id", "user_id", epoch_us("ts").alias("__us")).withColumn(
        "ts", F.timestamp_micros("__us"))
    return (ev.withWatermark("ts", "1 day").groupBy("user_id")
            .applyInPandasWithState(_admit_group(per_minute, per_day), OUTPUT_SCHEMA, STATE_SCHEMA, "append",
                                    GroupStateTimeout.EventTimeTimeout))


def run_in_slices(spark: SparkSession, events: DataFrame, per_minute: int, per_day: int, slices: int = 3,
                  root: str | None = None) -> DataFrame:
    """Feed the events as ``slices`` time-ordered deliveries to one streaming query.

    Each delivery is written to the source folder and processed to completion
    with an ``availableNow`` trigger against the same checkpoint, so the
    per-user state carries over from one delivery to the next. Returns the
    decisions read back from the Parquet sink.
    """
    root = root or os.path.join(ensure_checkpoint_dir(spark), f"admission-{uuid.uuid4().hex[:10]}")
    src, sink, ckpt = (os.path.join(root, d) for d in ("source", "sink", "checkpoint"))
    bounds = events.agg(F.min(epoch_us("ts")).alias("lo"), F.max(epoch_us("ts")).alias("hi")).first()
    lo, hi = bounds["lo"], bounds["hi"]
    step = (hi - lo) // slices + 1
    schema = events.schema
    for k in range(slices):
        part = events.filter((epoch_us("ts") >= lo + k * step) & (epoch_us("ts") < lo + (k + 1) * step))
        part.write.mode("append").parquet(os.path.join(src, f"delivery={k:04d}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        q = (admission_stream(stream, per_minute, per_day).writeStream.format("parquet")
             .option("path", sink).option("checkpointLocation", ckpt).outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(OUTPUT_SCHEMA).parquet(sink)
