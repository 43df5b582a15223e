"""Streaming operators agree with their batch counterparts when events arrive in order."""
from martlens.plans import logs as L
from martlens.streaming.admission import run_in_slices
from martlens.streaming.rollup import run_once

from .conftest import SF


def test_streaming_admission_equals_batch(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    batch = {(r.event_id, r.admitted, r.reason) for r in L.admission(ev, 1, 5).collect()}
    stream = {(r.event_id, r.admitted, r.reason) for r in run_in_slices(spark, ev, 1, 5, slices=4).collect()}
    assert stream == batch


def test_streaming_rollup_equals_batch(spark):
    from martlens.queries.logs import steps
    ev = spark.read.parquet(f"{SF}/events.parquet")
    batch = {tuple(r) for r in L.run_rollup(steps(spark, SF)).select(
        "run_id", "total_tokens", "steps", "failed_steps", "providers_used").collect()}
    stream = {tuple(r) for r in run_once(spark, SF, ev.schema, glob="events.parquet").select(
        "run_id", "total_tokens", "steps", "failed_steps", "providers_used").collect()}
    assert stream == batch


def test_late_delivery_is_marked_late_not_readmitted(spark):
    """Arrivals older than a user's last decision but within the watermark are reported as late;
    arrivals behind the watermark are dropped by Spark before the stateful operator."""
    import os
    import tempfile

    from pyspark.sql import functions as F

    from martlens.streaming.admission import OUTPUT_SCHEMA, admission_stream

    ev = spark.read.parquet(f"{SF}/events.parquet")
    us = F.expr("unix_micros(cast(ts as timestamp))")
    cut = ev.agg(F.expr("percentile_approx(unix_micros(cast(ts as timestamp)), 0.5)")).first()[0]
    half_day = 12 * 3600 * 1_000_000
    first = ev.filter((us >= cut) & (us < cut + half_day))            # arrives first
    within = ev.filter((us >= cut - half_day) & (us < cut))           # older, but within the 1-day watermark
    behind = ev.filter(us < cut - 3 * 2 * half_day)                   # far behind the watermark
    root = tempfile.mkdtemp(prefix="late-")
    src, sink, ckpt = (os.path.join(root, d) for d in ("src", "sink", "ckpt"))
    for k, part in enumerate((first, within, behind)):
        part.write.mode("append").parquet(os.path.join(src, f"d={k}"))
        stream = spark.readStream.schema(ev.schema).option("recursiveFileLookup", "true").parquet(src)
        q = (admission_stream(stream, 1, 5).writeStream.format("parquet").option("path", sink)
             .option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    out = spark.read.schema(OUTPUT_SCHEMA).parquet(sink)
    assert out.select("event_id").distinct().count() == out.count()
    late_rows = out.filter(F.col("reason") == "late")
    assert late_rows.count() > 0 and late_rows.filter(F.col("admitted")).count() == 0
    behind_ids = {r.event_id for r in behind.select("event_id").collect()}
    assert behind_ids and not behind_ids & {r.event_id for r in out.select("event_id").collect()}
    assert out.count() == first.count() + within.count()
