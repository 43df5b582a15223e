"""Registered event-log queries (W-07, T-01, T-02, T-03) over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from martlens.plans import logs as L
from martlens.registry import register

PER_MINUTE, PER_DAY = 1, 5
MIN_US, DAY_US = L.SECONDS_PER_MINUTE * L.US, L.SECONDS_PER_DAY * L.US


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@register("w07_trailing_counts", f"""
SELECT event_id, user_id,
  COUNT(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {MIN_US} PRECEDING AND CURRENT ROW)
    AS n_last_minute,
  COUNT(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {DAY_US} PRECEDING AND CURRENT ROW)
    AS n_last_day
FROM events""")
def w07_trailing_counts(star, spark, sf_dir):
    """Events of the same user in the trailing minute and day, per event (W-07)."""
    return L.trailing_counts(_events(spark, sf_dir)).select("event_id", "user_id", "n_last_minute", "n_last_day")


ADMISSION_SQL = f"""
WITH RECURSIVE ev AS (
  SELECT event_id, user_id, epoch_us(ts) AS us,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events),
steps(user_id, rn, event_id, admitted, reason, retry_after, hits) AS (
  SELECT user_id, 0, NULL::BIGINT, NULL::BOOLEAN, NULL::VARCHAR, NULL::BIGINT, []::BIGINT[]
  FROM (SELECT DISTINCT user_id FROM ev) u
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id, d.adm, d.why, d.retry,
         CASE WHEN d.adm THEN list_append(d.live, e.us) ELSE d.live END
  FROM steps s JOIN ev e ON e.user_id = s.user_id AND e.rn = s.rn + 1,
  LATERAL (
    SELECT live, recent,
      CASE WHEN len(recent) >= {PER_MINUTE} THEN FALSE WHEN len(live) >= {PER_DAY} THEN FALSE ELSE TRUE END AS adm,
      CASE WHEN len(recent) >= {PER_MINUTE} THEN 'per_minute' WHEN len(live) >= {PER_DAY} THEN 'per_day'
           ELSE 'admitted' END AS why,
      CASE WHEN len(recent) >= {PER_MINUTE}
             THEN greatest(1, CAST(trunc({L.SECONDS_PER_MINUTE} - (e.us - recent[1]) / {L.US}) AS BIGINT) + 1)
           WHEN len(live) >= {PER_DAY}
             THEN greatest(1, CAST(trunc({L.SECONDS_PER_DAY} - (e.us - live[1]) / {L.US}) AS BIGINT) + 1)
           ELSE 0 END AS retry
    FROM (SELECT live, list_filter(live, lambda h: e.us - h <= {MIN_US}) AS recent
          FROM (SELECT list_filter(s.hits, lambda h: e.us - h <= {DAY_US}) AS live) a) b) d)
SELECT event_id, user_id, admitted, reason, retry_after FROM steps WHERE rn > 0"""


@register("t01_admission", ADMISSION_SQL)
def t01_admission(star, spark, sf_dir):
    """Sliding-window admission per user (1/minute, 5/day); rejected events do not count (T-01)."""
    return L.admission(_events(spark, sf_dir), PER_MINUTE, PER_DAY).select(
        "event_id", "user_id", "admitted", "reason", "retry_after")


@register("t01_admission_summary", f"""
SELECT user_id, COUNT(*) AS events, COUNT(CASE WHEN admitted THEN 1 END) AS admitted,
       COUNT(CASE WHEN reason = 'per_minute' THEN 1 END) AS rejected_minute,
       COUNT(CASE WHEN reason = 'per_day' THEN 1 END) AS rejected_day
FROM ({ADMISSION_SQL.replace('WITH RECURSIVE', 'WITH RECURSIVE', 1)}) a GROUP BY user_id""")
def t01_admission_summary(star, spark, sf_dir):
    """Admitted and rejected events per user (T-01)."""
    a = L.admission(_events(spark, sf_dir), PER_MINUTE, PER_DAY)
    return a.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("admitted"), 1)).alias("admitted"),
                                    F.count(F.when(F.col("reason") == "per_minute", 1)).alias("rejected_minute"),
                                    F.count(F.when(F.col("reason") == "per_day", 1)).alias("rejected_day"))


def outcomes(spark, sf_dir):
    """Provider outcome log derived from events: provider by user, failure = error event."""
    e = _events(spark, sf_dir)
    return e.select(F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("provider"), "ts",
                    F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("success"))


@register("t02_breaker_intervals", f"""
WITH o AS (SELECT 'p' || CAST(user_id % 4 AS VARCHAR) AS provider, epoch_us(ts) AS us, event_id AS seq,
                  event_type <> 'error' AS success FROM events),
i AS (SELECT *, SUM(CAST(success AS BIGINT)) OVER (PARTITION BY provider ORDER BY us, seq
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM o),
f AS (SELECT *, row_number() OVER (PARTITION BY provider, island ORDER BY us, seq) AS k FROM i WHERE NOT success)
SELECT provider, CAST(island AS BIGINT) AS island, us AS open_start_us, us + {120 * L.US} AS open_end_us FROM f WHERE k = 2""")
def t02_breaker_intervals(star, spark, sf_dir):
    """Breaker open intervals: opens at the 2nd consecutive failure for 120 s, reset only by success (T-02)."""
    return L.breaker_intervals(outcomes(spark, sf_dir), threshold=2, cooldown_s=120)


def steps(spark, sf_dir):
    """Run log derived from events: a run is a user-day; tokens from value (NULL for views)."""
    e = _events(spark, sf_dir)
    day = F.floor(L.epoch_us("ts") / L.US / L.SECONDS_PER_DAY).cast("long")
    return e.select((F.col("user_id") * 100000 + day).alias("run_id"), "ts", F.col("event_id").alias("seq"),
                    F.col("event_type").alias("provider"),
                    F.when(F.col("event_type") != "view", F.floor(F.col("value") * 100).cast("long")).alias("tokens"),
                    (F.col("event_type") == "error").alias("failed"))


T03_SQL = f"""
WITH s AS (SELECT user_id * 100000 + CAST(floor(epoch_us(ts) / {L.US} / {L.SECONDS_PER_DAY}) AS BIGINT) AS run_id,
                  epoch_us(ts) AS us, event_id AS seq, event_type AS provider,
                  CASE WHEN event_type <> 'view' THEN CAST(floor(value * 100) AS BIGINT) END AS tokens,
                  event_type = 'error' AS failed FROM events),
t AS (SELECT run_id, CAST(SUM(COALESCE(tokens, 0)) AS BIGINT) AS total_tokens, COUNT(*) AS steps,
             COUNT(CASE WHEN failed THEN 1 END) AS failed_steps FROM s GROUP BY run_id),
fp AS (SELECT run_id, provider, MIN((us, seq)) AS f FROM s WHERE provider IS NOT NULL GROUP BY run_id, provider),
p AS (SELECT run_id, string_agg(provider, ',' ORDER BY f) AS providers_used FROM fp GROUP BY run_id)
SELECT t.run_id, t.total_tokens, t.steps, t.failed_steps, COALESCE(p.providers_used, '') AS providers_used
FROM t LEFT JOIN p ON t.run_id = p.run_id"""


@register("t03_run_rollup", T03_SQL)
def t03_run_rollup(star, spark, sf_dir):
    """Per run: total tokens, providers in first-use order, steps, failed steps (T-03)."""
    return L.run_rollup(steps(spark, sf_dir))


@register("t01_admission_streaming", ADMISSION_SQL)
def t01_admission_streaming(star, spark, sf_dir):
    """T-01 as a stateful stream fed in two time-ordered deliveries; equals the batch decisions."""
    from martlens.streaming.admission import run_in_slices
    return run_in_slices(spark, _events(spark, sf_dir), PER_MINUTE, PER_DAY, slices=2)


@register("t03_run_rollup_streaming", T03_SQL)
def t03_run_rollup_streaming(star, spark, sf_dir):
    """T-03 as a watermarked one-day event-time window per user, processed as a stream."""
    from martlens.streaming.rollup import run_once
    e = _events(spark, sf_dir)
    return run_once(spark, sf_dir, e.schema, glob="events.parquet").select(
        "run_id", "total_tokens", "steps", "failed_steps", "providers_used")
