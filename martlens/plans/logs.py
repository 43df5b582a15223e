"""Keyed time-state over event logs, as batch jobs (W-07, T-01, T-02, T-03).

Timestamps are handled as microseconds since the epoch computed from the
zone-less timestamp (no session time zone involved).

* W-07 trailing counts: differences of one running count over all events and
  window begins, which is cut into ranges of rows, never by key or day.
* T-01 admission: each decision depends on the earlier *admitted* events, so
  a key is inherently sequential. Rows are hash-partitioned by key and sorted
  within partitions; a per-partition iterator (Arrow batches) carries only the
  current key's admitted timestamps of the last day (at most ``per_day``), so
  memory stays bounded however large a key is and no group is materialised.
* T-02 breaker: islands between successes and the failures in them are numbered
  by running counts over ranges of rows; the open time is the failure whose
  count is threshold - 1 above the first one of its island.
* T-03 run rollup: sums and counts per run, providers ordered by first use
  from a (run, provider) first-seen aggregate.
"""

from __future__ import annotations

from collections import deque
from datetime import datetime
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlens.operators.joins import broadcast_if_small
from martlens.operators.numbering import running

SECONDS_PER_MINUTE = 60
SECONDS_PER_DAY = 86_400
US = 1_000_000
EPOCH = datetime(1970, 1, 1)


def epoch_us(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), col.cast("timestamp_ntz"))


# --- W-07 ----------------------------------------------------------------------------------
def trailing_counts(events: DataFrame, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Trailing 60 s and 86 400 s counts per event, window edges and events of the same instant included (W-07).

    Counted by ranks: the events up to an instant less those before the window's begin, both read off one
    running count over all (key, instant) rows and window begins. That order is cut into ranges of
    equal size, so a key with most of the events in one day or minute is spread like any other.
    """
    windows = {"n_last_minute": SECONDS_PER_MINUTE * US, "n_last_day": SECONDS_PER_DAY * US}
    base = events.select("event_id", F.col(key), ts, epoch_us(ts).alias("__us"))
    at = base.groupBy(key, "__us").agg(F.count(F.lit(1)).alias("__n"))
    # an instant counts its events; a window's begin asks for those before it, so it comes first
    marks = F.array(F.struct(F.col("__us").alias("at"), F.lit("own").alias("asks"), F.col("__n").alias("n")),
                    *(F.struct((F.col("__us") - w).alias("at"), F.lit(name).alias("asks"), F.lit(0).cast("long").alias("n"))
                      for name, w in windows.items()))
    rows = at.select(key, "__us", F.explode(marks).alias("__m")).select(key, "__us", "__m.*")
    counted = running(rows, [F.col(key), F.col("at"), F.col("asks") == "own"], {"__c": F.col("n")})
    per = counted.groupBy(key, "__us").agg(*(F.max(F.when(F.col("asks") == x, F.col("__c"))).alias(f"__{x}")
                                             for x in ("own", *windows)))
    per = per.select(F.col(key).alias("__k"), F.col("__us").alias("__t"),
                     *((F.col("__own") - F.col(f"__{x}")).alias(x) for x in windows))
    return base.join(per, F.col(key).eqNullSafe(F.col("__k")) & F.col("__us").eqNullSafe(F.col("__t"))) \
        .select("event_id", key, ts, *windows)


# --- T-01 ----------------------------------------------------------------------------------
ADMISSION_SCHEMA = "event_id long, user_id long, ts timestamp_ntz, admitted boolean, reason string, retry_after long"


def admit_sequence(ts_us: list[int], per_minute: int, per_day: int,
                   hits: deque | None = None) -> list[tuple[bool, str, int]]:
    """Sliding-window admission for one key's time-ordered events (pure function).

    ``hits`` holds admitted timestamps (microseconds) and is updated in place,
    which is what lets the streaming operator carry it as state.
    """
    hits = deque() if hits is None else hits
    out = []
    for now in ts_us:
        while hits and now - hits[0] > SECONDS_PER_DAY * US:
            hits.popleft()
        recent = [h for h in hits if now - h <= SECONDS_PER_MINUTE * US]
        if len(recent) >= per_minute:
            retry = max(1, int(SECONDS_PER_MINUTE - (now - recent[0]) / US) + 1)
            out.append((False, "per_minute", retry))
        elif len(hits) >= per_day:
            retry = max(1, int(SECONDS_PER_DAY - (now - hits[0]) / US) + 1)
            out.append((False, "per_day", retry))
        else:
            hits.append(now)
            out.append((True, "admitted", 0))
    return out


def _admission_partition(per_minute: int, per_day: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, hits = None, deque()
        for pdf in batches:
            if pdf.empty:
                continue
            adm, why, retry = [], [], []
            for user, group in pdf.groupby("user_id", sort=False):
                if user != current:
                    current, hits = user, deque()
                res = admit_sequence(group["__us"].tolist(), per_minute, per_day, hits)
                adm += [r[0] for r in res]
                why += [r[1] for r in res]
                retry += [r[2] for r in res]
            order = pdf.groupby("user_id", sort=False).ngroup().argsort(kind="stable")
            ordered = pdf.iloc[order]
            yield pd.DataFrame({"event_id": ordered["event_id"].values, "user_id": ordered["user_id"].values,
                                "ts": ordered["ts"].values, "admitted": adm, "reason": why,
                                "retry_after": retry})
    return run


def admission(events: DataFrame, per_minute: int, per_day: int, partitions: int | None = None) -> DataFrame:
    """Admission decision per event (T-01, batch)."""
    spark = events.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    prepared = (events.select("event_id", "user_id", "ts", epoch_us("ts").alias("__us"))
                .repartition(n, "user_id").sortWithinPartitions("user_id", "__us", "event_id"))
    return prepared.mapInPandas(_admission_partition(per_minute, per_day), ADMISSION_SCHEMA)


# --- T-02 ----------------------------------------------------------------------------------
def breaker_intervals(outcomes: DataFrame, threshold: int = 2, cooldown_s: int = 120) -> DataFrame:
    """Open intervals of a consecutive-failure breaker per provider (T-02).

    ``outcomes(provider, ts, seq, success)``; ``seq`` breaks ties in time. Running counts of successes and
    failures over all outcomes, ordered by provider and time, are merged from ranges of rows, whatever
    their size. The successes so far number the islands of failures; the first failure of an island has
    its least failure count f, so the one that opens the breaker is the failure with count f + threshold - 1
    of the same island, one equi-join for any threshold.
    """
    o = outcomes.select("provider", "seq", "success", epoch_us("ts").alias("us"))
    won = F.col("success").cast("long")
    counted = running(o, [F.col("provider"), F.col("us"), F.col("seq")], {"_s": won, "_f": 1 - won})
    base = counted.groupBy("provider").agg(F.min(F.col("_s") - won).alias("_before"))  # successes of other providers
    fails = counted.where(~F.col("success")).select("provider", "_s", "_f", "us")
    first = fails.groupBy("provider", "_s").agg(F.min("_f").alias("_first"))
    opened = first.select("provider", "_s", (F.col("_first") + threshold - 1).alias("_f")).join(fails, ["provider", "_s", "_f"])
    return opened.join(broadcast_if_small(base), "provider").select(
        "provider", (F.col("_s") - F.col("_before")).alias("island"), F.col("us").alias("open_start_us"),
        (F.col("us") + cooldown_s * US).alias("open_end_us"))


# --- T-03 ----------------------------------------------------------------------------------
def run_rollup(steps: DataFrame) -> DataFrame:
    """Per run: total tokens (NULL as 0), providers by first use, steps, failed steps (T-03).

    ``steps(run_id, ts, seq, provider, tokens, failed)``.
    """
    totals = steps.groupBy("run_id").agg(
        F.sum(F.coalesce(F.col("tokens"), F.lit(0))).cast("long").alias("total_tokens"),
        F.count(F.lit(1)).alias("steps"), F.count(F.when(F.col("failed"), 1)).alias("failed_steps"))
    first = (steps.filter(F.col("provider").isNotNull()).groupBy("run_id", "provider")
             .agg(F.min(F.struct(epoch_us("ts"), F.col("seq"))).alias("_f")))
    order = first.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("_f", "provider"))).alias("_p"))
    providers = order.select("run_id", F.array_join(F.transform("_p", lambda s: s["provider"]), ",")
                             .alias("providers_used"))
    return totals.join(providers, "run_id", "left").withColumn(
        "providers_used", F.coalesce("providers_used", F.lit("")))
