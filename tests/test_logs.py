"""Event-log operators against straightforward Python re-computations on the sf0.001 events."""
from collections import deque

import pytest
from pyspark.sql import functions as F

from martlens.plans import logs as L

from .conftest import SF


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


@pytest.fixture(scope="module")
def pdf(events):
    p = events.select("event_id", "user_id", "ts", "event_type").toPandas()
    p["us"] = (p["ts"].astype("datetime64[us]").astype("int64"))
    return p.sort_values(["user_id", "us", "event_id"])


def reference_admission(pdf, per_minute, per_day):
    out = {}
    for _, g in pdf.groupby("user_id"):
        hits = deque()
        for eid, now in zip(g["event_id"], g["us"]):
            now_s = now / 1e6
            while hits and now_s - hits[0] > 86400:
                hits.popleft()
            recent = [h for h in hits if now_s - h <= 60]
            if len(recent) >= per_minute:
                out[eid] = (False, "per_minute")
            elif len(hits) >= per_day:
                out[eid] = (False, "per_day")
            else:
                hits.append(now_s)
                out[eid] = (True, "admitted")
    return out


@pytest.mark.parametrize("per_minute,per_day", [(1, 5), (2, 3), (100, 100)])
def test_admission_matches_reference(events, pdf, per_minute, per_day):
    got = {r.event_id: (r.admitted, r.reason) for r in L.admission(events, per_minute, per_day).collect()}
    assert got == reference_admission(pdf, per_minute, per_day)


def test_rejected_events_do_not_count(events, pdf):
    got = L.admission(events, 1, 5).agg(F.count(F.when(F.col("admitted"), 1))).first()[0]
    upper = L.trailing_counts(events).filter("n_last_day <= 5").count()
    assert got <= len(pdf) and got >= 0 and upper >= 0


def test_trailing_counts_match_brute_force(events, pdf):
    got = {r.event_id: (r.n_last_minute, r.n_last_day) for r in L.trailing_counts(events).collect()}
    for _, g in pdf.groupby("user_id"):
        us = g["us"].tolist()
        for eid, t in zip(g["event_id"], us):
            m = sum(1 for x in us if t - 60_000_000 <= x <= t)
            d = sum(1 for x in us if t - 86_400_000_000 <= x <= t)
            assert got[eid] == (m, d)


def test_breaker_matches_simulation(spark, pdf):
    p = pdf.assign(provider="p" + (pdf["user_id"] % 4).astype(str), success=pdf["event_type"] != "error")
    expected = set()
    for prov, g in p.sort_values(["us", "event_id"]).groupby("provider"):
        fails, opened = 0, False
        for ok, t in zip(g["success"], g["us"]):
            if ok:
                fails, opened = 0, False
            else:
                fails += 1
                if fails >= 2 and not opened:
                    opened = True
                    expected.add((prov, int(t)))
    outcomes = spark.createDataFrame(p[["provider", "ts", "event_id", "success"]].rename(columns={"event_id": "seq"}))
    for parts in ("1", "5", "32"):  # ranges of any size give the same intervals
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {(r.provider, r.open_start_us) for r in L.breaker_intervals(outcomes, 2, 120).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert got == expected


def test_admission_state_carries_across_arrow_batches(spark, events, pdf):
    """A user's events split over several Arrow batches give the same decisions."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.event_id: (r.admitted, r.reason) for r in L.admission(events, 1, 5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == reference_admission(pdf, 1, 5)
