"""Numbering, running sums, spread and tolerance joins, and mergeable distinct counts against plain Python."""
import random

import pytest
from pyspark.sql import functions as F

from martlens.operators import compare as D
from martlens.operators import distinct as X
from martlens.operators import joins as J
from martlens.operators import numbering as N


def test_numbers_follow_the_order_with_ties_and_nulls(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.randint(0, 5)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    got = sorted(((x.n, x.k, x.v) for x in N.numbered(df, [F.desc("v"), F.asc_nulls_last("k")]).collect()), key=lambda x: x[0])
    assert [x[0] for x in got] == list(range(1, 501))
    assert [(k, v) for _, k, v in got] == sorted(rows, key=lambda x: (-x[1], x[0] is None, x[0] or ""))
    assert N.numbered(df.limit(0), [F.col("v")]).count() == 0


@pytest.mark.parametrize("parts", ["1", "6"])
def test_running_sums(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [(i, (i * 7) % 5 if i % 11 else None) for i in range(300)]
        got = N.running(spark.createDataFrame(rows, "i int, v int").repartition(4), [F.col("i")],
                        {"s": F.col("v"), "c": F.lit(1)}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    total, want = 0, []
    for i, v in rows:
        total += v or 0
        want.append((i, total, i + 1))
    assert sorted((x.i, x.s, x.c) for x in got) == want


def test_spread_join_deals_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT_BUCKET", 10)
    many = [(0, i) for i in range(95)] + [(1, 1), (2, 2), (None, 3)]
    few = [(0, "x"), (0, "y"), (1, "z"), (3, "w"), (None, "n")]
    got = J.spread_join(spark.createDataFrame(many, "k int, v int"), spark.createDataFrame(few, "k int, w string"), ["k"]).collect()
    assert sorted((r.k, r.v, r.w) for r in got) == sorted((k, v, w) for k, v in many for j, w in few if k == j and k is not None)


def test_tolerance_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT_BUCKET", 25)
    r = random.Random(4)
    scales = (1.0, 1000.0)
    figs = [(i, r.choice(["a", "b"]), r.choice([r.uniform(-300, 300), r.uniform(-2e6, 2e6), 50.0, 49.5, 0.0, -50.5])) for i in range(120)]
    vals = [(i, r.choice(["a", "b"]), f * r.choice(scales) * r.uniform(0.985, 1.015) + r.uniform(-0.6, 0.6))
            for i, (_, _, f) in enumerate(figs * 3)] + [(1000 + i, "a", 1000.0) for i in range(90)]
    figs += [(200, "a", 1000.0), (201, "a", 1.0), (202, "a", None)]
    got = J.tolerance_join(spark.createDataFrame(figs, "f int, k string, x double"),
                           spark.createDataFrame(vals, "v_id int, k string, v double"), "k", "x", "v", scales)
    near = lambda x, v: abs(x - v) <= max(abs(v) * 0.01, 0.5)
    want = sorted((f, i, s) for f, k, x in figs if x is not None for s in scales for i, j, v in vals if k == j and near(x * s, v))
    assert len(want) > 300
    assert sorted((r.f, r.v_id, r.scale) for r in got.collect()) == want


def test_buckets_never_fall(spark):
    r = random.Random(1)
    xs = sorted([r.uniform(-1e5, 1e5) for _ in range(500)] + [0.0, 50.0, -50.0, 49.999, 50.001, 0.5, -0.5])
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", J.tolerance_bucket(F.col("x"), 0.01, 0.5).alias("b"))
    b = [x.b for x in df.orderBy("x").collect()]
    assert b == sorted(b) and len(set(b)) > 100


def test_runs_that_hold_are_reversed_broken_or_tied(spark):
    ranking = spark.createDataFrame([(f"S{i}", i // 2) for i in range(40)], "store string, pos int")  # ties in pairs
    placed = N.numbered(ranking, [F.col("pos"), F.col("store")], "place")
    order = [r.store for r in placed.orderBy("place").collect()]
    runs = {0: order[3:8], 1: order[9:14][::-1], 2: order[3:5] + order[6:8], 3: [order[5], order[4], order[6]],
            4: order[:1], 5: order[38:] + ["none"], 6: ["none"], 7: order}
    df = spark.createDataFrame([(k, i, x) for k, v in runs.items() for i, x in enumerate(v)], "run_id int, at int, label string")
    got = {r.run_id: (r.contains_run, r.forward, r.reversed) for r in D.contains_runs(placed, "store", "place", df).collect()}
    assert got == {0: (True, True, False), 1: (True, False, True), 2: (False, False, False), 3: (False, False, False),
                   4: (True, True, True), 5: (False, False, False), 6: (False, False, False), 7: (True, True, False)}


def test_bitmaps_merge_to_distinct_counts(spark):
    r = random.Random(6)
    rows = [(r.choice("abc"), r.choice("xyz"), r.choice([None, *range(0, 100_000, 7)])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, m string, id long")
    ids = X.dense_ids(df, "id")
    assert ids.agg(F.max("dense_id")).first()[0] == len({i for *_, i in rows if i is not None}) == ids.count()
    bits = X.distinct_bitmaps(df, ["g", "m"], "id", ids)
    by_g = {x.g: x.n for x in X.distinct_over(bits, ["g"], "n").collect()}
    assert by_g == {g: len({i for a, _, i in rows if a == g and i is not None}) for g in "abc"}
    two = X.distinct_over(bits.where("m <> 'z'"), [F.lit("all").alias("l")], "n").first().n
    assert two == len({i for _, m, i in rows if m != "z" and i is not None})
