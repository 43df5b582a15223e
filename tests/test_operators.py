"""Comparison, set, preview and sink operators; idempotent star rebuild."""
import json
import os
import tempfile

from pyspark.sql import functions as F

from martlens.operators import compare as D
from martlens.operators import sets as U
from martlens.operators.topk import top_k_per_group
from martlens.sources.sinks import golden_payload, preview, write_golden

from .conftest import SF


def test_contains_run_forwards_and_reversed(spark):
    r = spark.createDataFrame([(i, f"S{i}") for i in range(1, 8)], "pos int, store string")
    assert D.contains_run(r, "store", "pos", ["S3", "S4", "S5"]).first().contains_run
    assert D.contains_run(r, "store", "pos", ["S5", "S4", "S3"]).first().reversed
    assert not D.contains_run(r, "store", "pos", ["S3", "S5"]).first().contains_run


def test_reconcile_reports_missing_and_out_of_tolerance(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 3.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.4), ("y", 5.0), ("w", 1.0)], "k string, v double")
    r = D.reconcile(a, b, ["k"], {"v": 0.5}).first()
    assert (r.missing_left, r.missing_right, r.out_of_tolerance) == (1, 1, 1)


def test_figure_presence(spark):
    t = spark.createDataFrame([("a", 100.0), ("b", 250.0)], "target_id string, target double")
    c = spark.createDataFrame([(100.6,), (300.0,)], "num double")
    got = {r.target_id: r.present for r in D.figure_presence(t, c, 1.0).collect()}
    assert got == {"a": True, "b": False}


def test_set_operations(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "c string")
    b = spark.createDataFrame([("x",), (None,)], "c string")
    assert [r.c for r in U.difference(a, b, ["c"]).collect()] == ["y"]
    eq = U.set_equality(a, b, ["c"]).first()
    assert (eq.only_left, eq.only_right, eq.equal) == (1, 0, False)
    assert U.union_distinct(a, b).count() == 3


def test_union_same_signature_refuses_different_columns(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(1,)], "y int")
    try:
        U.union_same_signature(a, b)
        raise AssertionError("expected a refusal")
    except ValueError:
        pass


def test_salted_top_k_per_group_is_exact(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    got = top_k_per_group(df, ["g"], [F.col("v").desc()], 4, salt_buckets=16)
    want = {(g, v) for g in range(3) for v in sorted([x for x in range(5000) if x % 3 == g])[-4:]}
    assert {(r.g, r.v) for r in got.collect()} == want


def test_preview_flags_truncation(spark):
    df = spark.range(25).withColumnRenamed("id", "v")
    p = preview(df, 10, [F.col("v").desc()]).collect()
    assert len(p) == 10 and all(r.truncated for r in p) and p[0].v == 24
    assert not preview(df, 30, [F.col("v")]).first().truncated


def test_golden_payload_sink(spark, star):
    from martlens.plans import analyses as A
    out = os.path.join(tempfile.mkdtemp(prefix="golden-"), "g")
    write_golden(golden_payload("Q1", {"headline": A.headline(star)}), out)
    line = spark.read.text(out).first()[0]
    doc = json.loads(json.loads(line)["payload"])
    assert set(doc["headline"][0]) >= {"revenue", "orders", "aov"}
    assert round(doc["headline"][0]["revenue"], 2) == doc["headline"][0]["revenue"]


def test_rebuild_is_idempotent(spark):
    from martlens.sources.bind_tpch import bind_star
    from martlens.sources.star import read_star, row_counts, write_star
    star = bind_star(spark, SF)
    a = {r.table_name: r.rows for r in row_counts(read_star(spark, write_star(star), star.profile)).collect()}
    b = {r.table_name: r.rows for r in row_counts(read_star(spark, write_star(star), star.profile)).collect()}
    assert a == b and a["fact_orders"] > 0
