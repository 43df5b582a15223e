"""Source normalisation, metric-query rules and the line/header severity switch."""
import os
import tempfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from martlens.operators.metrics import _mart_route, choose_grain, metric_query
from martlens.plans import quality as Q
from martlens.profile import TimeWindow
from martlens.sources.raw import normalise_nulls, read_source, to_iso_date

from .conftest import SF


def test_csv_header_and_null_normalisation(spark):
    d = tempfile.mkdtemp(prefix="src-")
    with open(os.path.join(d, "orders.csv"), "w") as f:
        f.write(" Order_ID ,ORDER_DATE, Promo_ID\n1,2026-05-01,PR1\n2,2026-05-02,  \n3,not a date,\n")
    df = read_source(spark, d, fmt="csv", schema="order_id long, order_date string, promo_id string")
    assert df.columns == ["order_id", "order_date", "promo_id"]
    raw = spark.read.option("header", "true").csv(d)
    assert read_source(spark, d, fmt="csv").columns == ["order_id", "order_date", "promo_id"]
    out = normalise_nulls(df, ["promo_id"]).select("order_id", to_iso_date("order_date", "yyyy-MM-dd").alias("d"),
                                                   "promo_id").orderBy("order_id").collect()
    assert [(r.d, r.promo_id) for r in out] == [(date(2026, 5, 1), "PR1"), (date(2026, 5, 2), None), (None, None)]
    assert raw.count() == 3


def test_metric_query_refusals(star):
    with pytest.raises(ValueError):
        metric_query(star, ["profit"], ["city"])
    with pytest.raises(ValueError):
        choose_grain(["revenue_with_tax"], ["category"])
    assert choose_grain(["revenue", "margin_pct"], ["channel"]) == "line"


def test_mart_routing_rule():
    whole = TimeWindow(date(2001, 5, 1), date(2001, 7, 31))
    part = TimeWindow(date(2001, 5, 2), date(2001, 7, 31))
    assert _mart_route(["revenue", "aov"], ["city"], whole, None) == "mart_city_month"
    assert _mart_route(["revenue"], ["channel", "month_key"], whole, None) == "mart_channel_month"
    assert _mart_route(["revenue"], ["city"], part, None) is None
    assert _mart_route(["gross_margin"], ["city"], whole, None) is None
    assert _mart_route(["revenue"], ["day_type"], whole, None) is None


def test_mart_route_equals_fact_query(star):
    w = star.profile.window()
    a = {tuple(r) for r in metric_query(star, ["revenue", "orders", "aov"], ["city"], w, use_marts=True).collect()}
    b = {tuple(r) for r in metric_query(star, ["revenue", "orders", "aov"], ["city"], w).collect()}
    assert a == b


def _lines_matching_headers(star, bump_orders, bump):
    fo = star.fact_orders
    net = F.when(F.col("order_id").isin(bump_orders), (F.col("net_before_tax") + F.lit(bump)).cast("decimal(18,2)")) \
        .otherwise(F.col("net_before_tax"))
    return fo.select("order_id", F.lit("SKU1").alias("sku_id"), F.col("total_qty").alias("quantity"),
                     F.col("net_before_tax").alias("unit_price"), net.alias("line_gross_value"),
                     F.lit(0).cast("decimal(18,2)").alias("line_discount"), net.alias("line_net_value"),
                     F.lit(0).cast("decimal(18,2)").alias("est_cogs"), net.alias("line_margin"), "month_key")


def test_line_variance_severity_switches_from_warning_to_error(spark, star):
    ids = [r.order_id for r in star.fact_orders.select("order_id").orderBy("order_id").limit(200).collect()]
    exp = Q.expected_counts_from_sources(spark, SF, star)

    def check(lines):
        rep = Q.quality_report(star.with_tables(fact_order_lines=lines), exp)
        return rep.filter(F.col("name") == "line_to_header_reconciliation").first()

    small = check(_lines_matching_headers(star, ids[:1], 5))
    assert not small.passed and small.severity == "warning" and small.observed == 1
    large = check(_lines_matching_headers(star, ids, 5))
    assert not large.passed and large.severity == "error"
    clean = check(_lines_matching_headers(star, [], 5))
    assert clean.passed
