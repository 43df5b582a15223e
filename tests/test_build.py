"""The build: gate, stored marts, coverage guard, and values at which earlier forms broke."""
from dataclasses import replace
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from martlens.functions import scalars as S
from martlens.operators.marts import build_marts
from martlens.operators.metrics import metric_query
from martlens.plans import quality as Q
from martlens.plans.decline import flag_membership
from martlens.profile import TESTDATA, TimeWindow
from martlens.sources.bind_tpch import bind_star, store_id_of
from martlens.sources.star import COLUMNS, build_star, read_star, refresh_star

from .conftest import SF


def test_percentage_of_large_sums(spark):
    rows = spark.createDataFrame([(10 ** 17, 3 * 10 ** 17), (9 * 10 ** 18, 9 * 10 ** 18), (1, 0), (0, 5)], "p long, w long")
    assert [r[0] for r in rows.select(S.percentage("p", "w")).collect()] == [33.3333, 100.0, 0.0, 0.0]


def test_store_ids_beyond_three_digits(spark):
    got = [r[0] for r in spark.createDataFrame([(7,), (100,), (1000,), (10001,)], "k long").select(store_id_of(F.col("k"))).collect()]
    assert got == ["ST007", "ST100", "ST1000", "ST10001"]


def test_build_stops_at_the_gate(spark):
    star = bind_star(spark, SF, replace(TESTDATA, known_failures=()))
    with pytest.raises(Q.QualityGateError, match="every_order_has_lines"):
        build_star(star, Q.expected_counts_from_sources(spark, SF, star))


def test_built_star_passes_and_stores_marts(spark, star):
    report = spark.read.parquet(f"{star.source}/quality_report")
    failed = {r.name for r in report.where("severity = 'error' and not passed").collect()}
    assert failed == set(TESTDATA.known_failures)
    for name, mart in build_marts(star).items():
        assert star.source in mart.inputFiles()[0] and name in mart.inputFiles()[0]
    total = build_marts(star)["mart_city_month"].agg(F.sum("revenue_net")).first()[0]
    assert isinstance(total, Decimal) and total == star.fact_orders.agg(F.sum("net_before_tax")).first()[0]


def test_window_outside_the_data_is_refused(star):
    for w in (TimeWindow(date(1994, 12, 1), date(1995, 1, 31), "x"), TimeWindow(date(2001, 7, 1), date(2001, 8, 2), "x")):
        with pytest.raises(ValueError, match="outside the data range"):
            metric_query(star, ["revenue"], ["city"], window=w)


def test_members_without_a_flag_are_kept(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("c", None), ("d", None)], "name string, up int")
    got = {(r.flag, r.value): (r.n_members, r.labels) for r in flag_membership(df, "name", ["up"]).collect()}
    assert got == {("up", 1): (1, "a"), ("up", 0): (1, "b"), ("up", None): (2, "c,d")}
    none = flag_membership(df.where("up is null"), "name", ["up"]).collect()
    assert {(r.value, r.n_members) for r in none} == {(1, 0), (0, 0), (None, 2)}


def _changed(star, orders=None, lines=None):
    wide = star.wide_orders if orders is None else orders
    return star.with_tables(wide_orders=wide, fact_orders=wide.select(*COLUMNS["fact_orders"]),
                            wide_lines=star.wide_lines if lines is None else lines)


def test_one_changed_month_rewrites_one_month(spark, star):
    month = TESTDATA.window().months()[0]
    expected = Q.expected_counts_from_sources(spark, SF, star)
    assert refresh_star(star, star.source, expected) == (star.source, [])
    wide = star.wide_orders.withColumn("channel", F.when(F.col("month_key") == month, "5-LOW").otherwise(F.col("channel")))
    root, months = refresh_star(_changed(star, wide), star.source, expected)
    assert months == [month] and root != star.source
    new = read_star(spark, root, star.profile)
    assert spark.read.parquet(f"{root}/wide_orders").select("month_key").distinct().count() == 1
    assert sorted(map(str, new.wide_orders.select(*wide.columns).collect())) == sorted(map(str, wide.collect()))
    assert new.wide_lines.count() == star.wide_lines.count()
    full = build_star(_changed(star, wide), expected)
    for name, mart in build_marts(read_star(spark, full, star.profile)).items():
        assert sorted(map(str, mart.select(*sorted(mart.columns)).collect())) == \
            sorted(map(str, new.marts[name].select(*sorted(mart.columns)).collect()))
    # a second refresh upon the first, of another month
    other = TESTDATA.window().months()[1]
    twice = new.wide_orders.withColumn("channel", F.when(F.col("month_key") == other, "1-URGENT").otherwise(F.col("channel")))
    root2, months2 = refresh_star(_changed(new, twice), root, expected)
    again = read_star(spark, root2, star.profile)
    assert months2 == [other]
    assert sorted(map(str, again.wide_orders.groupBy("month_key", "channel").count().collect())) == \
        sorted(map(str, twice.groupBy("month_key", "channel").count().collect()))


def test_a_failed_gate_leaves_the_old_months(spark, star):
    month = TESTDATA.window().months()[0]
    expected = Q.expected_counts_from_sources(spark, SF, star)
    bad = star.wide_orders.withColumn("net_before_tax", F.when(F.col("month_key") == month, -F.col("net_before_tax"))
                                      .otherwise(F.col("net_before_tax")).cast("decimal(18,2)"))
    before = star.fact_orders.agg(F.sum("net_before_tax")).first()[0]
    with pytest.raises(Q.QualityGateError):
        refresh_star(_changed(star, bad), star.source, expected)
    assert read_star(spark, star.source, star.profile).fact_orders.agg(F.sum("net_before_tax")).first()[0] == before


def test_written_facts_shuffle_source_columns_and_equal_the_lazy_ones(spark, tmp_path):
    from martlens.sources.bind_tpch import bind_star
    from martlens.sources.star import write_star

    lazy = bind_star(spark, SF)
    assert not {"store_name", "city", "tax_amount", "festive_period"} & set(lazy.orders_base.columns)
    attrs = lazy.fact_orders.selectExpr("order_id as __oid", "order_date", "month_key", "store_id", "channel")
    assert not {"sku_id", "line_margin", "est_cogs"} & set(lazy.lines_base(attrs).columns)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    root = write_star(lazy, str(tmp_path / "star"))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    for name in ("wide_orders", "wide_lines"):
        got, want = spark.read.parquet(f"{root}/{name}"), getattr(lazy, name)
        assert set(got.columns) == set(want.columns)
        got = got.select(*want.columns)
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
