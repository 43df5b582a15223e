"""Mutation tests: start from the star, corrupt one thing, the targeted check must move."""
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from martlens.plans import quality as Q

from .conftest import SF


def _report(spark, star):
    rep = Q.full_report(star, Q.expected_counts_from_sources(spark, SF, star)).collect()
    return {r["name"]: r for r in rep}


@pytest.fixture(scope="module")
def base(spark, star):
    return _report(spark, star)


def _flips(before, after):
    return {n for n in before if before[n]["passed"] != after[n]["passed"]}


def _one_row(df, key, value):
    return F.col(key) == F.lit(value)


def test_baseline_finds_the_planted_faults(base):
    assert not base["every_order_has_lines"]["passed"]
    assert base["every_order_has_lines"]["observed"] > 0
    assert not base["line_to_header_reconciliation"]["passed"]
    assert base["tax_reconciliation"]["passed"]
    assert base["primary_key_unique::fact_orders"]["passed"]
    assert base["anonymous_order_share"]["severity"] == "info"


def test_verdict_fails_on_errors(spark, star):
    rep = Q.full_report(star, Q.expected_counts_from_sources(spark, SF, star))
    v = Q.verdict(rep).first()
    assert v.passed is False and v.errors > 0
    with pytest.raises(Q.QualityGateError):
        Q.enforce(rep)


def test_deleting_a_referenced_store_fails_its_foreign_key(spark, star, base):
    first = star.fact_orders.select("store_id").first()[0]
    mutated = star.with_tables(dim_store=star.dim_store.filter(F.col("store_id") != first))
    after = _report(spark, mutated)
    assert not after["foreign_key::fact_orders.store_id"]["passed"]
    assert "foreign_key::fact_orders.store_id" in _flips(base, after)


def test_negative_unit_price_fails_only_non_negativity(spark, star, base):
    fl = star.fact_order_lines
    oid = fl.select("order_id").first()[0]
    bad = fl.withColumn("unit_price", F.when(F.col("order_id") == oid, -F.col("unit_price"))
                        .otherwise(F.col("unit_price")))
    after = _report(spark, star.with_tables(fact_order_lines=bad))
    assert _flips(base, after) == {"no_negative_values"}


def test_null_required_column(spark, star, base):
    fo = star.fact_orders
    oid = fo.select("order_id").first()[0]
    bad = fo.withColumn("channel", F.when(F.col("order_id") == oid, F.lit(None).cast("string"))
                        .otherwise(F.col("channel")))
    after = _report(spark, star.with_tables(fact_orders=bad))
    assert _flips(base, after) == {"required_columns_not_null"}


def test_flipped_weekend_flag(spark, star, base):
    fo = star.fact_orders
    oid = fo.select("order_id").first()[0]
    bad = fo.withColumn("is_weekend", F.when(F.col("order_id") == oid, 1 - F.col("is_weekend"))
                        .otherwise(F.col("is_weekend")))
    after = _report(spark, star.with_tables(fact_orders=bad))
    assert _flips(base, after) == {"is_weekend_matches_day_type"}


def test_unknown_channel(spark, star, base):
    fo = star.fact_orders
    oid = fo.select("order_id").first()[0]
    bad = fo.withColumn("channel", F.when(F.col("order_id") == oid, F.lit("Drone")).otherwise(F.col("channel")))
    after = _report(spark, star.with_tables(fact_orders=bad))
    assert _flips(base, after) == {"channels_in_vocabulary"}


def test_tax_off_by_two_paise(spark, star, base):
    fo = star.fact_orders
    oid = fo.select("order_id").first()[0]
    bad = fo.withColumn("net_revenue", F.when(F.col("order_id") == oid,
                                              (F.col("net_revenue") + F.lit(Decimal("0.02"))).cast("decimal(18,2)"))
                        .otherwise(F.col("net_revenue")))
    after = _report(spark, star.with_tables(fact_orders=bad))
    assert _flips(base, after) == {"tax_reconciliation"}


def test_duplicate_primary_key(spark, star, base):
    dup = star.dim_promotion.unionByName(star.dim_promotion.limit(1))
    after = _report(spark, star.with_tables(dim_promotion=dup))
    assert _flips(base, after) == {"primary_key_unique::dim_promotion", "row_count::dim_promotion"}


def test_dropping_an_orders_lines_is_counted(spark, star, base):
    fl = star.fact_order_lines
    oid = fl.select("order_id").first()[0]
    after = _report(spark, star.with_tables(fact_order_lines=fl.filter(F.col("order_id") != oid)))
    assert after["every_order_has_lines"]["observed"] == base["every_order_has_lines"]["observed"] + 1


def test_malformed_month_key_is_counted(spark, star, base):
    cal = star.dim_calendar
    d0 = cal.select("date").first()[0]
    bad = cal.withColumn("month_key", F.when(F.col("date") == F.lit(d0), F.lit("2001/01"))
                         .otherwise(F.col("month_key")))
    after = _report(spark, star.with_tables(dim_calendar=bad))
    assert after["month_key_integrity"]["observed"] == base["month_key_integrity"]["observed"] + 1
