"""Verification checks on hand-built result tables (cases of the source system's verifier tests)."""
from datetime import date

from martlens.plans import verify as V
from martlens.profile import RESTAURANT, TimeWindow

P = RESTAURANT
WIN = TimeWindow(date(2026, 5, 1), date(2026, 7, 31))


def run(spark, question, results):
    res = [(rid, spark.createDataFrame(rows, schema)) for rid, rows, schema in results]
    rep = V.verify(res, V.Plan(question, WIN, ("revenue",)), P).collect()
    return {r["name"]: r for r in rep}


TOTAL = ("total", [(1000.0,)], "revenue double")
CHANNELS = [("Dine-in", 400.0), ("Takeaway", 300.0), ("Swiggy", 200.0), ("Zomato", 100.0)]


def test_breakdown_equals_total(spark):
    r = run(spark, "How do channels compare?", [TOTAL, ("by_channel", CHANNELS, "channel string, revenue double")])
    assert r["parts_sum_to_total"]["passed"]


def test_breakdown_misses_total(spark):
    bad = CHANNELS[:3] + [("Zomato", 150.0)]
    r = run(spark, "How do channels compare?", [TOTAL, ("by_channel", bad, "channel string, revenue double")])
    assert not r["parts_sum_to_total"]["passed"] and r["parts_sum_to_total"]["severity"] == "error"
    assert r["parts_sum_to_total"]["result_ids"] == ["by_channel", "total"]


def test_incomplete_breakdown_not_reconciled(spark):
    r = run(spark, "How do channels compare?", [TOTAL, ("by_channel", CHANNELS[:2], "channel string, revenue double")])
    assert r["parts_sum_to_total"]["passed"]
    assert not r["dimension_coverage"]["passed"]


def test_aov_wrong_and_within_tolerance(spark):
    bad = run(spark, "q", [("x", [(1000.0, 10, 120.0)], "revenue double, orders long, aov double")])
    ok = run(spark, "q", [("x", [(1000.0, 10, 100.4)], "revenue double, orders long, aov double")])
    assert not bad["aov_reconciles"]["passed"] and ok["aov_reconciles"]["passed"]


def test_empty_result_is_a_warning(spark):
    r = run(spark, "q", [("x", [], "revenue double")])
    assert not r["results_non_empty"]["passed"] and r["results_non_empty"]["severity"] == "warning"


def test_negative_revenue_error_but_negative_change_fine(spark):
    r = run(spark, "q", [("x", [(-5.0, -20.0)], "revenue double, revenue_change double")])
    assert r["no_negative_measures"]["n_offenders"] == 1
    r2 = run(spark, "q", [("x", [(5.0, -20.0)], "revenue double, revenue_change double")])
    assert r2["no_negative_measures"]["passed"]


def test_implausible_revenue(spark):
    r = run(spark, "q", [("x", [(2.0e7,)], "revenue double")])
    assert not r["revenue_within_plausible_bound"]["passed"]


def test_date_outside_range(spark):
    r = run(spark, "q", [("x", [("2024-01-31", 5.0)], "order_date string, revenue double")])
    assert not r["dates_within_data_range"]["passed"]


def test_top_n_row_expectation(spark):
    rows = [(f"ST{i:03d}", float(i)) for i in range(40)]
    r = run(spark, "Which are the top 5 stores?", [("x", rows, "store_id string, revenue double")])
    assert not r["row_count_matches_expectation"]["passed"]
    r2 = run(spark, "What happened in the last 3 months?", [("x", rows, "store_id string, revenue double")])
    assert r2["row_count_matches_expectation"]["passed"]


def test_window_coverage(spark):
    two = [("2026-06", 1.0), ("2026-07", 2.0)]
    full = [("2026-05", 1.0)] + two
    prior = [("2026-02", 1.0), ("2026-03", 1.0)]
    assert not run(spark, "q", [("x", two, "month_key string, revenue double")])["results_cover_the_window"]["passed"]
    assert run(spark, "q", [("x", full, "month_key string, revenue double")])["results_cover_the_window"]["passed"]
    assert run(spark, "q", [("x", prior, "month_key string, revenue double")])["results_cover_the_window"]["passed"]


def test_dimension_coverage_exempt_for_top_n(spark):
    one_city = [("Kolkata", 5.0)]
    assert not run(spark, "revenue by city", [("x", one_city, "city string, revenue double")])[
        "dimension_coverage"]["passed"]
    assert run(spark, "top 3 cities", [("x", one_city, "city string, revenue double")])["dimension_coverage"]["passed"]


def test_shares_sum_to_100(spark):
    r = run(spark, "q", [("x", [("a", 50.0), ("b", 30.0)], "channel string, revenue_share_pct double")])
    assert not r["shares_sum_to_100"]["passed"]


def test_verdict_and_blame(spark):
    res = [("x", spark.createDataFrame([(1000.0, 10, 120.0)], "revenue double, orders long, aov double"))]
    rep = V.verify(res, V.Plan("q", WIN), P)
    assert V.verdict(rep).first().status == "failed"
    assert [r.result_id for r in V.blame(rep).collect()] == ["x"]


def test_roles():
    assert V.is_revenue("revenue_net") and not V.is_revenue("revenue_change") and not V.is_revenue("aov")
    assert V.is_share("revenue_share_pct") and not V.is_share("share_change")
    assert V.is_order_count("orders") and V.is_quantity("units")
