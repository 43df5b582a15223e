from datetime import date

import pytest
from pyspark.sql import functions as F

from martlens.functions import scalars as S
from martlens.functions import text as X
from martlens.profile import TESTDATA, TimeWindow, month_keys_between, shift_months


def test_zero_safe_arithmetic(spark):
    df = spark.createDataFrame([(0.0, 5.0), (2.0, 3.0), (4.0, 0.0)], "a double, b double")
    r = df.select(S.safe_ratio("b", "a").alias("r"), S.safe_pct_change("a", "b").alias("p")).collect()
    assert [x.r for x in r] == [0.0, 1.5, 0.0]
    assert [x.p for x in r] == [0.0, 50.0, -100.0]


def test_percentage_rounds_half_up_exactly(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (1, 8), (0, 0), (5664, 20000)], "p long, w long")
    got = [x[0] for x in df.select(S.percentage("p", "w")).collect()]
    assert got == [33.3333, 66.6667, 12.5, 0.0, 28.32]


def test_month_helpers(spark):
    assert shift_months(date(2026, 5, 1), -3) == date(2026, 2, 1)
    assert month_keys_between(date(2025, 11, 15), date(2026, 2, 1)) == ["2025-11", "2025-12", "2026-01", "2026-02"]
    row = spark.createDataFrame([(date(2025, 11, 15), date(2026, 2, 1))], "a date, b date").select(
        S.month_keys_between("a", "b").alias("m"), S.months_in_window("a", "b").alias("n"),
        S.month_key_of("a").alias("k"), S.shift_months("a", 2).alias("s")).first()
    assert row.m == ["2025-11", "2025-12", "2026-01", "2026-02"] and row.n == 4
    assert row.k == "2025-11" and row.s == date(2026, 1, 1)


def test_date_like_parser_is_ansi_safe(spark):
    df = spark.createDataFrame([("2026-05-31",), ("2026-05",), ("2026-13",), ("May",), (None,)], "s string")
    got = [x[0] for x in df.select(S.parse_date_like("s")).collect()]
    assert got == [date(2026, 5, 31), date(2026, 5, 1), None, None, None]


def test_festive_window_wraps_year_end(spark):
    df = spark.createDataFrame([(date(2025, 12, 31),), (date(2026, 1, 1),), (date(2026, 1, 2),),
                                (date(2025, 10, 20),)], "d date")
    got = [x[0] for x in df.select(S.festive_period("d", TESTDATA.festive_periods)).collect()]
    assert got == ["New Year", "New Year", "Normal", "Diwali"]


def test_text_key(spark):
    df = spark.createDataFrame([("  What was Revenue?? ",), ("what  was\trevenue",)], "t string")
    assert {x[0] for x in df.select(X.text_key("t")).collect()} == {"what was revenue"}


def test_top_n_expectation(spark):
    df = spark.createDataFrame([("top 5 stores",), ("the last 3 months",), ("worst 3 months",), ("best 10",)],
                               "q string")
    assert [x[0] for x in df.select(X.top_n("q")).collect()] == [5, None, None, 10]


def test_time_window_and_resolver():
    with pytest.raises(ValueError):
        TimeWindow(date(2026, 5, 2), date(2026, 5, 1))
    p = TESTDATA
    w = p.resolve("last 3 months")
    assert (w.start, w.end) == (date(2001, 5, 1), date(2001, 7, 31))
    assert p.resolve("last month").start == date(2001, 6, 1)
    assert p.resolve("ytd").start == date(2001, 1, 1)
    assert p.resolve("december").start == date(2000, 12, 1)
    assert p.prior_bounds() == (date(2001, 2, 1), date(2001, 4, 30))


def test_coverage_guard_refuses_outside_data():
    p = TESTDATA
    with pytest.raises(ValueError):
        p.check_coverage(TimeWindow(date(2002, 1, 1), date(2002, 3, 31)), p.data_start, p.as_of)
    p.check_coverage(p.window(), p.data_start, p.as_of)
