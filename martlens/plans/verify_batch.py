"""Verification of many answers at once (C-01 ... C-07, V-01 ... V-15).

``verify`` checks the results of one question, a plan per result. Here the results of any number of
answers are one long form, and every check is a grouped aggregation over it, so the plan has one
shape for one answer or a million, and its work grows with the cells:

* ``answers(answer_id, question, metrics)``;
* ``results(answer_id, idx, result_id, failed, columns)``: the results of an answer in order, their
  columns as array of (name, kind), kind being ``num``, ``str``, ``date`` or another;
* ``cells(answer_id, idx, row, column, num, str)``: every cell, NULLs included, dates as text.

Column roles are read off the names by one ordered table. One aggregation per (answer, result, column)
gives what most checks need, one per (answer, result, row) the AOV reconciliation, one per distinct
value the cardinalities. Only an answer's own thirteen report rows are ever brought together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.functions import scalars as S
from martlens.operators.numbering import stored
from martlens.plans import verify as V
from martlens.profile import Profile, TimeWindow

#: A name has a role if it holds one of its tokens and no role before it that excludes it (C-01 ... C-06).
ROLE_TABLE: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("delta", V.DELTA_TOKENS, ()),
    ("share", V.SHARE_TOKENS, ("delta",)),
    ("aov", V.AOV_TOKENS, ("delta",)),
    ("revenue", V.REVENUE_TOKENS, ("delta", "share", "aov")),
    ("orders", V.ORDER_COUNT_TOKENS, ("delta", "share")),
    ("quantity", V.QUANTITY_TOKENS, ("delta", "share")),
)
#: (check, severity) in report order.
CHECKS = (("all_sub_queries_executed", V.WARNING), ("results_non_empty", V.WARNING), ("no_all_null_columns", V.WARNING),
          ("no_negative_measures", V.ERROR), ("aov_reconciles", V.ERROR), ("parts_sum_to_total", V.ERROR),
          ("shares_sum_to_100", V.WARNING), ("revenue_within_plausible_bound", V.ERROR),
          ("row_count_matches_expectation", V.WARNING), ("planned_metrics_present", V.WARNING),
          ("dates_within_data_range", V.ERROR), ("results_cover_the_window", V.WARNING), ("dimension_coverage", V.WARNING))
_RESULT = ["answer_id", "idx"]


def roles_of(name: Column) -> dict[str, Column]:
    """Boolean column per role of a column name."""
    low, out = F.lower(name), {}
    for role, tokens, excluded_by in ROLE_TABLE:
        held = reduce(lambda a, b: a | b, (low.contains(t) for t in tokens))
        out[role] = reduce(lambda a, b: a & ~b, (out[r] for r in excluded_by), held)
    return out


def long_form(answer_id: Column, idx: int, df: DataFrame, columns: list[tuple[str, str]], row: Column) -> DataFrame:
    """The cells of one result of every answer: df has the rows of all answers, ``row`` tells those of an answer apart."""
    none = {"num": F.lit(None).cast("double"), "str": F.lit(None).cast("string")}
    cells = [F.struct(F.lit(c).alias("column"), (F.col(c).cast("double") if k == "num" else none["num"]).alias("num"),
                      (none["str"] if k == "num" else F.col(c).cast("string")).alias("str")) for c, k in columns]
    # the row's name first, so its cells share it also where it is a generated number
    return df.select(answer_id.alias("answer_id"), F.lit(idx).alias("idx"), row.cast("string").alias("row"),
                     F.array(*cells).alias("c")).select("answer_id", "idx", "row", F.inline("c"))


def _columns(results: DataFrame, exhaustive: dict[str, int]) -> DataFrame:
    """One row per column of a result, with its place, its roles and whether it is the first of a role."""
    cols = results.where(~F.col("failed")).select(*_RESULT, F.posexplode("columns").alias("pos", "_c")).select(
        *_RESULT, "pos", F.col("_c.name").alias("column"), F.col("_c.kind").alias("kind"))
    cols = cols.withColumns({**{r: c for r, c in roles_of(F.col("column")).items()},
                             "is_num": F.col("kind") == "num", "is_dim": F.col("column").isin(*exhaustive),
                             "is_month": F.lower("column").contains("month") | F.lower("column").contains("date")})
    first = cols.groupBy(*_RESULT).agg(*(F.min(F.when(F.col(r), F.col("pos"))).alias(f"_first_{r}")
                                         for r in ("revenue", "orders", "aov", "is_dim")))
    cols = cols.join(first, _RESULT)
    return cols.withColumns({f"first_{r}": F.col("pos").eqNullSafe(F.col(f"_first_{r}")) & (F.col("is_num") | F.lit(r == "is_dim"))
                             for r in ("revenue", "orders", "aov", "is_dim")}).drop(*(f"_first_{r}" for r in (
                                 "revenue", "orders", "aov", "is_dim")))


def _result_facts(columns: DataFrame, cells: DataFrame, profile: Profile) -> DataFrame:
    """One row per executed result with every measure the checks need."""
    p, exhaustive = profile, dict(profile.exhaustive_dimensions)
    # three aggregations read the cells with their roles: written once
    held = stored(columns.join(cells, [*_RESULT, "column"], "left"), "verified-cells")
    here = F.col("row").isNotNull()
    day = S.parse_date_like(F.col("str"))
    measure = F.col("is_num") & (F.col("revenue") | F.col("orders") | F.col("quantity"))
    out_of_range = ~F.col("is_num") & ((day < S.lit_date(p.data_start)) | (day > S.lit_date(p.last_day)))
    flags = ("pos", "is_num", "is_dim", "is_month", "share", "revenue", "first_revenue", "first_orders", "first_aov", "first_is_dim")
    per_column = held.groupBy(*_RESULT, "column", *flags).agg(
        F.count(F.when(here, 1)).alias("rows"), F.count(F.coalesce("str", F.col("num").cast("string"))).alias("filled"),
        F.count(F.when(measure & (F.col("num") < 0), 1)).alias("negative"), F.sum("num").alias("total"),
        F.count(F.when(F.col("revenue") & (F.col("num") > p.max_plausible_revenue), 1)).alias("over"),
        F.count(F.when(out_of_range, 1)).alias("bad_days"),
        F.collect_set(F.when(F.col("is_month"), F.date_format(day, "yyyy-MM"))).alias("months"),  # a set of months
        F.max("num").alias("largest"))
    # distinct values of the dimensions that can be exhausted, counted after they are made distinct
    values = held.where("is_dim").where(here).select(
        *_RESULT, "column", F.coalesce("str", F.col("num").cast("string")).alias("v")).distinct().groupBy(*_RESULT, "column").agg(
        F.count("v").alias("distinct"), F.max(F.col("v").isNull().cast("int")).alias("has_null"))
    size = reduce(lambda a, kv: a.when(F.col("column") == kv[0], kv[1]), exhaustive.items(), F.when(F.lit(False), 0))
    per_column = per_column.join(values, [*_RESULT, "column"], "left").withColumn("size", size)
    distinct = F.coalesce("distinct", F.lit(0))
    rows = F.max("rows")
    facts = per_column.groupBy(*_RESULT).agg(
        rows.alias("rows"), F.max(F.col("filled") == 0).alias("empty_column"), F.max(F.col("negative") > 0).alias("negative"),
        F.max(F.col("share") & F.col("is_num") & (F.col("filled") == F.col("rows"))
              & (F.abs(F.col("total") - 100.0) > p.share_tolerance)).alias("share_off"),
        F.max((F.col("over") > 0) & F.col("is_num")).alias("over"), F.max(F.col("bad_days") > 0).alias("bad_days"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("is_month"), F.col("months"))))).alias("months"),
        F.max(F.col("is_dim") & (distinct > 0) & (distinct < F.col("size"))).alias("part_of_dimension"),
        F.max("is_dim").alias("has_dim"), F.max("first_revenue").alias("has_revenue"),
        F.max(F.when(F.col("first_is_dim"), distinct + F.coalesce("has_null", F.lit(0)) == F.col("size"))).alias("whole"),
        F.max(F.when(F.col("first_revenue"), F.col("largest"))).alias("one_total"),
        F.max(F.when(F.col("first_revenue"), F.coalesce("total", F.lit(0.0)))).alias("parts"))
    # AOV row by row, where a result has all three columns as numbers
    three = [F.max(F.when(F.col(f"first_{r}"), F.col("num"))).alias(r) for r in ("revenue", "orders", "aov")]
    by_row = held.where(here & (F.col("first_revenue") | F.col("first_orders") | F.col("first_aov"))) \
        .groupBy(*_RESULT, "row").agg(*three).where("revenue is not null and orders is not null and aov is not null and orders <> 0")
    aov = by_row.groupBy(*_RESULT).agg(F.max(
        F.abs(F.col("revenue") / F.col("orders") - F.col("aov")) > p.aov_tolerance).alias("aov_off"))
    return facts.join(aov, _RESULT, "left")


def verify_batch(answers: DataFrame, results: DataFrame, cells: DataFrame, window: TimeWindow | Column,
                 profile: Profile) -> DataFrame:
    """(answer_id, name, severity, passed, n_offenders, result_ids) for every answer and check (V-01 ... V-13).

    ``window`` is the window of all answers, or an array column of ``answers`` with the months of each.
    """
    months = F.array(*map(F.lit, window.months())) if isinstance(window, TimeWindow) else window
    exhaustive = dict(profile.exhaustive_dimensions)
    asked = answers.select("answer_id", "metrics", V.top_n_col(F.col("question")).alias("top_n"), months.alias("window"))
    columns = _columns(results, exhaustive)
    facts = _result_facts(columns, cells, profile).join(asked.drop("metrics"), "answer_id") \
        .join(results.select(*_RESULT, "result_id"), _RESULT)
    n = F.col("rows")
    overlap = F.size(F.array_intersect(F.coalesce("months", F.array().cast("array<string>")), "window"))
    tests = {
        "results_non_empty": n == 0, "no_all_null_columns": (n > 0) & F.col("empty_column"),
        "no_negative_measures": F.col("negative"), "aov_reconciles": F.col("aov_off"),
        "shares_sum_to_100": (n >= 2) & F.col("share_off"), "revenue_within_plausible_bound": F.col("over"),
        "row_count_matches_expectation": (n > F.col("top_n") * F.greatest(F.lit(1), F.size("window")))
        & (n >= V.MIN_ROWS_FOR_TOPN_WARNING),
        "dates_within_data_range": F.col("bad_days"),
        "results_cover_the_window": (overlap > 0) & (overlap < F.size("window")),
        "dimension_coverage": F.col("top_n").isNull() & (n > 0) & F.col("part_of_dimension")}
    offending = F.filter(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())), lambda x: x.isNotNull())
    found = facts.select("answer_id", F.explode(offending).alias("name"), "idx", F.col("result_id").alias("offender"))
    failed = results.where("failed").select("answer_id", F.lit("all_sub_queries_executed").alias("name"), "idx",
                                            F.col("result_id").alias("offender"))
    found = found.unionByName(failed).unionByName(_missing_metrics(asked, columns)).unionByName(_parts(facts, profile))
    listed = found.groupBy("answer_id", "name").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("idx", "offender"))), lambda s: s["offender"]).alias("result_ids"))
    every = asked.select("answer_id", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(s).alias("severity"))
                                                          for k, s in CHECKS))).alias("c")).select("answer_id", "c.*")
    out = every.join(listed, ["answer_id", "name"], "left")
    # a difference of total and parts is one offence of two results
    size = F.coalesce(F.size("result_ids"), F.lit(0))
    n = F.when(F.col("name") == "parts_sum_to_total", F.least(F.lit(1), size)).otherwise(size)
    return out.select("answer_id", "name", "severity", F.col("result_ids").isNull().alias("passed"),
                      n.cast("long").alias("n_offenders"),
                      F.coalesce("result_ids", F.array().cast("array<string>")).alias("result_ids"))


def _missing_metrics(asked: DataFrame, columns: DataFrame) -> DataFrame:
    """V-10: planned metrics without a column that holds one of their tokens."""
    names = columns.groupBy("answer_id").agg(F.array_join(F.collect_set(F.lower("column")), "\n").alias("_names"))
    tokens = F.create_map(*(x for k, ts in V.METRIC_TOKENS.items() for x in (F.lit(k), F.array(*map(F.lit, ts)))))
    each = asked.select("answer_id", F.posexplode("metrics").alias("idx", "offender")).join(names, "answer_id", "left")
    wanted = F.coalesce(F.try_element_at(tokens, F.col("offender")), F.array("offender"))
    present = F.exists(wanted, lambda t: F.coalesce(F.contains(F.col("_names"), t), F.lit(False)))
    return each.where(~present).select("answer_id", F.lit("planned_metrics_present").alias("name"), "idx", "offender")


def _parts(facts: DataFrame, profile: Profile) -> DataFrame:
    """V-06: the first whole breakdown of an answer against its first one-row total."""
    total = F.when((F.col("rows") == 1) & F.col("has_revenue") & ~F.col("has_dim") & F.col("one_total").isNotNull(), F.col("idx"))
    breakdown = F.when(F.col("has_revenue") & F.col("whole"), F.col("idx"))
    both = facts.groupBy("answer_id").agg(F.min_by(F.struct("result_id", F.col("one_total").alias("v")), total).alias("t"),
                                          F.min_by(F.struct("result_id", F.col("parts").alias("v")), breakdown).alias("b"))
    off = both.where(F.abs(F.col("b.v") - F.col("t.v")) > profile.total_tolerance)
    return off.select("answer_id", F.lit("parts_sum_to_total").alias("name"), F.posexplode(F.array(
        "b.result_id", "t.result_id")).alias("idx", "offender"))


def verdicts(report: DataFrame) -> DataFrame:
    """V-14 and V-15 per answer: status, errors, warnings, and the results named by failed error checks."""
    failed = ~F.col("passed")
    error = failed & (F.col("severity") == V.ERROR)
    g = report.groupBy("answer_id").agg(
        F.count(F.when(error, 1)).alias("errors"),
        F.count(F.when(failed & (F.col("severity") == V.WARNING), 1)).alias("warnings"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(error, F.col("result_ids")))))).alias("blamed"))
    return g.select("answer_id", F.when(F.col("errors") > 0, F.lit("failed")).when(
        F.col("warnings") > 0, F.lit("passed_with_warnings")).otherwise(F.lit("passed")).alias("status"),
        "errors", "warnings", "blamed")
