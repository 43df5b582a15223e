"""Result verification (C-01 ... C-08, V-01 ... V-15).

Input: an ordered list of named result DataFrames (order matters: "the first
total", "the first breakdown"), the analysis window and the question text.

Column roles are decided from the schema (names and types) while the plan is
built; no data is touched for that. Each result is then scanned once: one
aggregation computes every measure the checks need (row count, non-null counts,
negative counts, AOV reconciliation, share sums, plausibility, dimension
cardinalities, date range, months seen). The checks are small frames over those
one-row profiles, unioned into the report; nothing is collected to the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.functions import scalars as S
from martlens.profile import Profile, TimeWindow
from martlens.session import ensure_checkpoint_dir

ERROR, WARNING, INFO = "error", "warning", "info"

# --- fixed token lists of the column-role rules (must match the source system) ---
REVENUE_TOKENS = ("revenue", "sales", "turnover", "net_before_tax", "net_revenue", "gross_bill")
ORDER_COUNT_TOKENS = ("orders", "order_count", "num_orders", "transactions", "txn_count")
QUANTITY_TOKENS = ("qty", "quantity", "units")
AOV_TOKENS = ("aov", "average_order_value", "avg_order_value")
DELTA_TOKENS = ("change", "delta", "diff", "growth", "decline", "drop", "variance", "_vs_", "mom", "yoy", "trend")
SHARE_TOKENS = ("share", "pct_of", "percent_of", "proportion", "mix_pct", "contribution_pct")
TIME_TOKENS = ("month_key", "month", "order_date", "date", "day", "week", "period")
LABEL_HINTS = ("id", "name", "city", "channel", "region", "store", "product", "sku", "category", "segment",
               "format", "type", "period", "day")
TOP_N_RE = r"(?i)\b(?:top|bottom|best|worst)\s+(\d{1,3})\b(?!\s*(?:month|week|day|year|quarter)s?\b)"
METRIC_TOKENS = {
    "revenue": ("revenue", "sales", "net_before_tax"), "orders": ("orders", "order_count"),
    "aov": ("aov", "average_order_value"), "units": ("units", "qty", "quantity"),
    "units_per_order": ("units_per_order", "basket"), "gross_margin": ("margin",), "margin_pct": ("margin",),
    "revenue_with_tax": ("revenue",), "gross_revenue": ("gross", "revenue"), "discount": ("discount",),
}
MIN_ROWS_FOR_TOPN_WARNING = 2
REPORT_SCHEMA = ("name string, severity string, passed boolean, result_ids array<string>, n_offenders bigint, "
                 "message string")


def _has(col: str, tokens) -> bool:
    low = col.lower()
    return any(t in low for t in tokens)


# --- C-01 ... C-08: roles from names ---------------------------------------------
def is_delta(c: str) -> bool:
    return _has(c, DELTA_TOKENS)


def is_share(c: str) -> bool:
    return not is_delta(c) and _has(c, SHARE_TOKENS)


def is_aov(c: str) -> bool:
    return not is_delta(c) and _has(c, AOV_TOKENS)


def is_revenue(c: str) -> bool:
    return not (is_delta(c) or is_share(c) or is_aov(c)) and _has(c, REVENUE_TOKENS)


def is_order_count(c: str) -> bool:
    return not (is_delta(c) or is_share(c)) and _has(c, ORDER_COUNT_TOKENS)


def is_quantity(c: str) -> bool:
    return not (is_delta(c) or is_share(c)) and _has(c, QUANTITY_TOKENS)


def is_time(c: str) -> bool:
    low = c.lower()
    return any(low == t or low.endswith("_" + t) or low.startswith(t + "_") for t in TIME_TOKENS)


def is_month_column(c: str) -> bool:
    low = c.lower()
    return "month" in low or "date" in low


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType) and not isinstance(dt, T.BooleanType)


def is_label(c: str, dt: T.DataType) -> bool:
    """C-07: a label if non-numeric or named like one (and not a time column)."""
    if is_time(c):
        return False
    return not is_numeric_type(dt) or any(c.lower() == h or c.lower().endswith("_" + h) for h in LABEL_HINTS)


def is_flag_name(c: str) -> bool:
    low = c.lower()
    return low.startswith(("is_", "has_", "was_")) or low.endswith("_flag")


def flag_columns(df: DataFrame) -> DataFrame:
    """C-08: flag-named columns whose values lie in {0, 1, NULL}; one aggregation."""
    cands = [f.name for f in df.schema.fields if is_flag_name(f.name)
             and (is_numeric_type(f.dataType) or isinstance(f.dataType, T.BooleanType))]
    spark = df.sparkSession
    if not cands:
        return spark.createDataFrame([], "column string")
    agg = df.agg(*[F.count(F.when(~F.col(c).cast("int").isin(0, 1), 1)).alias(f"_bad{i}")
                   for i, c in enumerate(cands)],
                 *[F.count(c).alias(f"_nn{i}") for i, c in enumerate(cands)])
    rows = [F.struct(F.lit(c).alias("column"), ((F.col(f"_bad{i}") == 0) & (F.col(f"_nn{i}") > 0)).alias("ok"))
            for i, c in enumerate(cands)]
    return agg.select(F.explode(F.array(*rows)).alias("r")).filter("r.ok").select("r.column")


def roles(df: DataFrame) -> dict[str, list[str]]:
    """Schema-level role map (C-01 ... C-07), in result column order."""
    out: dict[str, list[str]] = {k: [] for k in ("delta", "share", "aov", "revenue", "orders", "quantity",
                                                 "time", "label", "measure")}
    for f in df.schema.fields:
        c = f.name
        for k, pred in (("delta", is_delta), ("share", is_share), ("aov", is_aov), ("revenue", is_revenue),
                        ("orders", is_order_count), ("quantity", is_quantity)):
            if pred(c):
                out[k].append(c)
        if is_time(c):
            out["time"].append(c)
        elif is_label(c, f.dataType):
            out["label"].append(c)
        else:
            out["measure"].append(c)
    return out


@dataclass(frozen=True)
class Plan:
    question: str
    window: TimeWindow
    metrics: tuple[str, ...] = ()


def top_n_of(question: str) -> int | None:
    """F-15 on the driver side (the question is one string)."""
    m = re.search(TOP_N_RE, question)
    return int(m.group(1)) if m else None


def top_n_col(question: Column) -> Column:
    """F-15 as a column expression (Java regex supports the negative lookahead)."""
    return F.nullif(F.regexp_extract(question, TOP_N_RE, 1), F.lit("")).cast("int")


# --- per-result profile -----------------------------------------------------------
def _first(cols: list[str], pred) -> str | None:
    return next((c for c in cols if pred(c)), None)


def _profile(rid: str, idx: int, df: DataFrame, profile: Profile, w: TimeWindow) -> tuple[DataFrame, dict]:
    """One aggregation over a result with every measure the checks need."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = df.columns
    num = lambda c: c is not None and is_numeric_type(types[c])
    rev, ords, aov = _first(cols, is_revenue), _first(cols, is_order_count), _first(cols, is_aov)
    exhaustive = dict(profile.exhaustive_dimensions)
    dim = _first(cols, lambda c: c in exhaustive)
    measures = [c for c in cols if (is_revenue(c) or is_order_count(c) or is_quantity(c)) and num(c)]
    shares = [c for c in cols if is_share(c) and num(c)]
    revenue_cols = [c for c in cols if is_revenue(c) and num(c)]
    date_cols = [c for c in cols if isinstance(types[c], (T.DateType, T.TimestampType, T.TimestampNTZType))
                 or isinstance(types[c], T.StringType)]
    month_cols = [c for c in cols if is_month_column(c)]
    dims_present = [d for d in exhaustive if d in cols]
    a = [F.count(F.lit(1)).alias("rows")]
    a += [F.count(F.col(f"`{c}`")).alias(f"nn::{c}") for c in cols]
    a += [F.count(F.when(F.col(f"`{c}`") < 0, 1)).alias(f"neg::{c}") for c in measures]
    if num(rev) and num(ords) and num(aov):
        r, o, v = (S.as_double(F.col(f"`{x}`")) for x in (rev, ords, aov))
        ok = r.isNotNull() & o.isNotNull() & v.isNotNull() & (o != 0)
        a += [F.count(F.when(ok, 1)).alias("aov_checked"),
              F.count(F.when(ok & (F.abs(r / F.when(o != 0, o) - v) > profile.aov_tolerance), 1)).alias("aov_bad")]
    else:
        a += [F.lit(0).cast("long").alias("aov_checked"), F.lit(0).cast("long").alias("aov_bad")]
    for c in shares:
        a += [F.sum(S.as_double(F.col(f"`{c}`"))).alias(f"share_sum::{c}"),
              F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"share_null::{c}")]
    a += [F.count(F.when(S.as_double(F.col(f"`{c}`")) > profile.max_plausible_revenue, 1)).alias(f"over::{c}")
          for c in revenue_cols]
    if num(rev):
        a += [F.first(S.as_double(F.col(f"`{rev}`")), ignorenulls=False).alias("first_rev"),
              F.sum(F.coalesce(S.as_double(F.col(f"`{rev}`")), F.lit(0.0))).alias("parts_sum")]
    else:
        a += [F.lit(None).cast("double").alias("first_rev"), F.lit(None).cast("double").alias("parts_sum")]
    for d in dims_present:
        a += [F.countDistinct(F.col(f"`{d}`").cast("string")).alias(f"dist::{d}"),
              F.max(F.col(f"`{d}`").isNull().cast("int")).alias(f"hasnull::{d}")]
    lo, hi = S.lit_date(profile.data_start), S.lit_date(profile.last_day)
    for c in date_cols:
        parsed = (F.to_date(F.col(f"`{c}`")) if not isinstance(types[c], T.StringType)
                  else S.parse_date_like(F.col(f"`{c}`")))
        a += [F.count(F.when((parsed < lo) | (parsed > hi), 1)).alias(f"datebad::{c}")]
    for c in month_cols:
        parsed = (F.to_date(F.col(f"`{c}`")) if not isinstance(types[c], T.StringType)
                  else S.parse_date_like(F.col(f"`{c}`")))
        a += [F.collect_set(F.date_format(parsed, "yyyy-MM")).alias(f"months::{c}")]
    meta = dict(rid=rid, idx=idx, cols=cols, rev=rev if num(rev) else None, dim=dim, measures=measures,
                shares=shares, revenue_cols=revenue_cols, date_cols=date_cols, month_cols=month_cols,
                dims_present=dims_present, has_aov=bool(num(rev) and num(ords) and num(aov)))
    # The one-row profile is read by every check: materialise it once (reliable
    # checkpoint in the shared folder) instead of re-planning it per check.
    ensure_checkpoint_dir(df.sparkSession)
    return df.agg(*a).checkpoint(eager=True), meta


def _cand(p: DataFrame, meta: dict, offending: Column, applicable: Column | None = None) -> DataFrame:
    return p.select(F.lit(meta["idx"]).alias("idx"), F.lit(meta["rid"]).alias("rid"),
                    (applicable if applicable is not None else F.lit(True)).alias("applicable"),
                    offending.alias("offending"))


def _any(cols: list[Column]) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | c
    return out


def _check_row(cands: DataFrame, name: str, severity: str, ok_msg: str, bad_msg: str) -> DataFrame:
    agg = cands.agg(
        F.count(F.when(F.col("applicable") & F.col("offending"), 1)).alias("n_offenders"),
        F.transform(F.array_sort(F.collect_set(F.when(F.col("applicable") & F.col("offending"),
                                                      F.struct("idx", "rid")))), lambda s: s["rid"])
        .alias("result_ids"))
    return agg.select(
        F.lit(name).alias("name"), F.lit(severity).alias("severity"), (F.col("n_offenders") == 0).alias("passed"),
        F.col("result_ids"), F.col("n_offenders"),
        F.when(F.col("n_offenders") == 0, F.lit(ok_msg))
        .otherwise(F.concat(F.lit(bad_msg + ": "), F.array_join(F.col("result_ids"), ", "))).alias("message"))


def verify(results: list[tuple[str, DataFrame | BaseException | None]], plan: Plan, profile: Profile) -> DataFrame:
    """The verification report: one row per check (V-01 ... V-13)."""
    ok_results = [(rid, df) for rid, df in results if isinstance(df, DataFrame)]
    spark = ok_results[0][1].sparkSession if ok_results else None
    if spark is None:
        raise ValueError("verification needs at least one executed result")
    w = plan.window
    topn = top_n_of(plan.question)
    profiles = [_profile(rid, i, df, profile, w) for i, (rid, df) in enumerate(ok_results)]
    checks: list[DataFrame] = []

    # V-01: executed (driver-side status of each sub-query)
    status = spark.createDataFrame(
        [(i, rid, True, not isinstance(df, DataFrame)) for i, (rid, df) in enumerate(results)],
        "idx int, rid string, applicable boolean, offending boolean")
    checks.append(_check_row(status, "all_sub_queries_executed", WARNING, "every sub-query executed",
                             "sub-queries failed"))

    def union(parts: list[DataFrame]) -> DataFrame:
        if not parts:
            return spark.createDataFrame([], "idx int, rid string, applicable boolean, offending boolean")
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    # V-02 results_non_empty
    checks.append(_check_row(union([_cand(p, m, F.col("rows") == 0) for p, m in profiles]),
                             "results_non_empty", WARNING, "every result has rows", "empty results"))
    # V-03 no_all_null_columns (skips empty results)
    checks.append(_check_row(union([_cand(p, m, _any([F.col(f"`nn::{c}`") == 0 for c in m["cols"]]),
                                          F.col("rows") > 0) for p, m in profiles]),
                             "no_all_null_columns", WARNING, "no column is entirely NULL",
                             "results with an all-NULL column"))
    # V-04 no_negative_measures
    checks.append(_check_row(union([_cand(p, m, _any([F.col(f"`neg::{c}`") > 0 for c in m["measures"]]))
                                    for p, m in profiles]),
                             "no_negative_measures", ERROR, "no negative revenue, order or unit value",
                             "negative measures in"))
    # V-05 aov_reconciles
    checks.append(_check_row(union([_cand(p, m, F.col("aov_bad") > 0, F.col("aov_checked") > 0)
                                    for p, m in profiles]),
                             "aov_reconciles", ERROR, "AOV equals revenue / orders where checked",
                             "AOV does not reconcile in"))
    # V-07 shares_sum_to_100
    share_parts = []
    for p, m in profiles:
        conds = [(F.col(f"`share_null::{c}`") == 0) & (F.abs(F.col(f"`share_sum::{c}`") - 100.0)
                                                        > profile.share_tolerance) for c in m["shares"]]
        share_parts.append(_cand(p, m, _any(conds), F.col("rows") >= 2))
    checks.append(_check_row(union(share_parts), "shares_sum_to_100", WARNING, "share columns sum to 100",
                             "share columns not summing to 100 in"))
    # V-08 revenue_within_plausible_bound
    checks.append(_check_row(union([_cand(p, m, _any([F.col(f"`over::{c}`") > 0 for c in m["revenue_cols"]]))
                                    for p, m in profiles]),
                             "revenue_within_plausible_bound", ERROR, "every revenue is below the bound",
                             "implausible revenue in"))
    # V-09 row_count_matches_expectation
    if topn is None:
        v09 = union([_cand(p, m, F.lit(False)) for p, m in profiles])
    else:
        allowance = topn * max(1, len(w.months()))
        v09 = union([_cand(p, m, (F.col("rows") > allowance) & (F.col("rows") >= MIN_ROWS_FOR_TOPN_WARNING))
                     for p, m in profiles])
    checks.append(_check_row(v09, "row_count_matches_expectation", WARNING,
                             "row counts consistent with the question", "more rows than asked for in"))
    # V-10 planned metrics present (schema check)
    all_cols = [c.lower() for _, df in ok_results for c in df.columns]
    missing = [mname for mname in plan.metrics
               if not any(any(t in c for t in METRIC_TOKENS.get(mname, (mname,))) for c in all_cols)]
    v10 = spark.createDataFrame([(i, mname, True, True) for i, mname in enumerate(missing)],
                                "idx int, rid string, applicable boolean, offending boolean")
    checks.append(_check_row(v10, "planned_metrics_present", WARNING, "every planned metric has a column",
                             "planned metrics without a column"))
    # V-11 dates_within_data_range
    checks.append(_check_row(union([_cand(p, m, _any([F.col(f"`datebad::{c}`") > 0 for c in m["date_cols"]]))
                                    for p, m in profiles]),
                             "dates_within_data_range", ERROR, "every date lies inside the data range",
                             "dates outside the data range in"))
    # V-12 results_cover_the_window (partial overlap only)
    expected = F.array(*[F.lit(x) for x in w.months()])
    v12 = []
    for p, m in profiles:
        if not m["month_cols"]:
            v12.append(_cand(p, m, F.lit(False)))
            continue
        seen = F.array_distinct(F.flatten(F.array(*[F.col(f"`months::{c}`") for c in m["month_cols"]])))
        overlap = F.size(F.array_intersect(seen, expected))
        v12.append(_cand(p, m, (overlap > 0) & (overlap < F.size(expected))))
    checks.append(_check_row(union(v12), "results_cover_the_window", WARNING, "monthly results cover the window",
                             "window only partly covered in"))
    # V-13 dimension_coverage (exempt for top-N questions)
    exhaustive = dict(profile.exhaustive_dimensions)
    v13 = []
    for p, m in profiles:
        if topn is not None or not m["dims_present"]:
            v13.append(_cand(p, m, F.lit(False)))
            continue
        v13.append(_cand(p, m, _any([(F.col(f"`dist::{d}`") > 0) & (F.col(f"`dist::{d}`") < exhaustive[d])
                                     for d in m["dims_present"]]), F.col("rows") > 0))
    checks.append(_check_row(union(v13), "dimension_coverage", WARNING, "breakdowns cover their dimension",
                             "partial dimension coverage in"))
    # V-06 parts_sum_to_total: first one-row result with revenue and no exhaustive dim is the total;
    # the first breakdown over an exhaustive dim with full cardinality is summed.
    tot_parts, brk_parts = [], []
    for p, m in profiles:
        if m["rev"] is not None and not any(c in exhaustive for c in m["cols"]):
            tot_parts.append(p.select(F.lit(m["idx"]).alias("idx"), F.lit(m["rid"]).alias("rid"),
                                      F.col("first_rev").alias("total"))
                             .filter((F.col("total").isNotNull()) & (F.lit(True)) & (p["rows"] == 1)))
        if m["rev"] is not None and m["dim"] is not None:
            d = m["dim"]
            card = F.col(f"`dist::{d}`") + F.coalesce(F.col(f"`hasnull::{d}`"), F.lit(0))
            brk_parts.append(p.filter(card == exhaustive[d]).select(
                F.lit(m["idx"]).alias("idx"), F.lit(m["rid"]).alias("rid"), F.col("parts_sum")))
    checks.append(_parts_sum_check(spark, tot_parts, brk_parts, profile))

    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def _parts_sum_check(spark, tot_parts, brk_parts, profile: Profile) -> DataFrame:
    name, sev = "parts_sum_to_total", ERROR
    if not tot_parts or not brk_parts:
        return spark.createDataFrame([(name, sev, True, [], 0, "nothing to reconcile")], REPORT_SCHEMA)
    tot = tot_parts[0]
    for x in tot_parts[1:]:
        tot = tot.unionByName(x)
    brk = brk_parts[0]
    for x in brk_parts[1:]:
        brk = brk.unionByName(x)
    t = tot.agg(F.min_by(F.struct("rid", "total"), "idx").alias("t"))
    b = brk.agg(F.min_by(F.struct("rid", "parts_sum"), "idx").alias("b"))
    j = t.crossJoin(b)
    has = F.col("t").isNotNull() & F.col("b").isNotNull()
    delta = F.col("b.parts_sum") - F.col("t.total")
    ok = ~has | (F.abs(delta) <= profile.total_tolerance)
    return j.select(
        F.lit(name).alias("name"), F.lit(sev).alias("severity"), ok.alias("passed"),
        F.when(has & ~ok, F.array(F.col("b.rid"), F.col("t.rid"))).otherwise(F.array().cast("array<string>"))
        .alias("result_ids"),
        F.when(has & ~ok, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_offenders"),
        F.when(~has, F.lit("nothing to reconcile")).when(ok, F.lit("breakdown sums to the total"))
        .otherwise(F.format_string("breakdown differs from the total by %.2f", delta)).alias("message"))


def verdict(report: DataFrame) -> DataFrame:
    """V-14: failed / passed_with_warnings / passed."""
    return report.agg(
        F.count(F.when((F.col("severity") == ERROR) & ~F.col("passed"), 1)).alias("errors"),
        F.count(F.when((F.col("severity") == WARNING) & ~F.col("passed"), 1)).alias("warnings"),
    ).select(
        F.when(F.col("errors") > 0, F.lit("failed")).when(F.col("warnings") > 0, F.lit("passed_with_warnings"))
        .otherwise(F.lit("passed")).alias("status"), "errors", "warnings")


def blame(report: DataFrame) -> DataFrame:
    """V-15: distinct result ids named by failed error checks."""
    return (report.filter((F.col("severity") == ERROR) & ~F.col("passed"))
            .select(F.explode("result_ids").alias("result_id")).distinct())
