"""Registered quality-gate queries (Q-01 ... Q-33) with their DuckDB twins."""

from __future__ import annotations


from martlens import oracle as O
from martlens.plans import quality as Q
from martlens.profile import TESTDATA as P
from martlens.registry import register
from martlens.sources.star import PRIMARY_KEYS

_FEST = [fp.name for fp in P.festive_periods]


def _in(vals) -> str:
    return ", ".join(f"'{v}'" for v in vals)


def _cnt(cond: str) -> str:
    return f"COUNT(CASE WHEN {cond} THEN 1 END)"


def _mart_cte(name: str, keys: list[str]) -> str:
    cols = ", ".join(keys)
    return f"""{name} AS (
  SELECT {cols}, COUNT(*) AS orders, SUM(net_before_tax) AS revenue_net, SUM(gross_bill_value) AS revenue_gross,
         SUM(total_qty) AS units, {O.safe_ratio('SUM(net_before_tax)', 'COUNT(*)')} AS aov
  FROM (SELECT f.*, s.store_name, s.city, s.region FROM fact_orders f JOIN dim_store s ON f.store_id = s.store_id) x
  GROUP BY {cols})"""


def _fk(child, col, parent, pcol, allow_null) -> str:
    extra = f" AND c.{col} IS NOT NULL" if allow_null else ""
    return (f"(SELECT COUNT(*) FROM {child} c LEFT JOIN (SELECT DISTINCT {pcol} AS k FROM {parent}) p "
            f"ON c.{col} = p.k WHERE p.k IS NULL{extra}) AS fk_{child}_{col}")


def _pk(name, keys) -> str:
    if name == "fact_orders":
        return "(SELECT COALESCE(SUM(n - 1), 0) FROM (SELECT COUNT(*) AS n FROM fact_orders GROUP BY order_id) d) " \
               "AS pk_fact_orders"
    k = keys[0] if len(keys) == 1 else "(" + ", ".join(keys) + ")"
    return f"(SELECT COUNT(*) - COUNT(DISTINCT {k}) FROM {name}) AS pk_{name}"


MK = "'^[0-9]{4}-[0-9]{2}$'"
_days = (P.last_day - P.data_start).days + 1
STATS_CTES = ",\n".join([
    _mart_cte("mart_store_month", ["store_id", "store_name", "city", "region", "month_key"]),
    _mart_cte("mart_city_month", ["city", "month_key"]),
    _mart_cte("mart_channel_month", ["channel", "month_key"]),
    f"""fo_stats AS (SELECT COUNT(*) AS rows_fact_orders,
  ({" + ".join(_cnt(f"{c} IS NULL") for c in Q.REQUIRED_COLUMNS)}) AS fo_null_required,
  MIN(order_date) AS fo_min_date, MAX(order_date) AS fo_max_date,
  {_cnt(f"NOT regexp_matches(month_key, {MK})")} AS fo_bad_mk,
  {_cnt("month_key <> substr(CAST(order_date AS VARCHAR), 1, 7)")} AS fo_mk_mismatch,
  COUNT(DISTINCT month_key) AS fo_distinct_mk,
  {_cnt(f"order_date > DATE '{P.last_day}'")} AS fo_future,
  {_cnt("abs(net_before_tax * 1.05 - net_revenue) > 0.01")} AS fo_tax_breach,
  {_cnt("abs(gross_bill_value - discount_amount - net_before_tax) > 0.01")} AS fo_gdn_breach,
  ({" + ".join(_cnt(f"{c} < 0") for c in Q.NON_NEGATIVE["fact_orders"])}) AS fo_neg,
  {_cnt(f"channel NOT IN ({_in(P.channels)})")} AS fo_bad_channel,
  {_cnt(f"festive_period NOT IN ({_in(_FEST + [P.non_festive_label])})")} AS fo_bad_festive,
  {_cnt(f"day_type NOT IN ({_in(P.day_types)})")} AS fo_bad_day_type,
  {_cnt("is_weekend <> CAST(day_type = 'Weekend' AS INTEGER)")} AS fo_weekend_mm,
  {_cnt(f"is_festive <> CAST(festive_period IN ({_in(_FEST)}) AS INTEGER)")} AS fo_festive_mm,
  {_cnt("customer_id IS NULL")} AS fo_anon, {_cnt("promo_id IS NOT NULL")} AS fo_promo,
  SUM(net_before_tax) AS fo_revenue, SUM(total_qty) AS fo_units,
  {_cnt("NOT (order_hour BETWEEN 0 AND 23)")} AS fo_bad_hour, COUNT(DISTINCT store_id) AS fo_distinct_stores
  FROM fact_orders)""",
    f"""fl_stats AS (SELECT COUNT(*) AS rows_fact_order_lines,
  ({" + ".join(_cnt(f"{c} < 0") for c in Q.NON_NEGATIVE["fact_order_lines"])}) AS fl_neg,
  {_cnt("line_margin <> line_net_value - est_cogs")} AS fl_margin_mm, SUM(quantity) AS fl_units
  FROM fact_order_lines)""",
    f"""cal_stats AS (SELECT COUNT(*) AS rows_dim_calendar, {_cnt(f"NOT regexp_matches(month_key, {MK})")} AS cal_bad_mk,
  {_cnt("is_weekend <> CAST(day_type = 'Weekend' AS INTEGER)")} AS cal_weekend_mm,
  {_cnt(f"is_festive <> CAST(festive_period IN ({_in(_FEST)}) AS INTEGER)")} AS cal_festive_mm FROM dim_calendar)""",
    f"""dp_stats AS (SELECT COUNT(*) AS rows_dim_product,
  ({" + ".join(_cnt(f"{c} < 0") for c in Q.NON_NEGATIVE["dim_product"])}) AS dp_neg FROM dim_product)""",
    """dims AS (SELECT (SELECT COUNT(*) FROM dim_store) AS rows_dim_store,
  (SELECT COUNT(*) FROM dim_customer) AS rows_dim_customer, (SELECT COUNT(*) FROM dim_promotion) AS rows_dim_promotion)""",
    "mart_stats AS (SELECT " + ", ".join(
        f"""(SELECT COUNT(*) FROM {m}) AS rows_{m}, (SELECT {_cnt(f"NOT regexp_matches(month_key, {MK})")} FROM {m})
  AS {s}_bad_mk, (SELECT SUM(revenue_net) FROM {m}) AS {s}_revenue, (SELECT SUM(orders) FROM {m}) AS {s}_orders,
  (SELECT {_cnt(f"abs(aov - {O.safe_ratio('revenue_net', 'orders')}) > 0.01")} FROM {m}) AS {s}_aov_mm"""
        for m, s in (("mart_store_month", "store"), ("mart_city_month", "city"),
                     ("mart_channel_month", "channel"))) + ")",
    "fk AS (SELECT " + ", ".join(_fk(*f) for f in Q.FOREIGN_KEYS) + ")",
    """per_order AS (SELECT order_id, SUM(line_net_value) AS ln FROM fact_order_lines GROUP BY order_id),
hdr AS (SELECT order_id, SUM(net_before_tax) AS h FROM fact_orders GROUP BY order_id),
wl AS (SELECT (SELECT COUNT(*) FROM hdr o WHERE NOT EXISTS
               (SELECT 1 FROM per_order p WHERE p.order_id = o.order_id)) AS orders_without_lines),
l2h AS (SELECT COUNT(CASE WHEN v > 1.00 THEN 1 END) AS l2h_affected,
               COALESCE(SUM(CASE WHEN v > 1.00 THEN v END), 0) AS l2h_variance
        FROM (SELECT abs(p.ln - o.h) AS v FROM hdr o JOIN per_order p ON o.order_id = p.order_id) j)""",
    "pk AS (SELECT " + ", ".join(_pk(n, k) for n, k in PRIMARY_KEYS.items()) + ")",
    f"""expected AS (SELECT (SELECT COUNT(*) FROM nation) AS exp_dim_store, (SELECT COUNT(*) FROM part) AS exp_dim_product,
  (SELECT COUNT(*) FROM customer) AS exp_dim_customer, (SELECT COUNT(*) FROM orders) AS exp_fact_orders,
  (SELECT COUNT(*) FROM lineitem) AS exp_fact_order_lines, 6 AS exp_dim_promotion, {_days} AS exp_dim_calendar)""",
    """stats AS (SELECT * FROM fo_stats, fl_stats, cal_stats, dp_stats, dims, mart_stats, fk, wl, l2h, pk, expected)""",
])


def _row(name, category, severity, passed, observed, expected="0") -> str:
    return (f"SELECT '{name}' AS name, '{category}' AS category, {severity} AS severity, ({passed}) AS passed, "
            f"CAST({observed} AS DOUBLE) AS observed, CAST({expected} AS DOUBLE) AS expected FROM stats")


def _report_sql() -> str:
    E, W_ = "'error'", "'warning'"
    rows = []
    for t in Q.EXPECTED_TABLES:
        rows.append(_row(f"row_count::{t}", Q.COMPLETENESS, E, f"rows_{t} = exp_{t}", f"rows_{t}", f"exp_{t}"))
    all_rows = [f"rows_{t}" for t in Q.EXPECTED_TABLES] + ["rows_mart_store_month", "rows_mart_city_month",
                                                          "rows_mart_channel_month"]
    empties = " + ".join(f"CAST({r} = 0 AS INTEGER)" for r in all_rows)
    rows.append(_row("no_empty_tables", Q.COMPLETENESS, E, f"{empties} = 0", empties))
    rows.append(_row("required_columns_not_null", Q.COMPLETENESS, E, "fo_null_required = 0", "fo_null_required"))
    for child, col, parent, _p, _n in Q.FOREIGN_KEYS:
        k = f"fk_{child}_{col}"
        rows.append(_row(f"foreign_key::{child}.{col}", Q.REFERENTIAL, E, f"{k} = 0", k))
    rows.append(_row("every_order_has_lines", Q.REFERENTIAL, E, "orders_without_lines = 0", "orders_without_lines"))
    off = (f"(CAST(fo_min_date <> DATE '{P.data_start}' AS INTEGER) + "
           f"CAST(fo_max_date <> DATE '{P.last_day}' AS INTEGER))")
    rows.append(_row("order_date_boundaries", Q.TEMPORAL, E, f"COALESCE({off} = 0, FALSE)", f"COALESCE({off}, 2)"))
    bad = "(fo_bad_mk + cal_bad_mk + store_bad_mk + city_bad_mk + channel_bad_mk)"
    rows.append(_row("month_key_integrity", Q.TEMPORAL, E,
                     f"{bad} = 0 AND fo_mk_mismatch = 0 AND fo_distinct_mk = {P.expected_month_count}",
                     f"{bad} + fo_mk_mismatch"))
    rows.append(_row("no_future_orders", Q.TEMPORAL, E, "fo_future = 0", "fo_future"))
    for s, m in (("store", "mart_store_month"), ("city", "mart_city_month"), ("channel", "mart_channel_month")):
        d = f"abs(COALESCE({s}_revenue, 0) - COALESCE(fo_revenue, 0))"
        rows.append(_row(f"mart_reconciliation::{m}", Q.FINANCIAL, E, f"{d} < {P.mart_tolerance}", d,
                         str(P.mart_tolerance)))
    rows.append(_row("tax_reconciliation", Q.FINANCIAL, E, "fo_tax_breach = 0", "fo_tax_breach"))
    rows.append(_row("gross_less_discount_equals_net", Q.FINANCIAL, E, "fo_gdn_breach = 0", "fo_gdn_breach"))
    opct = O.percentage4("l2h_affected", "rows_fact_orders")
    rpct = O.percentage4("CAST(l2h_variance * 100 AS BIGINT)", "CAST(COALESCE(fo_revenue, 0) * 100 AS BIGINT)")
    sev = (f"CASE WHEN {opct} <= {P.line_variance_orders_pct} AND {rpct} <= {P.line_variance_revenue_pct} "
           f"THEN {W_} ELSE {E} END")
    rows.append(_row("line_to_header_reconciliation", Q.FINANCIAL, sev, "l2h_affected = 0", "l2h_affected"))
    rows.append(_row("no_negative_values", Q.FINANCIAL, E, "fo_neg + fl_neg + dp_neg = 0", "fo_neg + fl_neg + dp_neg"))
    rows.append(_row("channels_in_vocabulary", Q.DOMAIN, E, "fo_bad_channel = 0", "fo_bad_channel"))
    rows.append(_row("festive_periods_in_vocabulary", Q.DOMAIN, E, "fo_bad_festive = 0", "fo_bad_festive"))
    rows.append(_row("day_types_in_vocabulary", Q.DOMAIN, E, "fo_bad_day_type = 0", "fo_bad_day_type"))
    rows.append(_row("is_weekend_matches_day_type", Q.DOMAIN, E, "fo_weekend_mm + cal_weekend_mm = 0",
                     "fo_weekend_mm + cal_weekend_mm"))
    rows.append(_row("is_festive_matches_festive_period", Q.DOMAIN, E, "fo_festive_mm + cal_festive_mm = 0",
                     "fo_festive_mm + cal_festive_mm"))
    for n in PRIMARY_KEYS:
        rows.append(_row(f"primary_key_unique::{n}", Q.DOMAIN, E, f"pk_{n} = 0", f"pk_{n}"))
    mo = ("(abs(store_orders - rows_fact_orders) + abs(city_orders - rows_fact_orders) "
          "+ abs(channel_orders - rows_fact_orders))")
    rows.append(_row("mart_orders_total_fact", Q.FINANCIAL, E, f"{mo} = 0", mo))
    am = "(store_aov_mm + city_aov_mm + channel_aov_mm)"
    rows.append(_row("mart_aov_is_ratio_of_sums", Q.FINANCIAL, E, f"{am} = 0", am))
    rows.append(_row("line_margin_identity", Q.FINANCIAL, E, "fl_margin_mm = 0", "fl_margin_mm"))
    rows.append(_row("order_hour_in_range", Q.DOMAIN, E, "fo_bad_hour = 0", "fo_bad_hour"))
    ud = "abs(COALESCE(fo_units, 0) - COALESCE(fl_units, 0))"
    rows.append(_row("units_agree_across_grains", Q.FINANCIAL, E, f"{ud} = 0", ud))
    I_ = "'info'"
    rows.append(_row("anonymous_order_share", Q.DISTRIBUTION, I_, "TRUE",
                     O.percentage4("fo_anon", "rows_fact_orders"), "NULL"))
    rows.append(_row("promotion_attachment_share", Q.DISTRIBUTION, I_, "TRUE",
                     O.percentage4("fo_promo", "rows_fact_orders"), "NULL"))
    rows.append(_row("dimension_cardinalities", Q.DISTRIBUTION, I_, "TRUE", "fo_distinct_stores", "NULL"))
    rows.append(_row("headline_averages", Q.DISTRIBUTION, I_, "TRUE",
                     O.safe_ratio("COALESCE(fo_revenue, 0)", "rows_fact_orders"), "NULL"))
    return "\nUNION ALL\n".join(rows)


REPORT_SQL = _report_sql()
SHAPE_CTE = f"""m AS (SELECT month_key, CAST(SUM(net_before_tax) AS DOUBLE) AS revenue FROM wide_orders
      WHERE {O.window_pred(P, start=P.data_start, end=P.last_day)} GROUP BY month_key),
pk_m AS (SELECT revenue AS peak FROM m ORDER BY revenue DESC, month_key LIMIT 1),
tr_m AS (SELECT revenue AS trough FROM m ORDER BY revenue ASC, month_key LIMIT 1)"""
SHAPE_SQL = (f"SELECT 'monthly_revenue_shape' AS name, 'distribution' AS category, 'info' AS severity, TRUE AS passed, "
             f"{O.safe_ratio('peak', 'trough')} AS observed, CAST(NULL AS DOUBLE) AS expected FROM pk_m, tr_m")


def _report(star, spark, sf_dir):
    return Q.full_report(star, Q.expected_counts_from_sources(spark, sf_dir, star))


@register("quality_report", O.with_star(f"{REPORT_SQL}\nUNION ALL\n{SHAPE_SQL}",
                                         extra_ctes=STATS_CTES + ",\n" + SHAPE_CTE))
def quality_report(star, spark, sf_dir):
    """The quality gate report: one row per check (Q-01 ... Q-33); P-05 ... P-07, J-03 ... J-05, F-07, F-16 inside."""
    return _report(star, spark, sf_dir).drop("details")


@register("quality_verdict", O.with_star(f"""
SELECT COUNT(CASE WHEN severity = 'error' AND NOT passed THEN 1 END) = 0 AS passed, COUNT(*) AS checks,
       COUNT(CASE WHEN severity = 'error' AND NOT passed THEN 1 END) AS errors,
       COUNT(CASE WHEN severity = 'warning' AND NOT passed THEN 1 END) AS warnings,
       COUNT(CASE WHEN severity = 'info' THEN 1 END) AS observations
FROM ({REPORT_SQL}\nUNION ALL\n{SHAPE_SQL}) r""", extra_ctes=STATS_CTES + ",\n" + SHAPE_CTE))
def quality_verdict(star, spark, sf_dir):
    """Report verdict: passed iff no failing error, counts by severity (Q-21)."""
    return Q.verdict(_report(star, spark, sf_dir))


@register("quality_by_category", O.with_star(f"""
SELECT category, COUNT(*) AS checks, COUNT(CASE WHEN NOT passed THEN 1 END) AS failed
FROM ({REPORT_SQL}\nUNION ALL\n{SHAPE_SQL}) r GROUP BY category""", extra_ctes=STATS_CTES + ",\n" + SHAPE_CTE))
def quality_by_category(star, spark, sf_dir):
    """Checks and failures per category (Q-21)."""
    return Q.by_category(_report(star, spark, sf_dir))
