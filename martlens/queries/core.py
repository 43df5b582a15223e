"""Registered star queries: headline, rankings, mix, product, day type, festive,
marts, metric query, distribution facts (with their DuckDB oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from martlens import oracle as O
from martlens.operators import marts as M
from martlens.operators.metrics import metric_query
from martlens.plans import analyses as A
from martlens.profile import TESTDATA as P
from martlens.registry import register

W = O.window_pred(P)
ORDER_AGGS = """CAST(SUM(net_before_tax) AS DOUBLE) AS revenue, COUNT(order_id) AS orders,
  CAST(COALESCE(SUM(total_qty), 0) AS BIGINT) AS units"""


def _finish(extra: str = "") -> str:
    return f"""*, {O.safe_ratio('revenue', 'orders')} AS aov, {O.safe_ratio('units', 'orders')} AS units_per_order
    {extra}"""


# --- Q1 ---------------------------------------------------------------------
@register("q1_headline", O.with_star(f"""
SELECT CAST(SUM(net_before_tax) AS DOUBLE) AS revenue, COUNT(order_id) AS orders,
       {O.safe_ratio('SUM(net_before_tax)', 'COUNT(order_id)')} AS aov,
       CAST(COALESCE(SUM(total_qty), 0) AS BIGINT) AS units,
       {O.safe_ratio('COALESCE(SUM(total_qty), 0)', 'COUNT(order_id)')} AS units_per_order,
       CAST(SUM(net_revenue) AS DOUBLE) AS revenue_with_tax,
       CAST(SUM(gross_bill_value) AS DOUBLE) AS gross_revenue,
       CAST(SUM(discount_amount) AS DOUBLE) AS discount
FROM wide_orders WHERE {W}"""))
def q1_headline(star, spark, sf_dir):
    """Q1 headline: revenue, orders, AOV, units over the window (A-12/A-15)."""
    return A.headline(star)


@register("q1_monthly", O.with_star(f"""
SELECT month_key, CAST(SUM(net_before_tax) AS DOUBLE) AS revenue, COUNT(order_id) AS orders,
       CAST(SUM(net_revenue) AS DOUBLE) AS revenue_with_tax, CAST(COALESCE(SUM(total_qty), 0) AS BIGINT) AS units,
       {O.safe_ratio('SUM(net_before_tax)', 'COUNT(order_id)')} AS aov,
       {O.safe_ratio('COALESCE(SUM(total_qty), 0)', 'COUNT(order_id)')} AS units_per_order
FROM wide_orders WHERE {W} GROUP BY month_key"""))
def q1_monthly(star, spark, sf_dir):
    """Q1 monthly series (A-13, F-01, F-06)."""
    return A.monthly(star)


# --- context (A-14) ------------------------------------------------------------------
FULL = O.window_pred(P, start=P.data_start, end=P.last_day)


@register("context_monthly", O.with_star(f"""
SELECT m.month_key, m.revenue, m.orders, m.units, {O.safe_ratio('m.revenue', 'm.orders')} AS aov,
       COALESCE(f.festive_periods, '') AS festive_periods
FROM (SELECT month_key, {ORDER_AGGS} FROM wide_orders WHERE {FULL} GROUP BY month_key) m
LEFT JOIN (SELECT month_key, array_to_string(list_sort(list_distinct(list(festive_period))), ',') AS festive_periods
           FROM dim_calendar WHERE festive_period <> 'Normal' GROUP BY month_key) f
  ON m.month_key = f.month_key"""))
def context_monthly(star, spark, sf_dir):
    """Seasonality context: full-range monthly series with festive periods (A-14)."""
    return A.seasonality_monthly(star)


@register("context_peak_trough", O.with_star(
    f"SELECT pk.*, tr.*, {O.safe_ratio('peak_revenue', 'trough_revenue')} AS peak_to_trough_ratio FROM pk, tr",
    extra_ctes=f"""
m AS (SELECT month_key, CAST(SUM(net_before_tax) AS DOUBLE) AS revenue FROM wide_orders WHERE {FULL}
      GROUP BY month_key),
pk AS (SELECT month_key AS peak_month, revenue AS peak_revenue FROM m ORDER BY revenue DESC, month_key LIMIT 1),
tr AS (SELECT month_key AS trough_month, revenue AS trough_revenue FROM m ORDER BY revenue ASC, month_key LIMIT 1)"""))
def context_peak_trough(star, spark, sf_dir):
    """Peak and trough month of the full range, ratio between them (A-14)."""
    return A.seasonality_summary(star)


# --- Q2 -------------------------------------------------------------------------
Q2_BASE = f"""
g AS (SELECT store_id, store_name, city, region, {ORDER_AGGS} FROM wide_orders WHERE {W}
      GROUP BY store_id, store_name, city, region),
t AS (SELECT CAST(COALESCE(SUM(net_before_tax), 0) AS DOUBLE) AS total FROM wide_orders WHERE {W}),
ranked AS (SELECT g.*, {O.safe_ratio('revenue', 'orders')} AS aov, {O.safe_ratio('units', 'orders')} AS units_per_order,
                  {O.pct_of('revenue', 'total')} AS revenue_share_pct,
                  row_number() OVER (ORDER BY revenue DESC, store_id) AS rank
           FROM g, t)"""


@register("q2_store_ranking", O.with_star("SELECT * FROM ranked", extra_ctes=Q2_BASE))
def q2_store_ranking(star, spark, sf_dir):
    """Q2 store ranking with share of window total and rank (A-16, W-01, W-05)."""
    return A.store_ranking(star)


@register("q2_top5_stores", O.with_star("SELECT * FROM ranked ORDER BY revenue DESC, store_id LIMIT 5",
                                         extra_ctes=Q2_BASE))
def q2_top5_stores(star, spark, sf_dir):
    """Top 5 stores by revenue (L-01)."""
    return A.top_stores(star)


@register("q2_bottom5_stores", O.with_star("SELECT * FROM ranked ORDER BY revenue ASC, store_id DESC LIMIT 5",
                                            extra_ctes=Q2_BASE))
def q2_bottom5_stores(star, spark, sf_dir):
    """Bottom 5 stores, worst first (L-02)."""
    return A.bottom_stores(star)


# --- Q3 -------------------------------------------------------------------------
@register("q3_channel_mix", O.with_star(f"""
SELECT g.*, {O.safe_ratio('revenue', 'orders')} AS aov, {O.safe_ratio('units', 'orders')} AS units_per_order,
       {O.pct_of('revenue', 'tr')} AS revenue_share_pct, {O.pct_of('orders', 'tor')} AS order_share_pct
FROM (SELECT channel, {ORDER_AGGS} FROM wide_orders WHERE {W} GROUP BY channel) g,
     (SELECT CAST(COALESCE(SUM(net_before_tax), 0) AS DOUBLE) AS tr, COUNT(order_id) AS tor
      FROM wide_orders WHERE {W}) t"""))
def q3_channel_mix(star, spark, sf_dir):
    """Q3 channel mix: revenue share, order share, basket size (A-17)."""
    return A.channel_mix(star)


# --- Q4 -------------------------------------------------------------------------
Q4_BASE = f"""
pr AS (SELECT sku_id, sku_name, category, CAST(SUM(quantity) AS BIGINT) AS quantity,
              CAST(SUM(line_net_value) AS DOUBLE) AS line_revenue, COUNT(DISTINCT order_id) AS orders,
              CAST(SUM(est_cogs) AS DOUBLE) AS est_cogs,
              CAST(SUM(line_net_value) - SUM(est_cogs) AS DOUBLE) AS gross_margin
       FROM wide_lines WHERE {W} GROUP BY sku_id, sku_name, category),
prm AS (SELECT *, {O.pct_of('gross_margin', 'line_revenue')} AS margin_pct FROM pr)"""


@register("q4_product_ranking", O.with_star("SELECT * FROM prm", extra_ctes=Q4_BASE))
def q4_product_ranking(star, spark, sf_dir):
    """Q4 product table at line grain: quantity, revenue, orders, cogs, margin (A-18, J-03)."""
    return A.product_ranking(star)


@register("q4_top5_by_quantity", O.with_star("SELECT * FROM prm ORDER BY quantity DESC, sku_id LIMIT 5",
                                              extra_ctes=Q4_BASE))
def q4_top5_by_quantity(star, spark, sf_dir):
    """Top 5 SKUs by units (L-01, volume reading)."""
    return A.top_products_by_quantity(star)


@register("q4_top5_by_revenue", O.with_star("SELECT * FROM prm ORDER BY line_revenue DESC, sku_id LIMIT 5",
                                             extra_ctes=Q4_BASE))
def q4_top5_by_revenue(star, spark, sf_dir):
    """Top 5 SKUs by line revenue (L-01, value reading)."""
    return A.top_products_by_revenue(star)


@register("q4_grain_variance", O.with_star(f"""
SELECT CAST(COALESCE(l, 0) AS DOUBLE) AS line_total, CAST(COALESCE(o, 0) AS DOUBLE) AS order_total,
       CAST(COALESCE(l, 0) - COALESCE(o, 0) AS DOUBLE) AS variance,
       {O.pct_change('CAST(COALESCE(o, 0) AS DOUBLE)', 'CAST(COALESCE(l, 0) AS DOUBLE)')} AS variance_pct
FROM (SELECT SUM(line_net_value) AS l FROM wide_lines WHERE {W}) a,
     (SELECT SUM(net_before_tax) AS o FROM wide_orders WHERE {W}) b"""))
def q4_grain_variance(star, spark, sf_dir):
    """Line-grain minus order-grain revenue, absolute and % (A-19)."""
    return A.grain_variance(star)


# --- Q6 -------------------------------------------------------------------------
def _q6_scope(scope: str, s, e) -> str:
    pred = O.window_pred(P, start=s, end=e)
    dpred = O.window_pred(P, col="date", start=s, end=e)
    return f"""
SELECT g.*, {O.safe_ratio('revenue', 'orders')} AS aov, {O.safe_ratio('units', 'orders')} AS units_per_order,
       CAST(COALESCE(d.distinct_days, 0) AS BIGINT) AS distinct_days,
       {O.safe_ratio('revenue', 'COALESCE(d.distinct_days, 0)')} AS avg_revenue_per_day,
       {O.safe_ratio('orders', 'COALESCE(d.distinct_days, 0)')} AS avg_orders_per_day, '{scope}' AS scope
FROM (SELECT day_type, {ORDER_AGGS} FROM wide_orders WHERE {pred} GROUP BY day_type) g
LEFT JOIN (SELECT day_type, COUNT(DISTINCT date) AS distinct_days FROM dim_calendar WHERE {dpred}
           GROUP BY day_type) d ON g.day_type = d.day_type"""


Q6_SQL = (f"SELECT * FROM ({_q6_scope('full_range', P.data_start, P.last_day)}) UNION ALL "
          f"SELECT * FROM ({_q6_scope('window', P.window_start, P.window_end)})")


@register("q6_day_type", O.with_star(Q6_SQL))
def q6_day_type(star, spark, sf_dir):
    """Q6 weekend vs weekday per calendar day, full range and window (A-28, J-07, P-02)."""
    return A.day_type_comparison(star)


@register("q6_day_type_ratios", O.with_star(f"""
SELECT scope,
  {O.safe_ratio("COALESCE(MAX(CASE WHEN day_type = 'Weekend' THEN avg_revenue_per_day END), 0.0)",
                "COALESCE(MAX(CASE WHEN day_type = 'Weekday' THEN avg_revenue_per_day END), 0.0)")}
    AS weekend_to_weekday_daily_revenue_ratio,
  {O.safe_ratio("COALESCE(MAX(CASE WHEN day_type = 'Weekend' THEN avg_orders_per_day END), 0.0)",
                "COALESCE(MAX(CASE WHEN day_type = 'Weekday' THEN avg_orders_per_day END), 0.0)")}
    AS weekend_to_weekday_daily_orders_ratio,
  {O.safe_ratio("COALESCE(MAX(CASE WHEN day_type = 'Weekend' THEN aov END), 0.0)",
                "COALESCE(MAX(CASE WHEN day_type = 'Weekday' THEN aov END), 0.0)")} AS weekend_to_weekday_aov_ratio
FROM ({Q6_SQL}) b GROUP BY scope"""))
def q6_day_type_ratios(star, spark, sf_dir):
    """Q6 weekend:weekday ratios of daily revenue, daily orders and AOV (A-28)."""
    return A.day_type_ratios(star)


# --- Q7 -------------------------------------------------------------------------
_FEST_NAMES = ", ".join(f"'{fp.name}'" for fp in P.festive_periods)
_VOCAB = ", ".join([f"('{P.non_festive_label}', 0)"] +
                   [f"('{fp.name}', {i + 1})" for i, fp in enumerate(P.festive_periods)] +
                   [f"('All festive', {len(P.festive_periods) + 1})"])


Q7_CTES = f"""
blocks AS (
  SELECT COALESCE(o.period, d.period) AS period, o.rev, o.orders, o.units, d.days FROM
    (SELECT festive_period AS period, SUM(net_before_tax) AS rev, COUNT(order_id) AS orders,
            SUM(total_qty) AS units FROM wide_orders WHERE {FULL} GROUP BY festive_period) o
    FULL OUTER JOIN
    (SELECT festive_period AS period, COUNT(DISTINCT date) AS days FROM dim_calendar
     WHERE {O.window_pred(P, col='date', start=P.data_start, end=P.last_day)} GROUP BY festive_period) d
    ON o.period = d.period),
allb AS (SELECT * FROM blocks UNION ALL
         SELECT 'All festive', SUM(rev), SUM(orders), SUM(units), SUM(days) FROM blocks
         WHERE period IN ({_FEST_NAMES})),
q7a AS (SELECT v.period, v.period_order, CAST(COALESCE(b.orders, 0) AS BIGINT) AS orders,
               CAST(COALESCE(b.days, 0) AS BIGINT) AS distinct_days, CAST(COALESCE(b.rev, 0) AS DOUBLE) AS revenue,
               CAST(COALESCE(b.units, 0) AS BIGINT) AS units
        FROM (VALUES {_VOCAB}) v(period, period_order) LEFT JOIN allb b ON v.period = b.period),
q7b AS (SELECT *, {O.safe_ratio('revenue', 'orders')} AS aov, {O.safe_ratio('units', 'orders')} AS units_per_order,
               {O.safe_ratio('revenue', 'distinct_days')} AS avg_revenue_per_day,
               {O.safe_ratio('orders', 'distinct_days')} AS avg_orders_per_day FROM q7a),
nrm AS (SELECT avg_revenue_per_day AS nr, avg_orders_per_day AS nor, aov AS na FROM q7b
        WHERE period = '{P.non_festive_label}')"""


@register("q7_festive_uplift", O.with_star(f"""
SELECT q7b.*,
  CASE WHEN period <> '{P.non_festive_label}' THEN {O.safe_ratio('avg_revenue_per_day', 'nr')} END
    AS revenue_uplift_vs_normal_x,
  CASE WHEN period <> '{P.non_festive_label}' THEN {O.safe_ratio('avg_orders_per_day', 'nor')} END
    AS orders_uplift_vs_normal_x,
  CASE WHEN period <> '{P.non_festive_label}' THEN {O.safe_ratio('aov', 'na')} END AS aov_uplift_vs_normal_x
FROM q7b, nrm""", extra_ctes=Q7_CTES))
def q7_festive_uplift(star, spark, sf_dir):
    """Q7 festive uplift per calendar day vs normal, periods + combined (A-29)."""
    return A.festive_uplift(star)


# --- marts (A-20 ... A-22) -----------------------------------------------------------
def _mart_sql(keys: list[str]) -> str:
    cols = ", ".join(keys)
    return O.with_star(f"""
SELECT {cols}, COUNT(*) AS orders, CAST(SUM(net_before_tax) AS DOUBLE) AS revenue_net,
       CAST(SUM(gross_bill_value) AS DOUBLE) AS revenue_gross, CAST(SUM(total_qty) AS BIGINT) AS units,
       {O.safe_ratio('SUM(net_before_tax)', 'COUNT(*)')} AS aov
FROM (SELECT f.*, s.store_name, s.city, s.region FROM fact_orders f JOIN dim_store s ON f.store_id = s.store_id) x
GROUP BY {cols}""")


@register("mart_store_month", _mart_sql(M.MART_KEYS["mart_store_month"]))
def mart_store_month(star, spark, sf_dir):
    """Store x month mart (A-20, S-11, J-02)."""
    return M.mart_store_month(star)


@register("mart_city_month", _mart_sql(M.MART_KEYS["mart_city_month"]))
def mart_city_month(star, spark, sf_dir):
    """City x month mart (A-21, S-11, J-02)."""
    return M.mart_city_month(star)


@register("mart_channel_month", _mart_sql(M.MART_KEYS["mart_channel_month"]))
def mart_channel_month(star, spark, sf_dir):
    """Channel x month mart (A-22, S-11, J-02)."""
    return M.mart_channel_month(star)


# --- metric query (A-01 ... A-11) ------------------------------------------------------
ORDER_METRIC_SQL = {
    "revenue": "CAST(COALESCE(SUM(net_before_tax), 0) AS DOUBLE)",
    "revenue_with_tax": "CAST(COALESCE(SUM(net_revenue), 0) AS DOUBLE)",
    "gross_revenue": "CAST(COALESCE(SUM(gross_bill_value), 0) AS DOUBLE)",
    "discount": "CAST(COALESCE(SUM(discount_amount), 0) AS DOUBLE)",
    "orders": "COUNT(order_id)",
    "units": "CAST(COALESCE(SUM(total_qty), 0) AS BIGINT)",
    "aov": O.safe_ratio("COALESCE(SUM(net_before_tax), 0)", "COUNT(order_id)"),
    "units_per_order": O.safe_ratio("COALESCE(SUM(total_qty), 0)", "COUNT(order_id)"),
}
LINE_METRIC_SQL = {
    "revenue": "CAST(COALESCE(SUM(line_net_value), 0) AS DOUBLE)",
    "orders": "COUNT(DISTINCT order_id)",
    "units": "CAST(COALESCE(SUM(quantity), 0) AS BIGINT)",
    "aov": O.safe_ratio("COALESCE(SUM(line_net_value), 0)", "COUNT(DISTINCT order_id)"),
    "units_per_order": O.safe_ratio("COALESCE(SUM(quantity), 0)", "COUNT(DISTINCT order_id)"),
    "gross_margin": "CAST(COALESCE(SUM(line_margin), 0) AS DOUBLE)",
    "margin_pct": O.pct_of("COALESCE(SUM(line_margin), 0)", "COALESCE(SUM(line_net_value), 0)"),
}


def _metric_sql(metrics: list[str], dims: list[str], grain: str, filters: dict | None = None,
                promo: bool = False, limit: int | None = None) -> str:
    table = "wide_orders" if grain == "order" else "wide_lines"
    defs = ORDER_METRIC_SQL if grain == "order" else LINE_METRIC_SQL
    src = table
    if promo:
        src = f"(SELECT o.*, p.promo_name, p.promo_type FROM {table} o LEFT JOIN dim_promotion p " \
              f"ON o.promo_id = p.promo_id)"
    where = [W]
    for k, v in (filters or {}).items():
        if isinstance(v, (list, tuple)):
            where.append(f"{k} IN ({', '.join(repr(x) for x in v)})")
        else:
            where.append(f"{k} = {v!r}")
    sel = ", ".join([*dims, *[f"{defs[m]} AS {m}" for m in metrics]])
    group = f" GROUP BY {', '.join(dims)}" if dims else ""
    body = f"SELECT {sel} FROM {src} x WHERE {' AND '.join(where)}{group}"
    if limit is not None:
        order = ", ".join([f"{metrics[0]} DESC", *[f"{d} ASC NULLS LAST" for d in dims]])
        body += f" ORDER BY {order} LIMIT {limit}"
    return O.with_star(body)


ALL_ORDER_METRICS = ["revenue", "revenue_with_tax", "gross_revenue", "discount", "orders", "units", "aov",
                     "units_per_order"]
ALL_LINE_METRICS = ["revenue", "orders", "units", "aov", "units_per_order", "gross_margin", "margin_pct"]
METRIC_CASES = {
    # name: (metrics, dimensions, filters, limit)
    "metric_all_order_metrics": (ALL_ORDER_METRICS, [], None, None),
    "metric_by_region": (ALL_ORDER_METRICS, ["region"], None, None),
    "metric_by_store_format": (["revenue", "orders", "aov"], ["store_format"], None, None),
    "metric_by_day_name": (["revenue", "orders", "aov"], ["day_name"], None, None),
    "metric_by_order_hour": (["revenue", "orders"], ["order_hour"], None, None),
    "metric_by_month_channel": (["revenue", "orders", "units_per_order"], ["month_key", "channel"], None, None),
    "metric_by_promo_name": (["revenue", "orders", "aov"], ["promo_name"], None, None),
    "metric_by_festive_period": (["revenue", "orders"], ["festive_period", "is_festive"], None, None),
    "metric_filtered_city_channel": (["revenue", "orders", "aov"], ["store_id"],
                                     {"city": P.extra.get("city", "ASIA"),
                                      "channel": list(P.delivery_channels)}, None),
    "metric_top_stores_capped": (["revenue", "orders"], ["store_id", "store_name"], None, 10),
    "metric_line_by_category": (ALL_LINE_METRICS, ["category"], None, None),
    "metric_line_by_veg": (ALL_LINE_METRICS, ["veg_nonveg"], None, None),
    "metric_line_margin_by_channel": (["gross_margin", "margin_pct", "revenue"], ["channel"], None, None),
}


def _metric_fn(metrics, dims, filters, limit):
    def fn(star, spark, sf_dir):
        """Metric query (A-01 ... A-11): window (P-01), equality/IN filters (P-05, P-06, P-08), filter then
        rank (P-09), dimension LEFT joins (J-01), daypart/weekday/veg/category breakdowns (A-44), F-18."""
        return metric_query(star, metrics, dims, window=star.profile.window(), filters=filters, limit=limit)
    return fn


for _name, (_m, _d, _f, _lim) in METRIC_CASES.items():
    from martlens.operators.metrics import choose_grain as _cg
    _g = _cg(_m, _d)
    _promo = any(x in ("promo_name", "promo_type") for x in _d)
    register(_name, _metric_sql(_m, _d, _g, _f, _promo, _lim))(_metric_fn(_m, _d, _f, _lim))


# --- distribution facts and shapes (A-37 ... A-47, W-02/W-03, L-05) ----------------------
@register("dimension_cardinalities", O.with_star("""
SELECT 'stores' AS name, COUNT(DISTINCT store_id) AS value FROM dim_store
UNION ALL SELECT 'cities', COUNT(DISTINCT city) FROM dim_store
UNION ALL SELECT 'regions', COUNT(DISTINCT region) FROM dim_store
UNION ALL SELECT 'products', COUNT(DISTINCT sku_id) FROM dim_product
UNION ALL SELECT 'categories', COUNT(DISTINCT category) FROM dim_product
UNION ALL SELECT 'customers', COUNT(DISTINCT customer_id) FROM dim_customer
UNION ALL SELECT 'promotions', COUNT(DISTINCT promo_id) FROM dim_promotion
UNION ALL SELECT 'calendar_days', COUNT(DISTINCT date) FROM dim_calendar
UNION ALL SELECT 'channels', COUNT(DISTINCT channel) FROM fact_orders
UNION ALL SELECT 'months', COUNT(DISTINCT month_key) FROM fact_orders"""))
def dimension_cardinalities(star, spark, sf_dir):
    """Exact distinct counts of ten dimensions (A-37)."""
    return A.dimension_cardinalities(star)


@register("headline_averages", O.with_star(f"""
SELECT {O.safe_ratio('COALESCE(SUM(net_before_tax), 0)', 'COUNT(order_id)')} AS aov,
       {O.safe_ratio('COALESCE(SUM(total_qty), 0)', 'COUNT(order_id)')} AS units_per_order FROM fact_orders"""))
def headline_averages(star, spark, sf_dir):
    """AOV and units per order over the whole order fact (A-38)."""
    return A.headline_averages(star)


@register("group_shares", O.with_star(f"""
SELECT total_orders, anonymous_orders, promoted_orders,
       {O.percentage4('anonymous_orders', 'total_orders')} AS anonymous_share_pct,
       {O.percentage4('promoted_orders', 'total_orders')} AS promoted_share_pct
FROM (SELECT COUNT(*) AS total_orders, COUNT(CASE WHEN customer_id IS NULL THEN 1 END) AS anonymous_orders,
             COUNT(CASE WHEN promo_id IS NOT NULL THEN 1 END) AS promoted_orders FROM fact_orders) x"""))
def group_shares(star, spark, sf_dir):
    """Anonymous and promoted order shares with counts (A-39, F-07)."""
    return A.group_shares(star)


@register("segment_breakdown", O.with_star(f"""
SELECT segment, {ORDER_AGGS.replace('SUM(net_before_tax) AS DOUBLE', 'COALESCE(SUM(net_before_tax), 0) AS DOUBLE')},
       {O.safe_ratio('COALESCE(SUM(net_before_tax), 0)', 'COUNT(order_id)')} AS aov,
       {O.safe_ratio('COALESCE(SUM(total_qty), 0)', 'COUNT(order_id)')} AS units_per_order
FROM (SELECT *, COALESCE(customer_segment, 'Anonymous') AS segment FROM wide_orders WHERE {W}) x GROUP BY segment"""))
def segment_breakdown(star, spark, sf_dir):
    """Customer segments with anonymous orders as their own group (A-42)."""
    return A.segment_breakdown(star)


@register("promotion_effectiveness", O.with_star(f"""
SELECT is_promo, promo_name, CAST(COALESCE(SUM(net_before_tax), 0) AS DOUBLE) AS revenue, COUNT(order_id) AS orders,
       CAST(COALESCE(SUM(total_qty), 0) AS BIGINT) AS units,
       {O.safe_ratio('COALESCE(SUM(net_before_tax), 0)', 'COUNT(order_id)')} AS aov,
       {O.safe_ratio('COALESCE(SUM(total_qty), 0)', 'COUNT(order_id)')} AS units_per_order,
       CAST(COALESCE(SUM(discount_amount), 0) AS DOUBLE) AS discount
FROM (SELECT o.*, CAST(o.promo_id IS NOT NULL AS INTEGER) AS is_promo,
             COALESCE(p.promo_name, 'No promotion') AS promo_name
      FROM wide_orders o LEFT JOIN dim_promotion p ON o.promo_id = p.promo_id WHERE {W}) x
GROUP BY is_promo, promo_name"""))
def promotion_effectiveness(star, spark, sf_dir):
    """Promoted vs non-promoted orders, per promotion (A-43)."""
    return A.promotion_effectiveness(star)


_DELIV = ", ".join(f"'{c}'" for c in P.delivery_channels)


@register("delivery_share", O.with_star(f"""
SELECT channel_group, CAST(COALESCE(p, 0) AS DOUBLE) AS part_revenue, CAST(COALESCE(w, 0) AS DOUBLE) AS whole_revenue,
       {O.pct_of('CAST(COALESCE(p, 0) AS DOUBLE)', 'CAST(COALESCE(w, 0) AS DOUBLE)')} AS pct_of_total
FROM (SELECT CASE WHEN channel IN ({_DELIV}) THEN 'Delivery' ELSE channel END AS channel_group,
             SUM(net_before_tax) AS p FROM wide_orders WHERE {W} GROUP BY 1) g,
     (SELECT SUM(net_before_tax) AS w FROM wide_orders WHERE {W}) t"""))
def delivery_share(star, spark, sf_dir):
    """Delivery channels grouped as one, with percent of total (A-45, W-05)."""
    return A.delivery_share(star)


@register("entity_profile_store", O.with_star(f"""
SELECT store_id, revenue, peer_avg_revenue, revenue - peer_avg_revenue AS diff_vs_peer
FROM (SELECT store_id, CAST(COALESCE(SUM(net_before_tax), 0) AS DOUBLE) AS revenue FROM wide_orders WHERE {W}
      GROUP BY store_id) g,
     (SELECT AVG(revenue) AS peer_avg_revenue FROM (SELECT CAST(COALESCE(SUM(net_before_tax), 0) AS DOUBLE)
        AS revenue FROM wide_orders WHERE {W} GROUP BY store_id) y) a"""))
def entity_profile_store(star, spark, sf_dir):
    """Store revenue with the peer average and the difference (A-46, W-06)."""
    return A.entity_profile(star, "store_id")


@register("two_store_comparison", O.with_star(f"""
SELECT month_key, CAST(COALESCE(SUM(CASE WHEN store_id = 'ST001' THEN net_before_tax END), 0) AS DOUBLE) AS revenue_a,
       CAST(COALESCE(SUM(CASE WHEN store_id = 'ST002' THEN net_before_tax END), 0) AS DOUBLE) AS revenue_b,
       CAST(COALESCE(SUM(CASE WHEN store_id = 'ST001' THEN net_before_tax END), 0) AS DOUBLE)
       - CAST(COALESCE(SUM(CASE WHEN store_id = 'ST002' THEN net_before_tax END), 0) AS DOUBLE) AS difference
FROM wide_orders WHERE {W} AND store_id IN ('ST001', 'ST002') GROUP BY month_key"""))
def two_store_comparison(star, spark, sf_dir):
    """Two stores side by side by month with the difference (A-47)."""
    return A.two_entity_comparison(star, "ST001", "ST002")


@register("top3_stores_per_month", O.with_star(f"""
SELECT * FROM (SELECT month_key, store_id, revenue,
                      row_number() OVER (PARTITION BY month_key ORDER BY revenue DESC, store_id) AS rank_in_month
               FROM (SELECT month_key, store_id, CAST(COALESCE(SUM(net_before_tax), 0) AS DOUBLE) AS revenue
                     FROM wide_orders WHERE {W} GROUP BY month_key, store_id) g) x WHERE rank_in_month <= 3"""))
def top3_stores_per_month(star, spark, sf_dir):
    """Top 3 stores inside every month (L-05)."""
    return A.top_k_per_month(star, "store_id", 3)


@register("city_month_over_month", O.with_star("""
SELECT city, month_key, revenue, prev_revenue,
       CASE WHEN prev_revenue <> 0 THEN (revenue - prev_revenue) * 100.0 / prev_revenue END AS mom_pct
FROM (SELECT city, month_key, CAST(COALESCE(SUM(net_before_tax), 0) AS DOUBLE) AS revenue,
             LAG(CAST(COALESCE(SUM(net_before_tax), 0) AS DOUBLE)) OVER (PARTITION BY city ORDER BY month_key)
               AS prev_revenue
      FROM (SELECT f.*, s.city FROM fact_orders f JOIN dim_store s ON f.store_id = s.store_id) x
      GROUP BY city, month_key) y"""))
def city_month_over_month(star, spark, sf_dir):
    """Previous month and month-over-month % on the city mart (W-02, W-03)."""
    return A.month_over_month(star, "city")


@register("metric_by_city_from_mart", _metric_sql(["revenue", "orders", "units", "aov", "units_per_order"],
                                                   ["city"], "order"))
def metric_by_city_from_mart(star, spark, sf_dir):
    """Metric query routed to the city x month mart, month-key range (A-11, A-21, P-03)."""
    return metric_query(star, ["revenue", "orders", "units", "aov", "units_per_order"], ["city"],
                        window=star.profile.window(), use_marts=True)


@register("metric_by_channel_month_from_mart", _metric_sql(["revenue", "gross_revenue", "orders"],
                                                            ["channel", "month_key"], "order"))
def metric_by_channel_month_from_mart(star, spark, sf_dir):
    """Metric query routed to the channel x month mart (A-11, A-22)."""
    return metric_query(star, ["revenue", "gross_revenue", "orders"], ["channel", "month_key"],
                        window=star.profile.window(), use_marts=True)
