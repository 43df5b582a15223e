"""Registered trend / decline / diagnosis queries (Q5, Q8, A-23 ... A-36, A-48, W-04)."""

from __future__ import annotations

from martlens import oracle as O
from martlens.plans import decline as D
from martlens.profile import TESTDATA as P
from martlens.registry import register

W = O.window_pred(P)
MONTHS = P.window().months()
MC = [D.month_col(m) for m in MONTHS]
PRIOR_S, PRIOR_E = P.prior_bounds()


def _chain(op: str) -> str:
    return " AND ".join(f"{a} {op} {b}" for a, b in zip(MC, MC[1:])) or "TRUE"


def trend_sql(index: list[str]) -> str:
    cols = ", ".join(index)
    sums = ", ".join(f"COALESCE(SUM(CASE WHEN month_key = '{m}' THEN net_before_tax END), 0) AS {c}"
                     for m, c in zip(MONTHS, MC))
    f, l_ = MC[0], MC[-1]
    return f"""t0_{index[0]} AS (SELECT {cols}, {sums} FROM wide_orders WHERE {W} GROUP BY {cols}),
trend_{index[0]} AS (
  SELECT {cols}, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MC)},
         CAST({f} AS DOUBLE) AS first_month_revenue, CAST({l_} AS DOUBLE) AS last_month_revenue,
         CAST({l_} - {f} AS DOUBLE) AS change, {O.pct_change(f, l_)} AS change_pct,
         CAST({_chain('>')} AS INTEGER) AS strictly_declining, CAST({_chain('<')} AS INTEGER) AS strictly_rising,
         CAST({l_} < {f} AS INTEGER) AS last_below_first
  FROM t0_{index[0]})"""


def _trend_query(index: list[str]) -> str:
    return O.with_star(f"SELECT * FROM trend_{index[0]}", extra_ctes=trend_sql(index))


@register("q5_city_trend", _trend_query(["city"]))
def q5_city_trend(star, spark, sf_dir):
    """Q5 monotonic decline by city: monthly pivot, change, strict flags (A-23, A-24, A-25)."""
    return D.trend_table(star, ["city"])


@register("trend_by_channel", _trend_query(["channel"]))
def trend_by_channel(star, spark, sf_dir):
    """Strict decline / improvement by channel (A-24, A-25)."""
    return D.trend_table(star, ["channel"])


@register("trend_by_segment", _trend_query(["customer_segment"]))
def trend_by_segment(star, spark, sf_dir):
    """Strict decline by customer segment, anonymous orders as the NULL group (A-24)."""
    return D.trend_table(star, ["customer_segment"])


def dvb_sql(index: list[str], name: str = "dvb") -> str:
    cols = ", ".join(index)
    in_w = W
    in_b = O.window_pred(P, start=PRIOR_S, end=PRIOR_E)
    lo = O.window_pred(P, start=min(PRIOR_S, P.window_start), end=max(PRIOR_E, P.window_end))
    sums = ", ".join(f"COALESCE(SUM(CASE WHEN {in_w} AND month_key = '{m}' THEN net_before_tax END), 0) AS {c}"
                     for m, c in zip(MONTHS, MC))
    return f"""{name}0 AS (
  SELECT {cols}, {sums}, COALESCE(SUM(CASE WHEN {in_w} THEN net_before_tax END), 0) AS win,
         COALESCE(SUM(CASE WHEN {in_b} THEN net_before_tax END), 0) AS base,
         COUNT(CASE WHEN {in_w} THEN 1 END) AS nw
  FROM wide_orders WHERE {lo} GROUP BY {cols}),
{name} AS (
  SELECT {cols}, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MC)},
         CAST({_chain('>')} AS INTEGER) AS strictly_declining,
         CAST(win AS DOUBLE) AS window_revenue, CAST(base AS DOUBLE) AS baseline_revenue,
         CAST(win - base AS DOUBLE) AS delta_abs, {O.pct_change('base', 'win')} AS delta_pct,
         CAST(win > base AS INTEGER) AS is_above_baseline
  FROM {name}0 WHERE nw > 0)"""


@register("decline_vs_baseline_store", O.with_star("SELECT * FROM dvb", extra_ctes=dvb_sql(["store_id"])))
def decline_vs_baseline_store(star, spark, sf_dir):
    """Strict decline and baseline comparison on one row per store, one pass (A-26, A-27, P-10)."""
    return D.decline_vs_baseline(star, ["store_id"])


@register("decline_vs_baseline_region", O.with_star("SELECT * FROM dvb", extra_ctes=dvb_sql(["region"])))
def decline_vs_baseline_region(star, spark, sf_dir):
    """Decliner vs reverter split by region (A-27)."""
    return D.decline_vs_baseline(star, ["region"])


_SPINE_VALUES = ", ".join(f"({i}, '{m}')" for i, m in enumerate(MONTHS))


@register("w04_city_decline_by_lag", O.with_star(f"""
SELECT city, COALESCE(MIN(CASE WHEN prev IS NOT NULL THEN CAST(rev < prev AS INTEGER) END), 1) AS strictly_declining
FROM (SELECT s.city, s.month_key, COALESCE(g.rev, 0) AS rev,
             LAG(COALESCE(g.rev, 0)) OVER (PARTITION BY s.city ORDER BY s.month_key) AS prev
      FROM (SELECT c.city, m.month_key FROM (SELECT DISTINCT city FROM wide_orders WHERE {W}) c,
                   (VALUES {_SPINE_VALUES}) m(i, month_key)) s
      LEFT JOIN (SELECT city, month_key, SUM(net_before_tax) AS rev FROM wide_orders WHERE {W}
                 GROUP BY city, month_key) g ON s.city = g.city AND s.month_key = g.month_key) x
GROUP BY city"""))
def w04_city_decline_by_lag(star, spark, sf_dir):
    """Consecutive-month decline via LAG over a city x month spine (W-04, J-06)."""
    return D.consecutive_decline_by_window(star, "city")


STORE_DECLINE = trend_sql(["store_id", "store_name", "city", "region"]) + f""",
sd AS (SELECT store_id, store_name, city, region, {", ".join(MC)},
              {" + ".join(MC)} AS window_revenue, change, change_pct, strictly_declining AS declined_every_month
       FROM trend_store_id)"""


@register("q8_store_decline", O.with_star("SELECT * FROM sd", extra_ctes=STORE_DECLINE))
def q8_store_decline(star, spark, sf_dir):
    """Q8 store decline table: monthly values, window revenue, change, declined flag (A-30)."""
    return D.store_decline(star)


DIAG_MONTHLY = STORE_DECLINE + f""",
spine AS (SELECT s.store_id, s.store_name, s.city, s.region, m.month_idx, m.month_key
          FROM sd s, (VALUES {_SPINE_VALUES}) m(month_idx, month_key) WHERE s.declined_every_month = 1),
sm AS (SELECT store_id, month_key, SUM(net_before_tax) AS rev, COUNT(order_id) AS orders, SUM(total_qty) AS units,
              COUNT(DISTINCT customer_id) AS cust
       FROM wide_orders WHERE {W} GROUP BY store_id, month_key),
dm0 AS (SELECT sp.*, CAST(COALESCE(sm.rev, 0) AS DOUBLE) AS revenue, COALESCE(sm.orders, 0) AS orders,
               CAST(COALESCE(sm.units, 0) AS BIGINT) AS units, COALESCE(sm.cust, 0) AS distinct_identified_customers
        FROM spine sp LEFT JOIN sm ON sp.store_id = sm.store_id AND sp.month_key = sm.month_key),
dm AS (SELECT dm0.*, {O.safe_ratio('revenue', 'orders')} AS aov, {O.safe_ratio('units', 'orders')} AS units_per_order
       FROM dm0)"""


@register("q8_diagnostics_monthly", O.with_star("SELECT * FROM dm", extra_ctes=DIAG_MONTHLY))
def q8_diagnostics_monthly(star, spark, sf_dir):
    """Q8 store x month spine for declining stores, zero-filled (A-31)."""
    return D.diagnostics_monthly(star)


CHANNEL_ATTR = f"""
ch0 AS (SELECT store_id, channel, {", ".join(
    f"COALESCE(SUM(CASE WHEN month_key = '{m}' THEN net_before_tax END), 0) AS {c}" for m, c in zip(MONTHS, MC))}
        FROM wide_orders WHERE {W} GROUP BY store_id, channel),
ch AS (SELECT store_id, channel, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MC)},
              CAST({MC[-1]} - {MC[0]} AS DOUBLE) AS change_inr, {O.pct_change(MC[0], MC[-1])} AS change_pct,
              CAST({_chain('>')} AS INTEGER) AS strictly_declining FROM ch0)"""


@register("q8_channel_attribution", O.with_star("SELECT * FROM ch", extra_ctes=CHANNEL_ATTR))
def q8_channel_attribution(star, spark, sf_dir):
    """Per (store, channel) monthly revenue, change and strict decline (A-34)."""
    return D.channel_attribution(star)


_F, _L = MONTHS[0], MONTHS[-1]
DIAGNOSIS = DIAG_MONTHLY + "," + CHANNEL_ATTR + "," + trend_sql(["city"]) + f""",
fl AS (SELECT store_id,
         MAX(CASE WHEN month_key = '{_F}' THEN orders END) AS n0, MAX(CASE WHEN month_key = '{_L}' THEN orders END) AS n1,
         MAX(CASE WHEN month_key = '{_F}' THEN aov END) AS aov0, MAX(CASE WHEN month_key = '{_L}' THEN aov END) AS aov1,
         MAX(CASE WHEN month_key = '{_F}' THEN units_per_order END) AS upo0,
         MAX(CASE WHEN month_key = '{_L}' THEN units_per_order END) AS upo1,
         MAX(CASE WHEN month_key = '{_F}' THEN distinct_identified_customers END) AS c0,
         MAX(CASE WHEN month_key = '{_L}' THEN distinct_identified_customers END) AS c1
       FROM dm GROUP BY store_id),
worst AS (SELECT store_id, channel AS worst_channel, change_inr AS worst_channel_change
          FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY change_inr, channel) AS rn FROM ch) x
          WHERE rn = 1),
pr AS (SELECT store_id, SUM(net_before_tax) AS prior FROM wide_orders
       WHERE {O.window_pred(P, start=PRIOR_S, end=PRIOR_E)} GROUP BY store_id),
j AS (SELECT sd.*, fl.n0, fl.n1, fl.aov0, fl.aov1, fl.upo0, fl.upo1, fl.c0, fl.c1, w.worst_channel,
             w.worst_channel_change, CAST(COALESCE(pr.prior, 0) AS DOUBLE) AS prior_d,
             ct.change_pct AS city_change_pct, ct.strictly_declining AS city_strictly_declining,
             aov0 * CAST(n1 - n0 AS DOUBLE) AS oe, CAST(n0 AS DOUBLE) * (aov1 - aov0) AS ae
      FROM sd LEFT JOIN fl ON sd.store_id = fl.store_id LEFT JOIN worst w ON sd.store_id = w.store_id
              LEFT JOIN pr ON sd.store_id = pr.store_id LEFT JOIN trend_city ct ON sd.city = ct.city
      WHERE sd.declined_every_month = 1)"""

DIAGNOSIS_SELECT = f"""
SELECT store_id, store_name, city, region, window_revenue, change AS revenue_change, change_pct,
       {O.pct_change('n0', 'n1')} AS orders_change_pct, {O.pct_change('aov0', 'aov1')} AS aov_change_pct,
       {O.pct_change('upo0', 'upo1')} AS units_per_order_change_pct,
       {O.pct_change('c0', 'c1')} AS identified_customers_change_pct,
       oe AS orders_effect, ae AS aov_effect,
       CASE WHEN abs(oe) >= abs(ae) THEN 'order volume' ELSE 'basket size' END AS primary_driver,
       worst_channel, worst_channel_change,
       CAST(COALESCE(worst_channel IS NOT NULL AND change < 0
                     AND {O.safe_ratio('worst_channel_change', 'change')} >= 0.5, FALSE) AS INTEGER)
         AS decline_concentrated_in_one_channel,
       prior_d AS prior_revenue, window_revenue - prior_d AS vs_prior_change,
       {O.pct_change('prior_d', 'window_revenue')} AS vs_prior_change_pct,
       CAST(window_revenue < prior_d AS INTEGER) AS is_break_in_trend,
       city_change_pct, city_strictly_declining,
       CASE WHEN city_strictly_declining = 1 THEN 'market-wide' ELSE 'store-specific' END AS market_context
FROM j"""


@register("q8_store_diagnosis", O.with_star(DIAGNOSIS_SELECT, extra_ctes=DIAGNOSIS))
def q8_store_diagnosis(star, spark, sf_dir):
    """Q8 flagship: one row per declining store (A-30 ... A-36): change percentages (A-32, F-05), volume/basket
    decomposition (A-33), channel attribution (A-34), prior window (A-35), market context (A-36), sorted by change
    (L-03)."""
    return D.store_diagnosis(star)


_FLAGS = ["strictly_declining", "is_above_baseline"]
_FLAG_VOCAB = ", ".join(f"('{f}', {v})" for f in _FLAGS for v in (1, 0))


@register("flag_membership_store", O.with_star(f"""
SELECT flag, value, CAST(SUM(n_members) AS BIGINT) AS n_members, MAX(labels) AS labels
FROM (SELECT v.flag, v.value, 0 AS n_members, '' AS labels FROM (VALUES {_FLAG_VOCAB}) v(flag, value)
UNION ALL (SELECT flag, value, COUNT(*) AS n_members,
                  array_to_string(list_slice(list_sort(list(DISTINCT label)), 1, 50), ',') AS labels
           FROM ({" UNION ALL ".join(f"SELECT CAST(store_id AS VARCHAR) AS label, '{f}' AS flag, {f} AS value FROM dvb"
                                     for f in _FLAGS)}) x
           GROUP BY flag, value)) g GROUP BY flag, value""", extra_ctes=dvb_sql(["store_id"])))
def flag_membership_store(star, spark, sf_dir):
    """Labels per flag value (decliners / above baseline), both groups always present (A-48)."""
    return D.flag_membership(D.decline_vs_baseline(star, ["store_id"]), "store_id", _FLAGS)
