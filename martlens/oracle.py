"""DuckDB renderings of the star binding and of each registered query (S-14).

These strings are the independent second implementation every registered
Spark query is checked against: the same role binding written as SQL over the
raw testdata tables (pre-registered views ``orders``, ``lineitem``, ...).
Output conventions match the Spark side: money as DOUBLE converted from exact
DECIMAL sums, counts as BIGINT, dates as DATE, no rounding of doubles.
"""

from __future__ import annotations

from martlens.profile import TESTDATA, Profile


def _festive_case(col: str, p: Profile) -> str:
    parts = []
    for fp in p.festive_periods:
        md = f"strftime({col}, '%m-%d')"
        if fp.start_mmdd <= fp.end_mmdd:
            cond = f"{md} BETWEEN '{fp.start_mmdd}' AND '{fp.end_mmdd}'"
        else:
            cond = f"({md} >= '{fp.start_mmdd}' OR {md} <= '{fp.end_mmdd}')"
        parts.append(f"WHEN {cond} THEN '{fp.name}'")
    return f"CASE {' '.join(parts)} ELSE '{p.non_festive_label}' END"


def star_ctes(p: Profile = TESTDATA) -> str:
    """CTEs: dim_store, cust_geo, dim_customer, dim_product, dim_calendar,
    dim_promotion, wide_orders, fact_orders, wide_lines, fact_order_lines."""
    fest_o = _festive_case("o.order_date", p)
    fest_c = _festive_case("d", p)
    return f"""
geo AS (
  SELECT n.n_nationkey,
         'ST' || lpad(CAST(n.n_nationkey AS VARCHAR), CAST(greatest(3, length(CAST(n.n_nationkey AS VARCHAR))) AS INTEGER), '0')
           AS store_id,
         n.n_name AS store_name, r.r_name AS city, n.n_name AS state, r.r_name AS region,
         (['Mall', 'High Street', 'Food Court'])[CAST(n.n_nationkey % 3 + 1 AS INTEGER)] AS store_format
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
dim_store AS (
  SELECT store_id, store_name, city, state, region, store_format, DATE '{p.data_start}' AS opening_date,
         1.0 AS city_price_index, 1.0 AS performance_factor, 'Active' AS status FROM geo),
cust_geo AS (
  SELECT c.c_custkey, g.store_id, g.store_name, g.city, g.region, g.store_format, c.c_mktsegment
  FROM customer c LEFT JOIN geo g ON c.c_nationkey = g.n_nationkey),
dim_customer AS (
  SELECT c_custkey AS customer_id, city AS home_city, c_mktsegment AS customer_segment,
         DATE '{p.data_start}' AS join_date FROM cust_geo),
dim_product AS (
  SELECT 'SKU' || CAST(p_partkey AS VARCHAR) AS sku_id, p_name AS sku_name, p_type AS category,
         CASE WHEN p_size % 2 = 0 THEN 'Veg' ELSE 'Non-Veg' END AS veg_nonveg,
         CAST(p_retailprice AS DECIMAL(18,2)) AS base_price_inr,
         CAST(p_size + 20 AS DOUBLE) / 100.0 AS est_cogs_pct, 'Active' AS status FROM part),
cal_days AS (
  SELECT CAST(d AS DATE) AS d FROM range(DATE '{p.data_start}', DATE '{p.last_day}' + INTERVAL 1 DAY,
                                         INTERVAL 1 DAY) t(d)),
dim_calendar AS (
  SELECT d AS date, year(d) AS year, monthname(d) AS month, month(d) AS month_no, dayname(d) AS day_name,
         CASE WHEN dayname(d) IN ('Saturday', 'Sunday') THEN 'Weekend' ELSE 'Weekday' END AS day_type,
         {fest_c} AS festive_period, strftime(d, '%Y-%m') AS month_key,
         CAST(dayname(d) IN ('Saturday', 'Sunday') AS INTEGER) AS is_weekend,
         CAST(({fest_c}) <> '{p.non_festive_label}' AS INTEGER) AS is_festive
  FROM cal_days),
dim_promotion AS (
  SELECT * FROM (VALUES ('PR001', 'Festive Feast', 'Percentage'), ('PR002', 'Weekday Saver', 'Percentage'),
                        ('PR003', 'Combo Deal', 'Flat'), ('PR004', 'Happy Hours', 'Percentage'),
                        ('PR005', 'First Order', 'Flat'), ('PR006', 'Loyalty Bonus', 'Flat'))
         t(promo_id, promo_name, promo_type)),
line_qty AS (SELECT l_orderkey, SUM(l_quantity) AS q FROM lineitem GROUP BY l_orderkey),
o_base AS (
  SELECT o.o_orderkey AS order_id, o.o_orderdate AS order_datetime, CAST(o.o_orderdate AS DATE) AS order_date,
         CAST(hour(o.o_orderdate) AS INTEGER) AS order_hour, cg.store_id,
         CASE WHEN o.o_orderkey % 25 < 7 THEN NULL ELSE o.o_custkey END AS customer_id,
         o.o_orderpriority AS channel,
         CASE WHEN o.o_orderkey % 25 = 24 THEN 'PR' || lpad(CAST(o.o_orderkey % 6 + 1 AS VARCHAR), 3, '0') END
           AS promo_id,
         CAST(COALESCE(lq.q, 0) AS BIGINT) AS total_qty,
         CAST(o.o_totalprice AS DECIMAL(18,2)) AS net_before_tax,
         cg.store_name, cg.city, cg.region, cg.store_format, cg.c_mktsegment
  FROM orders o LEFT JOIN cust_geo cg ON o.o_custkey = cg.c_custkey
                LEFT JOIN line_qty lq ON o.o_orderkey = lq.l_orderkey),
o_money AS (
  SELECT *, CASE WHEN promo_id IS NOT NULL THEN CAST(round(net_before_tax * 0.10, 2) AS DECIMAL(18,2))
                 ELSE CAST(0 AS DECIMAL(18,2)) END AS discount_amount,
         CAST(round(net_before_tax * 0.05, 2) AS DECIMAL(18,2)) AS tax_amount
  FROM o_base),
wide_orders AS (
  SELECT order_id, order_datetime, order_date, order_hour, store_id, customer_id, channel, promo_id, total_qty,
         CAST(net_before_tax + discount_amount AS DECIMAL(18,2)) AS gross_bill_value, discount_amount,
         net_before_tax, tax_amount, CAST(net_before_tax + tax_amount AS DECIMAL(18,2)) AS net_revenue,
         strftime(order_date, '%Y-%m') AS month_key, dayname(order_date) AS day_name,
         CASE WHEN dayname(order_date) IN ('Saturday', 'Sunday') THEN 'Weekend' ELSE 'Weekday' END AS day_type,
         CAST(dayname(order_date) IN ('Saturday', 'Sunday') AS INTEGER) AS is_weekend,
         {fest_o.replace('o.order_date', 'order_date')} AS festive_period,
         CAST(({fest_o.replace('o.order_date', 'order_date')}) <> '{p.non_festive_label}' AS INTEGER) AS is_festive,
         store_name, city, region, store_format,
         CASE WHEN customer_id IS NOT NULL THEN c_mktsegment END AS customer_segment
  FROM o_money),
fact_orders AS (
  SELECT order_id, order_datetime, order_date, order_hour, store_id, customer_id, channel, promo_id, total_qty,
         gross_bill_value, discount_amount, net_before_tax, tax_amount, net_revenue, month_key, day_name,
         day_type, is_weekend, festive_period, is_festive FROM wide_orders),
l_base AS (
  SELECT l.l_orderkey AS order_id, 'SKU' || CAST(l.l_partkey AS VARCHAR) AS sku_id,
         CAST(l.l_quantity AS BIGINT) AS quantity, CAST(p.p_retailprice AS DECIMAL(18,2)) AS unit_price,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS line_gross_value,
         CAST(round(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(18,2)), 2)
              AS DECIMAL(18,2)) AS line_discount,
         p.p_size, p.p_name AS sku_name, p.p_type AS category,
         CASE WHEN p.p_size % 2 = 0 THEN 'Veg' ELSE 'Non-Veg' END AS veg_nonveg
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey),
l_net AS (
  SELECT *, CAST(line_gross_value - line_discount AS DECIMAL(18,2)) AS line_net_value FROM l_base),
l_cogs AS (
  SELECT *, CAST(round(line_net_value * (CAST(p_size + 20 AS DECIMAL(10,0)) * 0.01), 2) AS DECIMAL(18,2))
           AS est_cogs FROM l_net),
fact_order_lines AS (
  SELECT order_id, sku_id, quantity, unit_price, line_gross_value, line_discount, line_net_value, est_cogs,
         CAST(line_net_value - est_cogs AS DECIMAL(18,2)) AS line_margin, sku_name, category, veg_nonveg
  FROM l_cogs),
wide_lines AS (
  SELECT fl.*, fo.order_date, fo.month_key, fo.store_id, fo.channel
  FROM fact_order_lines fl LEFT JOIN fact_orders fo ON fl.order_id = fo.order_id)"""


def with_star(body: str, p: Profile = TESTDATA, extra_ctes: str = "") -> str:
    ctes = star_ctes(p)
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"WITH {ctes}\n{body}"


# --- shared SQL fragments ------------------------------------------------------
def money(expr: str) -> str:
    return f"CAST(COALESCE({expr}, 0) AS DOUBLE)"


def safe_ratio(n: str, d: str) -> str:
    return f"(CASE WHEN CAST({d} AS DOUBLE) = 0 THEN 0.0 ELSE CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) END)"


def pct_of(n: str, d: str) -> str:
    return (f"(CASE WHEN CAST({d} AS DOUBLE) = 0 THEN 0.0 "
            f"ELSE CAST({n} AS DOUBLE) * 100.0 / CAST({d} AS DOUBLE) END)")


def pct_change(old: str, new: str) -> str:
    return (f"(CASE WHEN CAST({old} AS DOUBLE) = 0 THEN 0.0 "
            f"ELSE (CAST({new} AS DOUBLE) - CAST({old} AS DOUBLE)) / CAST({old} AS DOUBLE) * 100.0 END)")


def percentage4(part: str, whole: str) -> str:
    """Half-up rounding to 4 decimals of 100*part/whole in exact integer arithmetic."""
    return (f"(CASE WHEN {whole} = 0 THEN 0.0 ELSE CAST((CAST({part} AS HUGEINT) * 2000000 + {whole}) "
            f"// (CAST({whole} AS HUGEINT) * 2) AS DOUBLE) / 10000.0 END)")


def window_pred(p: Profile = TESTDATA, col: str = "order_date", start=None, end=None) -> str:
    s, e = start or p.window_start, end or p.window_end
    return f"{col} BETWEEN DATE '{s}' AND DATE '{e}'"
