"""Registered set operations, comparisons, ad hoc SQL, previews and text functions over real tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from martlens import oracle as O
from martlens.functions import scalars as S
from martlens.functions import text as X
from martlens.operators import compare as D
from martlens.operators import distinct as X2
from martlens.operators import sets as U
from martlens.operators.marts import build_marts
from martlens.operators.metrics import in_window
from martlens.operators.numbering import numbered
from martlens.plans import analyses as A
from martlens.plans import decline as DC
from martlens.plans import entities as E
from martlens.profile import TESTDATA as P
from martlens.queries.core import Q2_BASE, Q4_BASE
from martlens.queries.decline import dvb_sql, trend_sql
from martlens.queries.quality import _mart_cte
from martlens.registry import register
from martlens.sources.sinks import preview

W = O.window_pred(P)
PW = O.window_pred(P, start=P.prior_bounds()[0], end=P.prior_bounds()[1])
MARTS = ",\n".join([_mart_cte("mart_store_month", ["store_id", "store_name", "city", "region", "month_key"]),
                    _mart_cte("mart_city_month", ["city", "month_key"]),
                    _mart_cte("mart_channel_month", ["channel", "month_key"])])


# --- U-01 ... U-04 ----------------------------------------------------------------------------
@register("u01_top_and_bottom_stores", O.with_star("""
SELECT *, 'a' AS part FROM (SELECT * FROM ranked ORDER BY revenue DESC, store_id LIMIT 5) t
UNION ALL SELECT *, 'b' AS part FROM (SELECT * FROM ranked ORDER BY revenue ASC, store_id DESC LIMIT 5) b""",
                                                   extra_ctes=Q2_BASE))
def u01_top_and_bottom_stores(star, spark, sf_dir):
    """Top-5 and bottom-5 siblings concatenated after a column-set check (U-01)."""
    return U.union_same_signature(A.top_stores(star), A.bottom_stores(star), tag="part")


@register("u02_stores_in_window_or_prior", O.with_star(f"""
SELECT store_id FROM wide_orders WHERE {W} UNION SELECT store_id FROM wide_orders WHERE {PW}"""))
def u02_stores_in_window_or_prior(star, spark, sf_dir):
    """Distinct stores trading in the window or the prior window (U-02)."""
    w, p = P.window(), P.prior()
    a = A.window_orders(star, w).select("store_id")
    b = A.window_orders(star, p).select("store_id")
    return U.union_distinct(a, b)


@register("u03_months_outside_calendar", O.with_star("""
SELECT DISTINCT f.month_key FROM fact_orders f WHERE NOT EXISTS
  (SELECT 1 FROM dim_calendar c WHERE c.month_key IS NOT DISTINCT FROM f.month_key)"""))
def u03_months_outside_calendar(star, spark, sf_dir):
    """Observed month keys missing from the calendar vocabulary (U-03)."""
    return U.difference(star.fact_orders.select("month_key"), star.dim_calendar.select("month_key"), ["month_key"])


_SPINE = ", ".join(f"('{m}')" for m in P.window().months())
LAG_DECL = f"""lag_decl AS (
  SELECT city FROM (
    SELECT city, COALESCE(MIN(CASE WHEN prev IS NOT NULL THEN CAST(rev < prev AS INTEGER) END), 1) AS sd
    FROM (SELECT s.city, s.month_key, COALESCE(g.rev, 0) AS rev,
                 LAG(COALESCE(g.rev, 0)) OVER (PARTITION BY s.city ORDER BY s.month_key) AS prev
          FROM (SELECT c.city, m.month_key FROM (SELECT DISTINCT city FROM wide_orders WHERE {W}) c,
                       (VALUES {_SPINE}) m(month_key)) s
          LEFT JOIN (SELECT city, month_key, SUM(net_before_tax) AS rev FROM wide_orders WHERE {W}
                     GROUP BY city, month_key) g ON s.city = g.city AND s.month_key = g.month_key) x
    GROUP BY city) y WHERE sd = 1)"""


@register("u04_decliners_two_ways", O.with_star("""
SELECT only_left, only_right, (only_left = 0 AND only_right = 0) AS equal FROM (
SELECT (SELECT COUNT(*) FROM (SELECT city FROM trend_city WHERE strictly_declining = 1
                              EXCEPT SELECT city FROM lag_decl) a) AS only_left,
       (SELECT COUNT(*) FROM (SELECT city FROM lag_decl
                              EXCEPT SELECT city FROM trend_city WHERE strictly_declining = 1) b) AS only_right) z""", extra_ctes=trend_sql(["city"]) + ",\n" + LAG_DECL))
def u04_decliners_two_ways(star, spark, sf_dir):
    """The strict-decline set from the pivot and from LAG must be equal (U-04, A-24 vs W-04)."""
    a = DC.trend_table(star, ["city"]).filter(F.col("strictly_declining") == 1).select("city")
    b = DC.consecutive_decline_by_window(star, "city").filter(F.col("strictly_declining") == 1).select("city")
    return U.set_equality(a, b, ["city"])


# --- D-01 / D-02 / D-04 -----------------------------------------------------------------------------
RECONCILE_CTES = MARTS + """,
rl AS (SELECT city, month_key, CAST(revenue_net AS DOUBLE) AS revenue, CAST(orders AS DOUBLE) AS orders
       FROM mart_city_month),
rr AS (SELECT city, month_key, CAST(SUM(net_before_tax) AS DOUBLE) AS revenue, CAST(COUNT(order_id) AS DOUBLE) AS orders
       FROM wide_orders GROUP BY city, month_key),
rj AS (SELECT rl.revenue AS lr, rr.revenue AS rrv, rl.orders AS lo, rr.orders AS ro,
              rl.city IS NULL AS ml, rr.city IS NULL AS mr
       FROM rl FULL OUTER JOIN rr ON rl.city = rr.city AND rl.month_key = rr.month_key)"""


def _rec_sql(name: str, lc: str, rc: str, tol: float) -> str:
    both = "NOT ml AND NOT mr"
    return (f"SELECT '{name}' AS \"column\", CAST({tol} AS DOUBLE) AS tolerance, COUNT(CASE WHEN ml THEN 1 END) AS missing_left, "
            f"COUNT(CASE WHEN mr THEN 1 END) AS missing_right, "
            f"COUNT(CASE WHEN {both} AND {lc} IS DISTINCT FROM {rc} AND (abs({lc} - {rc}) IS NULL "
            f"OR abs({lc} - {rc}) > {tol}) THEN 1 END) AS out_of_tolerance, "
            f"COALESCE(MAX(CASE WHEN {both} THEN abs({lc} - {rc}) END), 0.0) AS max_gap FROM rj")


@register("d01_reconcile_city_mart", O.with_star(_rec_sql("revenue", "lr", "rrv", 1.0) + "\nUNION ALL\n"
                                                  + _rec_sql("orders", "lo", "ro", 0.0), extra_ctes=RECONCILE_CTES))
def d01_reconcile_city_mart(star, spark, sf_dir):
    """City x month mart reconciled against an independent group-by of the order fact (D-01, J-09)."""
    left = build_marts(star)["mart_city_month"].select("city", "month_key", F.col("revenue_net").alias("revenue"),
                                                       "orders")
    right = star.wide_orders.groupBy("city", "month_key").agg(
        F.sum("net_before_tax").cast("double").alias("revenue"), F.count("order_id").alias("orders"))
    return D.reconcile(left, right, ["city", "month_key"], {"revenue": 1.0, "orders": 0.0})


@register("d02_monthly_figures_present", O.with_star(f"""
SELECT t.target_id, t.target, EXISTS (SELECT 1 FROM mart_store_month m WHERE m.month_key BETWEEN
    '{P.window_start:%Y-%m}' AND '{P.window_end:%Y-%m}' AND abs(CAST(m.revenue_net AS DOUBLE) - t.target) <= 1.0)
    AS present
FROM (SELECT store_id || '/' || month_key AS target_id, CAST(SUM(net_before_tax) AS DOUBLE) AS target
      FROM wide_orders WHERE {W} GROUP BY store_id, month_key) t""", extra_ctes=MARTS))
def d02_monthly_figures_present(star, spark, sf_dir):
    """Every store-month revenue of the window is present among the mart's cells (D-02)."""
    t = A.window_orders(star).groupBy("store_id", "month_key").agg(
        F.sum("net_before_tax").cast("double").alias("target")).select(
        F.concat_ws("/", "store_id", "month_key").alias("target_id"), "target")
    w = P.window()
    cells = (build_marts(star)["mart_store_month"].filter(F.col("month_key").between(w.start_month, w.end_month))
             .select(F.col("revenue_net").cast("double").alias("num")))
    return D.figure_presence(t, cells, 1.0)


D04_CTES = f"""tot AS (SELECT SUM(net_before_tax) AS t FROM wide_orders WHERE {W}),
""" + ",\n".join(
    f"""{k} AS (SELECT SUM(r) AS s FROM (SELECT SUM(net_before_tax) AS r FROM wide_orders WHERE {W}
                                GROUP BY {dim}) x)"""
    for k, dim in (("mo", "month_key"), ("ch", "channel"), ("ci", "city"), ("dt", "day_type")))


@register("d04_partition_identities", O.with_star("\nUNION ALL\n".join(
    f"SELECT '{name}' AS identity, CAST({k}.s AS DOUBLE) AS lhs, CAST(tot.t AS DOUBLE) AS rhs, "
    f"CAST({k}.s AS DOUBLE) - CAST(tot.t AS DOUBLE) AS delta, "
    f"abs(CAST({k}.s AS DOUBLE) - CAST(tot.t AS DOUBLE)) <= 1.0 AS holds FROM {k}, tot"
    for name, k in (("months_sum_to_total", "mo"), ("channels_sum_to_total", "ch"), ("cities_sum_to_total", "ci"),
                    ("day_types_sum_to_total", "dt"))), extra_ctes=D04_CTES))
def d04_partition_identities(star, spark, sf_dir):
    """Months, channels, cities and day types each sum to the window total (D-04)."""
    wo = A.window_orders(star)
    total = wo.agg(F.sum("net_before_tax").alias("t"))
    parts = []
    for name, dim in (("months_sum_to_total", "month_key"), ("channels_sum_to_total", "channel"),
                      ("cities_sum_to_total", "city"), ("day_types_sum_to_total", "day_type")):
        s = wo.groupBy(dim).agg(F.sum("net_before_tax").alias("r")).agg(F.sum("r").alias("s"))
        parts.append(s.crossJoin(total).select(D.identity(name, F.col("s"), F.col("t"), 1.0).alias("x")).select("x.*"))
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


# --- U-05 / P-12 / S-15: ad hoc SQL over the star views, bounded preview ------------------------------
ADHOC_SQL = f"""
SELECT city, month_key, CAST(rev AS DOUBLE) AS revenue,
       CAST(LAG(rev) OVER (PARTITION BY city ORDER BY month_key) AS DOUBLE) AS prev_revenue
FROM (SELECT city, month_key, SUM(revenue_net) AS rev FROM mart_city_month
      WHERE month_key BETWEEN '{P.window_start:%Y-%m}' AND '{P.window_end:%Y-%m}' GROUP BY city, month_key) m
UNION
SELECT 'ALL' AS city, month_key, CAST(SUM(net_before_tax) AS DOUBLE) AS revenue, CAST(NULL AS DOUBLE) AS prev_revenue
FROM fact_orders WHERE order_date BETWEEN DATE '{P.window_start}' AND DATE '{P.window_end}' GROUP BY month_key"""


@register("u05_adhoc_sql_over_star", O.with_star(ADHOC_SQL, extra_ctes=MARTS))
def u05_adhoc_sql_over_star(star, spark, sf_dir):
    """Ad hoc SQL (CTE-free subquery, window, UNION) run by spark.sql over temp views of the star (U-05)."""
    star.register_views()
    return spark.sql(ADHOC_SQL)


SUBQUERY_SQL = f"""
SELECT store_id, CAST(SUM(net_before_tax) AS DOUBLE) AS revenue FROM fact_orders
WHERE order_date BETWEEN DATE '{P.window_start}' AND DATE '{P.window_end}'
GROUP BY store_id
HAVING SUM(net_before_tax) > (SELECT AVG(r) FROM (SELECT SUM(net_before_tax) AS r FROM fact_orders
  WHERE order_date BETWEEN DATE '{P.window_start}' AND DATE '{P.window_end}' GROUP BY store_id) x)"""


@register("p12_stores_above_average", O.with_star(SUBQUERY_SQL))
def p12_stores_above_average(star, spark, sf_dir):
    """Scalar-subquery predicate: stores whose window revenue beats the average store (P-12)."""
    star.register_views()
    return spark.sql(SUBQUERY_SQL)


@register("s15_preview_store_ranking", O.with_star("""
SELECT r.*, (SELECT COUNT(*) FROM ranked) > 10 AS truncated
FROM (SELECT * FROM ranked ORDER BY revenue DESC, store_id LIMIT 10) r""", extra_ctes=Q2_BASE))
def s15_preview_store_ranking(star, spark, sf_dir):
    """First 10 rows of the store ranking with a truncated flag, fetching cap + 1 rows (S-15, L-04)."""
    return preview(A.store_ranking(star), 10, [F.col("revenue").desc(), F.col("store_id")])


# --- F-10 / F-13 / F-14 / E-02 over the real text tables -------------------------------------------------
_WS = X.WHITESPACE_CLASS
_PUNCT_SQL = X.PUNCTUATION.replace("'", "''")


@register("f10_question_log_keys", f"""
SELECT key, COUNT(*) AS n FROM (
  SELECT trim(regexp_replace(translate(lower(text), '{_PUNCT_SQL}', ''), '{_WS}', ' ', 'g')) AS key
  FROM conversations WHERE role = 'user') x GROUP BY key""")
def f10_question_log_keys(star, spark, sf_dir):
    """Question-log deduplication by normalised key over every user turn (F-10)."""
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter(F.col("role") == "user")
    return conv.select(X.text_key("text").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@register("f13_f14_document_figures", f"""
SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '\\d{{4}}-\\d{{2}}(?:-\\d{{2}})?', ' ', 'g'),
                                      '\\d{{1,3}}(?:,\\d{{3}})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?')) AS n_figures,
       len(regexp_extract_all(text, '\\b[A-Z]{{2,5}}\\d{{2,6}}\\b')) AS n_identifiers
FROM documents""")
def f13_f14_document_figures(star, spark, sf_dir):
    """Figure and identifier tokens per document, over the whole documents table (F-13, F-14)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.size(X.figure_tokens("text")).cast("long").alias("n_figures"),
                       F.size(X.identifier_tokens("text")).cast("long").alias("n_identifiers"))


@register("e02_conversation_phrases", f"""
WITH tk AS (SELECT conv_id, turn,
                   list_filter(p, lambda x: regexp_full_match(x, '[A-Za-z0-9&''\\-]+')) AS toks
            FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z0-9&''\\-]+|[^A-Za-z0-9&''\\-]+') AS p
                  FROM conversations) x),
ph AS (SELECT conv_id, turn, s, unnest(range(1, least(4, len(toks) - s) + 1)) AS n, toks
       FROM (SELECT conv_id, turn, toks, unnest(range(0, len(toks))) AS s FROM tk WHERE len(toks) > 0) y)
SELECT conv_id, turn, COUNT(*) AS n_phrases, MAX(n) AS max_tokens FROM ph
WHERE NOT (n = 1 AND lower(toks[s + 1]) IN ({", ".join("'" + w + "'" for w in E.STOPWORDS)}))
GROUP BY conv_id, turn""")
def e02_conversation_phrases(star, spark, sf_dir):
    """Candidate phrases (1-4 tokens, stop-word singles removed) per conversation turn (E-02, E-03)."""
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    texts = conv.select(F.struct("conv_id", "turn").alias("text_id"), "text")
    return E.phrases(texts).groupBy("text_id.conv_id", "text_id.turn").agg(
        F.count(F.lit(1)).alias("n_phrases"), F.max("n_tokens").cast("long").alias("max_tokens"))


# --- S-12 / L-06 / C-08 / S-13 ----------------------------------------------------------------------
@register("s12_star_row_counts", O.with_star("""
SELECT 'dim_store' AS table_name, COUNT(*) AS "rows" FROM dim_store
UNION ALL SELECT 'dim_product', COUNT(*) FROM dim_product
UNION ALL SELECT 'dim_customer', COUNT(*) FROM dim_customer
UNION ALL SELECT 'dim_promotion', COUNT(*) FROM dim_promotion
UNION ALL SELECT 'dim_calendar', COUNT(*) FROM dim_calendar
UNION ALL SELECT 'fact_orders', COUNT(*) FROM fact_orders
UNION ALL SELECT 'fact_order_lines', COUNT(*) FROM fact_order_lines"""))
def s12_star_row_counts(star, spark, sf_dir):
    """Row count of every star table after the build: scans and normalisation (S-01 ... S-04), load and
    rebuild (S-05, S-06), builders (S-07 ... S-12); S-14 is the SQL twin."""
    from martlens.sources.star import row_counts
    return row_counts(star)


L06_CTES = f"""firsts AS (SELECT store_id, MIN(order_date) AS f FROM wide_orders WHERE {W} GROUP BY store_id),
k AS (SELECT store_id, row_number() OVER (ORDER BY f, store_id) AS series_rank FROM firsts ORDER BY f, store_id LIMIT 8)"""


@register("l06_first_series_pivot", O.with_star(f"""
SELECT k.store_id, k.series_rank, {", ".join(
    f"CAST(COALESCE(SUM(CASE WHEN o.month_key = '{m}' THEN o.net_before_tax END), 0) AS DOUBLE) AS rev_{m.replace('-', '_')}"
    for m in P.window().months())}
FROM k JOIN wide_orders o ON o.store_id = k.store_id AND {W.replace('order_date', 'o.order_date')}
GROUP BY k.store_id, k.series_rank""", extra_ctes=L06_CTES))
def l06_first_series_pivot(star, spark, sf_dir):
    """First 8 stores by first appearance, pivoted by month for charting (L-06, A-23)."""
    from martlens.operators.topk import first_k_categories
    wo = A.window_orders(star)
    k = first_k_categories(wo, "store_id", "order_date", 8)
    piv = DC.monthly_pivot(wo.join(F.broadcast(k), "store_id"), ["store_id", "series_rank"], P.window().months())
    return piv.select("store_id", "series_rank", *[F.col(DC.month_col(m)).cast("double").alias(DC.month_col(m))
                                                   for m in P.window().months()])


@register("c08_flag_columns", O.with_star("""
SELECT 'is_above_baseline' AS "column" FROM dvb
HAVING COUNT(CASE WHEN is_above_baseline NOT IN (0, 1) THEN 1 END) = 0 AND COUNT(is_above_baseline) > 0""",
                                          extra_ctes=dvb_sql(["store_id"])))
def c08_flag_columns(star, spark, sf_dir):
    """Flag-named columns whose values lie in {0, 1} (C-08), on the decline-vs-baseline table."""
    from martlens.plans.verify import flag_columns
    return flag_columns(DC.decline_vs_baseline(star, ["store_id"]))


@register("s13_golden_payload", None)
def s13_golden_payload(star, spark, sf_dir):
    """Q1 answer as a nested JSON payload, floats rounded to 2, dates ISO (S-13); rows-only."""
    from martlens.sources.sinks import golden_payload
    return golden_payload("What was our total revenue, order count and AOV in the last 3 months?",
                          {"headline": A.headline(star), "monthly": A.monthly(star)})


@register("s13_golden_monthly", O.with_star(f"""
SELECT month_key, CAST(round(SUM(net_before_tax), 2) AS DOUBLE) AS revenue, COUNT(order_id) AS orders,
  CAST(COALESCE(SUM(total_qty), 0) AS BIGINT) AS units,
  CAST(round(CAST(SUM(net_before_tax) AS DECIMAL(38,2)) / COUNT(order_id), 2) AS DOUBLE) AS aov
FROM wide_orders WHERE {W} GROUP BY month_key"""))
def s13_golden_monthly(star, spark, sf_dir):
    """The monthly rows of the golden payload, parsed back from its JSON: what a reader of the stored answer gets (S-13)."""
    from martlens.sources.sinks import golden_payload
    payload = golden_payload("monthly", {"monthly": A.monthly(star)})
    rows = F.from_json("payload", "monthly array<struct<month_key:string,revenue:double,orders:long,units:long,aov:double>>")
    return payload.select(F.inline(rows["monthly"]))


@register("f08_orders_by_clock", """
SELECT CAST(hour(o_orderdate) AS INTEGER) AS order_hour, dayname(o_orderdate) AS day_name,
  CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END AS day_type,
  COUNT(*) AS orders, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM orders GROUP BY ALL""")
def f08_orders_by_clock(star, spark, sf_dir):
    """Orders and revenue by hour, day name and day type of the order's timestamp (F-08)."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    return o.groupBy(F.hour(at).cast("int").alias("order_hour"), S.day_name(at).alias("day_name"), S.day_type(at).alias("day_type")) \
        .agg(F.count(F.lit(1)).alias("orders"), F.sum(S.money("o_totalprice")).cast("double").alias("revenue"))


# --- A-40 / A-41: HAVING and two-level aggregation; P-04 / P-13: resolved window vs data range -------------
@register("a41_line_variance_by_month", O.with_star("""
SELECT month_key, COUNT(*) AS orders, CAST(SUM(v) AS DOUBLE) AS variance
FROM (SELECT o.order_id, o.month_key, abs(SUM(l.line_net_value) - o.net_before_tax) AS v
      FROM fact_orders o JOIN fact_order_lines l ON l.order_id = o.order_id
      GROUP BY o.order_id, o.month_key, o.net_before_tax
      HAVING abs(SUM(l.line_net_value) - o.net_before_tax) > 1.00) x
GROUP BY month_key"""))
def a41_line_variance_by_month(star, spark, sf_dir):
    """Orders whose lines miss the header by more than the tolerance (HAVING, A-40), per month (A-41)."""
    lines = star.fact_order_lines.groupBy("order_id").agg(F.sum("line_net_value").alias("_ln"))
    per_order = (star.fact_orders.select("order_id", "month_key", "net_before_tax").join(lines, "order_id")
                 .groupBy("order_id", "month_key", "net_before_tax").agg(F.sum("_ln").alias("_ln"))
                 .withColumn("_v", F.abs(F.col("_ln") - F.col("net_before_tax")))
                 .filter(F.col("_v") > F.lit(P.line_reconcile_tolerance)))
    return per_order.groupBy("month_key").agg(F.count(F.lit(1)).alias("orders"),
                                             F.sum("_v").cast("double").alias("variance"))


_RES = P.resolve("last 3 months")


@register("p04_p13_window_coverage", O.with_star(f"""
SELECT '{_RES.label}' AS label, '{_RES.start}' AS window_start, '{_RES.end}' AS window_end,
       CAST(MIN(order_date) AS VARCHAR) AS data_min, CAST(MAX(order_date) AS VARCHAR) AS data_max,
       (DATE '{_RES.start}' >= MIN(order_date) AND DATE '{_RES.end}' <= MAX(order_date)) AS covered
FROM fact_orders"""))
def p04_p13_window_coverage(star, spark, sf_dir):
    """'Last 3 months' resolved against the as-of date (P-04) and checked against the data range (P-13)."""
    w = P.resolve("last 3 months")
    return star.fact_orders.agg(F.min("order_date").alias("_lo"), F.max("order_date").alias("_hi")).select(
        F.lit(w.label).alias("label"), F.lit(str(w.start)).alias("window_start"), F.lit(str(w.end)).alias("window_end"),
        F.col("_lo").cast("string").alias("data_min"), F.col("_hi").cast("string").alias("data_max"),
        ((F.lit(w.start) >= F.col("_lo")) & (F.lit(w.end) <= F.col("_hi"))).alias("covered"))


# --- F-02 ... F-04, F-17, P-03, P-13, S-06/S-12/Q-22: registered over the order fact and the build ---
@register("f02_f04_month_arithmetic", """
SELECT month_key, CAST(date_trunc('month', d) - INTERVAL 3 MONTH AS DATE) AS three_before,
       len(range(date_trunc('month', d) - INTERVAL 3 MONTH, date_trunc('month', d) + INTERVAL 1 DAY, INTERVAL 1 MONTH))
         AS n_keys, strftime(date_trunc('month', d) - INTERVAL 3 MONTH, '%Y-%m') AS first_key, 4 AS n_months, n
FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month_key, MIN(CAST(o_orderdate AS DATE)) AS d, COUNT(*) AS n
      FROM orders GROUP BY 1) x""")
def f02_f04_month_arithmetic(star, spark, sf_dir):
    """Shifted month, month keys between and number of months, for every order month (F-01 ... F-04)."""
    d = F.col("d")
    before = S.shift_months(d, -3)
    keys = S.month_keys_between(before, d)
    return (star.wide_orders.groupBy("month_key").agg(F.min("order_date").alias("d"), F.count(F.lit(1)).alias("n"))
            .select("month_key", before.alias("three_before"), F.size(keys).cast("long").alias("n_keys"),
                    F.element_at(keys, 1).alias("first_key"), S.months_in_window(before, d).cast("int").alias("n_months"),
                    "n"))


@register("p03_month_key_range", O.with_star(f"""
SELECT month_key, COUNT(*) AS orders FROM fact_orders
WHERE month_key BETWEEN '{P.prior().start:%Y-%m}' AND '{P.window_end:%Y-%m}' GROUP BY month_key"""))
def p03_month_key_range(star, spark, sf_dir):
    """Orders of a range of month keys; prunes partitions (P-03)."""
    from martlens.operators.metrics import in_months
    return (in_months(star.fact_orders, f"{P.prior().start:%Y-%m}", f"{P.window_end:%Y-%m}")
            .groupBy("month_key").agg(F.count(F.lit(1)).alias("orders")))


@register("f17_rounded_store_figures", O.with_star(f"""
SELECT store_id, round(CAST(SUM(net_before_tax) AS DOUBLE), 2) AS revenue_2,
       round(CAST(SUM(net_before_tax) AS DOUBLE) / COUNT(*), 4) AS aov_4
FROM fact_orders WHERE order_date BETWEEN DATE '{P.window_start}' AND DATE '{P.window_end}' GROUP BY store_id"""))
def f17_rounded_store_figures(star, spark, sf_dir):
    """Figures rounded to two and four decimals (F-17)."""
    w = P.window()
    g = in_window(star.fact_orders, w.start, w.end).groupBy("store_id").agg(
        F.sum("net_before_tax").cast("double").alias("r"), F.count(F.lit(1)).alias("n"))
    return g.select("store_id", F.round("r", 2).alias("revenue_2"), F.round(F.col("r") / F.col("n"), 4).alias("aov_4"))


@register("q32_mart_grain", O.with_star("""
SELECT 'mart_store_month' AS mart, COUNT(*) AS n, COUNT(DISTINCT store_id) * COUNT(DISTINCT month_key) AS full_grain
FROM (SELECT DISTINCT f.store_id, f.month_key FROM fact_orders f JOIN dim_store s ON f.store_id = s.store_id) x
UNION ALL SELECT 'mart_city_month', COUNT(*), COUNT(DISTINCT city) * COUNT(DISTINCT month_key)
FROM (SELECT DISTINCT s.city, f.month_key FROM fact_orders f JOIN dim_store s ON f.store_id = s.store_id) x
UNION ALL SELECT 'mart_channel_month', COUNT(*), COUNT(DISTINCT channel) * COUNT(DISTINCT month_key)
FROM (SELECT DISTINCT f.channel, f.month_key FROM fact_orders f JOIN dim_store s ON f.store_id = s.store_id) x"""))
def q32_mart_grain(star, spark, sf_dir):
    """Rows of every stored mart against entities x months (Q-32, S-11)."""
    parts = [m.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(k).alias("e"), F.countDistinct("month_key").alias("m"))
             .select(F.lit(name).alias("mart"), "n", (F.col("e") * F.col("m")).alias("full_grain"))
             for (name, m), k in zip(build_marts(star).items(), ("store_id", "city", "channel"), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("d03_ranking_runs", O.with_star("""
SELECT forward OR reversed AS contains_run, forward, reversed FROM (
  SELECT len(list_filter(range(1, len(labels) - 3), lambda i: labels[i:i + 4] = wanted)) > 0 AS forward,
         len(list_filter(range(1, len(labels) - 3), lambda i: labels[i:i + 4] = list_reverse(wanted))) > 0 AS reversed
  FROM (SELECT list(store_id ORDER BY rank) AS labels FROM ranked) l,
       (SELECT list(store_id ORDER BY rank DESC) AS wanted FROM ranked WHERE rank <= 5) e) x""", extra_ctes=Q2_BASE))
def d03_ranking_runs(star, spark, sf_dir):
    """The top stores listed worst first are found as a reversed run of the ranking (D-03)."""
    top = [r.store_id for r in A.top_stores(star).orderBy("rank").collect()]  # five labels
    return D.contains_run(A.store_ranking(star), "store_id", "rank", top[::-1])


#: Of every hundred places of the product ranking: labels as they stand, reversed, with a gap, or out of order.
RUN_KINDS = {0: (1, 2, 3, 4), 1: (4, 3, 2, 1), 2: (1, 2, 4, 5), 3: (1, 3, 2, 4)}


RUNS_CTES = Q4_BASE + f""",
pl AS (SELECT sku_id, row_number() OVER (ORDER BY line_revenue DESC, sku_id) AS place FROM prm),
ru AS (SELECT (place - 1) // 100 AS run_id, list_position(k.places, (place - 1) % 100 + 1) - 1 AS "at", sku_id AS label, place
       FROM pl JOIN (VALUES {", ".join(f"({k}, {list(v)})" for k, v in RUN_KINDS.items())}) k(kind, places)
         ON ((place - 1) // 100) % 4 = k.kind AND list_contains(k.places, (place - 1) % 100 + 1)),
rl AS (SELECT run_id, list(label ORDER BY "at") AS wanted, MIN(place) AS lo, MAX(place) AS hi FROM ru GROUP BY run_id),
st AS (SELECT r.run_id, r.wanted, list(p.sku_id ORDER BY p.place) AS there
       FROM rl r JOIN pl p ON p.place BETWEEN r.lo AND r.hi GROUP BY r.run_id, r.wanted)"""


@register("d03_product_runs", O.with_star("""
SELECT run_id, wanted = there OR list_reverse(wanted) = there AS contains_run, wanted = there AS forward,
  list_reverse(wanted) = there AS reversed FROM st""", extra_ctes=RUNS_CTES))
def d03_product_runs(star, spark, sf_dir):
    """Runs of four products, of every hundred places of the revenue ranking: contained, reversed, broken or
    out of order (D-03), over places numbered by range partitions."""
    ranking = A.product_ranking(star).select("sku_id", "line_revenue")
    placed = numbered(ranking, [F.col("line_revenue").desc(), F.col("sku_id")], "place")
    block, inside = F.floor((F.col("place") - 1) / 100), ((F.col("place") - 1) % 100 + 1).cast("int")
    at = None
    for kind, places in RUN_KINDS.items():
        here = F.array_position(F.array(*map(F.lit, places)), inside) - 1
        at = F.when(block % 4 == kind, here) if at is None else at.when(block % 4 == kind, here)
    runs = placed.select(block.cast("long").alias("run_id"), at.alias("at"), F.col("sku_id").alias("label")).where("at >= 0")
    return D.contains_runs(placed, "sku_id", "place", runs)


@register("a31_distinct_customers_by_window", O.with_star(f"""
SELECT store_id, n_months, COUNT(DISTINCT customer_id) AS customers
FROM wide_orders, (VALUES {", ".join(f"({n})" for n in (1, 2, 3, 6, 12))}) w(n_months)
WHERE month_key IN (SELECT m FROM (SELECT DISTINCT month_key AS m FROM wide_orders WHERE month_key <= '{P.window().months()[-1]}')
                    ORDER BY m DESC LIMIT 12)
  AND (SELECT COUNT(*) FROM (SELECT DISTINCT month_key AS m FROM wide_orders
                             WHERE month_key <= '{P.window().months()[-1]}') x WHERE x.m > wide_orders.month_key) < n_months
  AND customer_id IS NOT NULL
GROUP BY store_id, n_months"""))
def a31_distinct_customers_by_window(star, spark, sf_dir):
    """Distinct customers of every store over the last 1, 2, 3, 6 and 12 months, from stored bitmaps of store and month
    alone (A-31, A-37)."""
    months, _ = customer_bitmaps(star)
    last = P.window().months()[-1]
    keys = months.where(F.col("month_key") <= last).select("month_key").distinct()
    # months are few: their place from the last one back
    back = keys.select("month_key", F.row_number().over(Window.orderBy(F.desc("month_key"))).alias("back"))
    spans = F.explode(F.filter(F.array(*map(F.lit, (1, 2, 3, 6, 12))), lambda n: n >= F.col("back"))).alias("n_months")
    held = months.join(F.broadcast(back.where("back <= 12")), "month_key").select("store_id", "bucket", "bitmap", spans)
    return X2.distinct_over(held, ["store_id", "n_months"], "customers")


@register("a37_distinct_customers_by_level", O.with_star(f"""
SELECT 'store' AS level, store_id AS name, COUNT(DISTINCT customer_id) AS customers FROM wide_orders
WHERE {W} AND customer_id IS NOT NULL GROUP BY store_id
UNION ALL SELECT 'city', city, COUNT(DISTINCT customer_id) FROM wide_orders WHERE {W} AND customer_id IS NOT NULL GROUP BY city
UNION ALL SELECT 'all', 'all', COUNT(DISTINCT customer_id) FROM wide_orders WHERE {W} AND customer_id IS NOT NULL"""))
def a37_distinct_customers_by_level(star, spark, sf_dir):
    """Distinct customers of the window by store, by city and in all: unions of the same stored bitmaps (A-37)."""
    months, _ = customer_bitmaps(star)
    held = months.where(F.col("month_key").isin(P.window().months())).join(
        F.broadcast(star.dim_store.select("store_id", "city")), "store_id")  # one row per store
    levels = F.explode(F.array(*(F.struct(F.lit(x).alias("level"), c.alias("name")) for x, c in (
        ("store", F.col("store_id")), ("city", F.col("city")), ("all", F.lit("all")))))).alias("l")
    return X2.distinct_over(held.select("bucket", "bitmap", levels).select("bucket", "bitmap", "l.*"), ["level", "name"], "customers")


_BITMAPS: dict[tuple[str, str], tuple] = {}


def customer_bitmaps(star):
    """Bitmaps of customers per store and month, and the dense ids, stored once per application."""
    from martlens.session import app_key
    key = (app_key(star.fact_orders.sparkSession), f"{star.source}|{star.profile.name}")
    if key not in _BITMAPS:
        ids = X2.dense_ids(star.fact_orders, "customer_id")
        _BITMAPS[key] = (X2.distinct_bitmaps(star.fact_orders, ["store_id", "month_key"], "customer_id", ids), ids)
    return _BITMAPS[key]


_CHANGED = P.window().months()[-1]


@register("s06_refreshed_channel_mart", O.with_star(f"""
SELECT CASE WHEN month_key = '{_CHANGED}' AND order_id % 10 = 0 THEN '5-LOW' ELSE channel END AS channel, month_key,
  month_key = '{_CHANGED}' AS rewritten, COUNT(*) AS orders, CAST(SUM(net_before_tax) AS DOUBLE) AS revenue,
  CAST(SUM(total_qty) AS BIGINT) AS units
FROM wide_orders WHERE store_name IS NOT NULL GROUP BY 1, month_key"""))
def s06_refreshed_channel_mart(star, spark, sf_dir):
    """The channel mart after an incremental rebuild in which a tenth of the orders of one month changed their
    channel: only that month is written, behind the gate (S-06, S-11, S-12)."""
    from martlens.plans.quality import expected_counts_from_sources
    from martlens.sources.star import COLUMNS, read_star, refresh_star
    changed = (F.col("month_key") == _CHANGED) & (F.col("order_id") % 10 == 0)
    channel = F.when(changed, F.lit("5-LOW")).otherwise(F.col("channel"))
    wide = star.wide_orders.withColumn("channel", channel)
    source = star.with_tables(wide_orders=wide, fact_orders=wide.select(*COLUMNS["fact_orders"]),
                              wide_lines=star.wide_lines.withColumn("channel", channel))
    root, months = refresh_star(source, star.source, expected_counts_from_sources(spark, sf_dir, star))
    mart = read_star(spark, root, star.profile).marts["mart_channel_month"]
    return mart.select("channel", "month_key", F.col("month_key").isin(months).alias("rewritten"), "orders",
                       F.col("revenue_net").cast("double").alias("revenue"), "units")


@register("l06_first_categories", O.with_star("""
SELECT category, row_number() OVER (ORDER BY first_day, category) AS series_rank
FROM (SELECT category, MIN(order_date) AS first_day FROM wide_lines WHERE category IS NOT NULL GROUP BY category) x
ORDER BY first_day, category LIMIT 24"""))
def l06_first_categories(star, spark, sf_dir):
    """The first 24 categories by first appearance (L-06)."""
    from martlens.operators.topk import first_k_categories
    return first_k_categories(star.wide_lines.where("category is not null"), "category", "order_date", 24)
