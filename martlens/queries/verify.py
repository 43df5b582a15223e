"""Registered result-verification queries (V-01 ... V-15) and their DuckDB twins.

The verified results are registered analyses (headline, channel mix, monthly
series, top stores) computed from the testdata. The SQL twin is generated from
the same schema-level role rules, applied to the oracle SQL of those analyses.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from martlens.plans import analyses as A
from martlens.plans import verify as V
from martlens.profile import TESTDATA as P
from martlens.registry import REGISTRY, register

# Result sets and their column kinds (num / str / date), in result order.
RESULT_SPECS = {
    "total": ("q1_headline", [("revenue", "num"), ("orders", "num"), ("aov", "num"), ("units", "num"),
                              ("units_per_order", "num"), ("revenue_with_tax", "num"), ("gross_revenue", "num"),
                              ("discount", "num")]),
    "by_channel": ("q3_channel_mix", [("channel", "str"), ("revenue", "num"), ("orders", "num"), ("units", "num"),
                                      ("aov", "num"), ("units_per_order", "num"), ("revenue_share_pct", "num"),
                                      ("order_share_pct", "num")]),
    "monthly": ("q1_monthly", [("month_key", "str"), ("revenue", "num"), ("orders", "num"),
                               ("revenue_with_tax", "num"), ("units", "num"), ("aov", "num"),
                               ("units_per_order", "num")]),
    "top_stores": ("q2_top5_stores", [("store_id", "str"), ("store_name", "str"), ("city", "str"), ("region", "str"),
                                      ("revenue", "num"), ("orders", "num"), ("units", "num"), ("aov", "num"),
                                      ("units_per_order", "num"), ("revenue_share_pct", "num"), ("rank", "num")]),
}
_BUILDERS = {"total": A.headline, "by_channel": A.channel_mix, "monthly": A.monthly, "top_stores": A.top_stores}
CASES = {
    "verify_channel_question": ("How do our sales channels compare in the last 3 months?",
                                ["total", "by_channel", "monthly"], ("revenue", "orders", "aov")),
    "verify_top5_question": ("Which are the top 5 stores by revenue in the last 3 months?",
                             ["total", "top_stores", "monthly", "by_channel"], ("revenue", "margin_pct")),
}


def _spark_report(question, rids, metrics):
    def fn(star, spark, sf_dir):
        """Verification report (V-01 ... V-13) with roles from names (C-01 ... C-07), date-like parsing (F-09)
        and the top-N expectation (F-15)."""
        results = []
        for rid in rids:
            df = _BUILDERS[rid](star)
            expected = [c for c, _k in RESULT_SPECS[rid][1]]
            if df.columns != expected:
                raise AssertionError(f"{rid} columns drifted: {df.columns} != {expected}")
            results.append((rid, df))
        rep = V.verify(results, V.Plan(question, P.window(), tuple(metrics)), P)
        return rep.select("name", "severity", "passed", "n_offenders",
                          F.array_join("result_ids", ",").alias("result_ids"))
    return fn


# --- SQL twin -------------------------------------------------------------------------
def _q(c: str) -> str:
    return f'"{c}"'


def _parse(c: str, kind: str) -> str:
    if kind == "date":
        return f"CAST({_q(c)} AS DATE)"
    t = f"trim(CAST({_q(c)} AS VARCHAR))"
    return (f"(CASE WHEN regexp_matches({t}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN CAST(try_strptime({t}, '%Y-%m-%d') AS DATE) "
            f"WHEN regexp_matches({t}, '^\\d{{4}}-\\d{{2}}$') THEN CAST(try_strptime({t} || '-01', '%Y-%m-%d') AS DATE) END)")


def _profile_sql(rid: str, cols: list[tuple[str, str]]) -> tuple[str, dict]:
    names = [c for c, _ in cols]
    kinds = dict(cols)
    num = lambda c: c is not None and kinds[c] == "num"
    first = lambda pred: next((c for c in names if pred(c)), None)
    rev, ords, aov = first(V.is_revenue), first(V.is_order_count), first(V.is_aov)
    exhaustive = dict(P.exhaustive_dimensions)
    dim = first(lambda c: c in exhaustive)
    measures = [c for c in names if (V.is_revenue(c) or V.is_order_count(c) or V.is_quantity(c)) and num(c)]
    shares = [c for c in names if V.is_share(c) and num(c)]
    revenue_cols = [c for c in names if V.is_revenue(c) and num(c)]
    date_cols = [c for c in names if kinds[c] in ("str", "date")]
    month_cols = [c for c in names if V.is_month_column(c)]
    dims_present = [d for d in exhaustive if d in names]
    a = ["COUNT(*) AS rows"]
    a += [f"COUNT({_q(c)}) AS {_q('nn::' + c)}" for c in names]
    a += [f"COUNT(CASE WHEN {_q(c)} < 0 THEN 1 END) AS {_q('neg::' + c)}" for c in measures]
    has_aov = num(rev) and num(ords) and num(aov)
    if has_aov:
        r, o, v = (f"CAST({_q(x)} AS DOUBLE)" for x in (rev, ords, aov))
        ok = f"{r} IS NOT NULL AND {o} IS NOT NULL AND {v} IS NOT NULL AND {o} <> 0"
        a += [f"COUNT(CASE WHEN {ok} THEN 1 END) AS aov_checked",
              f"COUNT(CASE WHEN {ok} AND abs({r} / {o} - {v}) > {P.aov_tolerance} THEN 1 END) AS aov_bad"]
    else:
        a += ["0 AS aov_checked", "0 AS aov_bad"]
    for c in shares:
        a += [f"SUM(CAST({_q(c)} AS DOUBLE)) AS {_q('share_sum::' + c)}",
              f"COUNT(CASE WHEN {_q(c)} IS NULL THEN 1 END) AS {_q('share_null::' + c)}"]
    a += [f"COUNT(CASE WHEN CAST({_q(c)} AS DOUBLE) > {P.max_plausible_revenue} THEN 1 END) AS {_q('over::' + c)}"
          for c in revenue_cols]
    if num(rev):
        a += [f"FIRST(CAST({_q(rev)} AS DOUBLE)) AS first_rev",
              f"SUM(COALESCE(CAST({_q(rev)} AS DOUBLE), 0.0)) AS parts_sum"]
    for d in dims_present:
        a += [f"COUNT(DISTINCT CAST({_q(d)} AS VARCHAR)) AS {_q('dist::' + d)}",
              f"MAX(CAST({_q(d)} IS NULL AS INTEGER)) AS {_q('hasnull::' + d)}"]
    for c in date_cols:
        p = _parse(c, kinds[c])
        a += [f"COUNT(CASE WHEN {p} < DATE '{P.data_start}' OR {p} > DATE '{P.last_day}' THEN 1 END) "
              f"AS {_q('datebad::' + c)}"]
    for c in month_cols:
        p = _parse(c, kinds[c])
        a += [f"list(DISTINCT strftime({p}, '%Y-%m')) FILTER (WHERE {p} IS NOT NULL) AS {_q('months::' + c)}"]
    meta = dict(rid=rid, names=names, rev=rev if num(rev) else None, dim=dim, measures=measures, shares=shares,
                revenue_cols=revenue_cols, date_cols=date_cols, month_cols=month_cols, dims_present=dims_present)
    return f"SELECT {', '.join(a)} FROM r_{rid}", meta


def _or(conds: list[str]) -> str:
    return "(" + " OR ".join(conds) + ")" if conds else "FALSE"


def verify_sql(question: str, rids: list[str], metrics) -> str:
    ctes = []
    profiles = []
    for idx, rid in enumerate(rids):
        qname, cols = RESULT_SPECS[rid]
        body = REGISTRY[qname][1]
        ctes.append(f"r_{rid} AS ({body})")
        psql, meta = _profile_sql(rid, cols)
        ctes.append(f"p_{rid} AS ({psql})")
        meta["idx"] = idx
        profiles.append(meta)
    topn = V.top_n_of(question)
    exhaustive = dict(P.exhaustive_dimensions)

    def cand(m, offending, applicable="TRUE"):
        return (f"SELECT {m['idx']} AS idx, '{m['rid']}' AS rid, ({applicable}) AS applicable, "
                f"({offending}) AS offending FROM p_{m['rid']}")

    def row(name, sev, cands: list[str]):
        u = " UNION ALL ".join(cands) if cands else \
            "SELECT 0 AS idx, '' AS rid, FALSE AS applicable, FALSE AS offending"
        off = "applicable AND offending"
        return (f"SELECT '{name}' AS name, '{sev}' AS severity, COUNT(CASE WHEN {off} THEN 1 END) = 0 AS passed, "
                f"COUNT(CASE WHEN {off} THEN 1 END) AS n_offenders, "
                f"COALESCE(string_agg(CASE WHEN {off} THEN rid END, ',' ORDER BY idx), '') AS result_ids "
                f"FROM ({u}) c")

    rows = [row("all_sub_queries_executed", V.WARNING,
                [f"SELECT {m['idx']} AS idx, '{m['rid']}' AS rid, TRUE AS applicable, FALSE AS offending"
                 for m in profiles])]
    rows.append(row("results_non_empty", V.WARNING, [cand(m, "rows = 0") for m in profiles]))
    rows.append(row("no_all_null_columns", V.WARNING,
                    [cand(m, _or([f"{_q('nn::' + c)} = 0" for c in m["names"]]), "rows > 0") for m in profiles]))
    rows.append(row("no_negative_measures", V.ERROR,
                    [cand(m, _or([f"{_q('neg::' + c)} > 0" for c in m["measures"]])) for m in profiles]))
    rows.append(row("aov_reconciles", V.ERROR, [cand(m, "aov_bad > 0", "aov_checked > 0") for m in profiles]))
    rows.append(row("shares_sum_to_100", V.WARNING, [cand(m, _or(
        [f"({_q('share_null::' + c)} = 0 AND abs({_q('share_sum::' + c)} - 100.0) > {P.share_tolerance})"
         for c in m["shares"]]), "rows >= 2") for m in profiles]))
    rows.append(row("revenue_within_plausible_bound", V.ERROR,
                    [cand(m, _or([f"{_q('over::' + c)} > 0" for c in m["revenue_cols"]])) for m in profiles]))
    if topn is None:
        rows.append(row("row_count_matches_expectation", V.WARNING, [cand(m, "FALSE") for m in profiles]))
    else:
        allow = topn * max(1, len(P.window().months()))
        rows.append(row("row_count_matches_expectation", V.WARNING,
                        [cand(m, f"rows > {allow} AND rows >= {V.MIN_ROWS_FOR_TOPN_WARNING}") for m in profiles]))
    all_cols = [c.lower() for rid in rids for c, _ in RESULT_SPECS[rid][1]]
    missing = [mn for mn in metrics if not any(any(t in c for t in V.METRIC_TOKENS.get(mn, (mn,))) for c in all_cols)]
    rows.append(row("planned_metrics_present", V.WARNING,
                    [f"SELECT {i} AS idx, '{mn}' AS rid, TRUE AS applicable, TRUE AS offending"
                     for i, mn in enumerate(missing)]))
    rows.append(row("dates_within_data_range", V.ERROR,
                    [cand(m, _or([f"{_q('datebad::' + c)} > 0" for c in m["date_cols"]])) for m in profiles]))
    exp_months = "[" + ", ".join(f"'{x}'" for x in P.window().months()) + "]"
    v12 = []
    for m in profiles:
        if not m["month_cols"]:
            v12.append(cand(m, "FALSE"))
            continue
        seen = "list_distinct(flatten([" + ", ".join(_q("months::" + c) for c in m["month_cols"]) + "]))"
        ov = f"len(list_intersect({seen}, {exp_months}))"
        v12.append(cand(m, f"{ov} > 0 AND {ov} < {len(P.window().months())}"))
    rows.append(row("results_cover_the_window", V.WARNING, v12))
    v13 = []
    for m in profiles:
        if topn is not None or not m["dims_present"]:
            v13.append(cand(m, "FALSE"))
        else:
            v13.append(cand(m, _or([f"({_q('dist::' + d)} > 0 AND {_q('dist::' + d)} < {exhaustive[d]})"
                                    for d in m["dims_present"]]), "rows > 0"))
    rows.append(row("dimension_coverage", V.WARNING, v13))
    tots = [f"SELECT {m['idx']} AS idx, '{m['rid']}' AS rid, first_rev AS total FROM p_{m['rid']} "
            f"WHERE rows = 1 AND first_rev IS NOT NULL" for m in profiles
            if m["rev"] is not None and not any(c in exhaustive for c in m["names"])]
    brks = []
    for m in profiles:
        if m["rev"] is not None and m["dim"] is not None:
            d = m["dim"]
            brks.append(f"SELECT {m['idx']} AS idx, '{m['rid']}' AS rid, parts_sum FROM p_{m['rid']} WHERE "
                        f"{_q('dist::' + d)} + COALESCE({_q('hasnull::' + d)}, 0) = {exhaustive[d]}")
    if tots and brks:
        rows.append(f"""SELECT 'parts_sum_to_total' AS name, 'error' AS severity,
  (t.total IS NULL OR b.parts_sum IS NULL OR abs(b.parts_sum - t.total) <= {P.total_tolerance}) AS passed,
  CAST(CASE WHEN t.total IS NOT NULL AND b.parts_sum IS NOT NULL AND abs(b.parts_sum - t.total) > {P.total_tolerance}
       THEN 1 ELSE 0 END AS BIGINT) AS n_offenders,
  CASE WHEN t.total IS NOT NULL AND b.parts_sum IS NOT NULL AND abs(b.parts_sum - t.total) > {P.total_tolerance}
       THEN b.rid || ',' || t.rid ELSE '' END AS result_ids
FROM (SELECT NULL AS x) d
LEFT JOIN (SELECT * FROM ({' UNION ALL '.join(tots)}) ORDER BY idx LIMIT 1) t ON TRUE
LEFT JOIN (SELECT * FROM ({' UNION ALL '.join(brks)}) ORDER BY idx LIMIT 1) b ON TRUE""")
    else:
        rows.append("SELECT 'parts_sum_to_total' AS name, 'error' AS severity, TRUE AS passed, "
                    "CAST(0 AS BIGINT) AS n_offenders, '' AS result_ids")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(rows)


for _name, (_qn, _rids, _metrics) in CASES.items():
    register(_name, verify_sql(_qn, _rids, _metrics))(_spark_report(_qn, _rids, _metrics))


_Q5, _R5, _M5 = CASES["verify_top5_question"]


@register("verify_verdict_top5", f"""
SELECT CASE WHEN errors > 0 THEN 'failed' WHEN warnings > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS status,
       errors, warnings
FROM (SELECT COUNT(CASE WHEN severity = 'error' AND NOT passed THEN 1 END) AS errors,
             COUNT(CASE WHEN severity = 'warning' AND NOT passed THEN 1 END) AS warnings
      FROM ({verify_sql(_Q5, _R5, _M5)}) r) x""")
def verify_verdict_top5(star, spark, sf_dir):
    """Verification verdict: failed / passed_with_warnings / passed (V-14)."""
    results = [(rid, _BUILDERS[rid](star)) for rid in _R5]
    return V.verdict(V.verify(results, V.Plan(_Q5, P.window(), tuple(_M5)), P))


@register("verify_blame_top5", f"""
SELECT DISTINCT unnest(string_split(result_ids, ',')) AS result_id
FROM ({verify_sql(_Q5, _R5, _M5)}) r WHERE severity = 'error' AND NOT passed AND result_ids <> ''""")
def verify_blame_top5(star, spark, sf_dir):
    """Result ids blamed by failed error checks (V-15)."""
    results = [(rid, _BUILDERS[rid](star)) for rid in _R5]
    return V.blame(V.verify(results, V.Plan(_Q5, P.window(), tuple(_M5)), P))


# --- many answers at once ---------------------------------------------------------------------
from martlens import oracle as O  # noqa: E402
from martlens.functions import scalars as S  # noqa: E402
from martlens.plans import verify_batch as B  # noqa: E402

BATCH_COLUMNS = {
    "total": [("revenue", "num"), ("orders", "num"), ("aov", "num"), ("units", "num")],
    "by_channel": [("channel", "str"), ("revenue", "num"), ("orders", "num"), ("aov", "num"), ("units", "num"),
                   ("revenue_share_pct", "num")],
    "daily": [("order_date", "date"), ("revenue", "num"), ("orders", "num")]}
#: Faults are put into answers by their number modulo this, so that every check has something to find.
FAULTS = 23


def batch_inputs(star):
    """One answer per store and month of all orders: its total, its channels and its days; every 23 answers eight
    have a fault (wrong total, AOV, sign, share, a missing channel, a date out of range, an empty column or
    result), and every 17th a sub-query that failed."""
    month = F.col("month_key")
    number = (F.substring("store_id", 3, 18).cast("long") * 10000
              + (F.substring(month, 1, 4).cast("long") - 1990) * 12 + F.substring(month, 6, 2).cast("long"))
    o = star.wide_orders.select(number.alias("a"), "month_key", "channel", "order_date", "net_before_tax", "order_id", "total_qty")
    money = F.sum("net_before_tax").cast("double").alias("revenue")
    n, units = F.count("order_id").alias("orders"), F.sum("total_qty").cast("long").alias("units")
    k = F.col("a") % FAULTS
    aov = S.safe_ratio("revenue", "orders")
    plain = o.groupBy("a", "month_key").agg(money, n, units).withColumn("aov", aov)
    total = plain.withColumns({"revenue": F.when(k == 1, F.col("revenue") + 5000).otherwise(F.col("revenue")),
                               "units": F.when(k == 3, -F.col("units")).otherwise(F.col("units"))})
    channels = o.groupBy("a", "channel").agg(money, n, units).withColumn("aov", aov).join(
        plain.select("a", F.col("revenue").alias("_all")), "a").withColumn(
        "revenue_share_pct", S.pct_of("revenue", "_all") * F.when(k == 4, 0.9).otherwise(1.0))
    channels = channels.where((k != 5) | (F.col("channel") != "5-LOW")).withColumns({
        "aov": F.when(k == 2, F.col("aov") + 1).otherwise(F.col("aov")), "revenue": F.when(k != 7, F.col("revenue"))})
    days = o.groupBy("a", "order_date").agg(money, n).where(k != 8).withColumn(
        "order_date", F.when(k == 6, F.add_months("order_date", 1200)).otherwise(F.col("order_date")))
    rows = {"total": (total, F.lit("0")), "by_channel": (channels, F.col("channel")), "daily": (days, F.col("order_date"))}
    cells = None
    for idx, (rid, (df, row)) in enumerate(rows.items()):
        part = B.long_form(F.col("a"), idx, df, BATCH_COLUMNS[rid], row)
        cells = part if cells is None else cells.unionByName(part)
    keys = plain.select("a", "month_key")
    following = F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), 1), "yyyy-MM")
    answers = keys.select(
        F.col("a").alias("answer_id"),
        F.when(F.col("a") % 3 == 0, "Which are the top 2 channels of the month?").otherwise("How did the channels do?").alias("question"),
        F.when(F.col("a") % 4 == 0, F.array(F.lit("revenue"), F.lit("margin_pct"))).otherwise(
            F.array(F.lit("revenue"), F.lit("orders"))).alias("metrics"),
        F.when(F.col("a") % 5 == 0, F.array(month, following)).otherwise(F.array(month)).alias("months"))
    columns = lambda rid: F.array(*(F.struct(F.lit(c).alias("name"), F.lit(t).alias("kind")) for c, t in BATCH_COLUMNS[rid]))
    specs = [F.struct(F.lit(i).alias("idx"), F.lit(rid).alias("result_id"), F.lit(False).alias("failed"),
                      columns(rid).alias("columns")) for i, rid in enumerate(BATCH_COLUMNS)]
    lost = F.struct(F.lit(3).alias("idx"), F.lit("margins").alias("result_id"), F.lit(True).alias("failed"),
                    columns("total").alias("columns"))
    listed = F.when(F.col("a") % 17 == 0, F.array(*specs, lost)).otherwise(F.array(*specs))
    results = keys.select(F.col("a").alias("answer_id"), F.explode(listed).alias("r")).select("answer_id", "r.*")
    return answers, results, cells


_months = "list_distinct(list(strftime(order_date, '%Y-%m')))"
_out = f"order_date < DATE '{P.data_start}' OR order_date > DATE '{P.last_day}'"
BATCH_CTES = f"""o AS (
  SELECT CAST(substr(store_id, 3) AS BIGINT) * 10000 + (CAST(substr(month_key, 1, 4) AS BIGINT) - 1990) * 12
         + CAST(substr(month_key, 6, 2) AS BIGINT) AS a, month_key, channel, order_date, net_before_tax, order_id, total_qty
  FROM wide_orders),
pl AS (SELECT *, {O.safe_ratio('revenue', 'orders')} AS aov FROM (
  SELECT a, month_key, CAST(SUM(net_before_tax) AS DOUBLE) AS revenue, COUNT(order_id) AS orders, CAST(SUM(total_qty) AS BIGINT) AS units
  FROM o GROUP BY a, month_key) x),
an AS (SELECT a, CASE WHEN a % 3 = 0 THEN 2 END AS top_n, CASE WHEN a % 4 = 0 THEN 1 ELSE 0 END AS no_margin,
         CASE WHEN a % 5 = 0 THEN [month_key, strftime(CAST(month_key || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m')]
              ELSE [month_key] END AS months FROM pl),
tt AS (SELECT a, CASE WHEN a % {FAULTS} = 1 THEN revenue + 5000 ELSE revenue END AS revenue, orders, aov,
         CASE WHEN a % {FAULTS} = 3 THEN -units ELSE units END AS units FROM pl),
ch0 AS (SELECT *, {O.safe_ratio('revenue', 'orders')} AS aov FROM (
  SELECT a, channel, CAST(SUM(net_before_tax) AS DOUBLE) AS revenue, COUNT(order_id) AS orders, CAST(SUM(total_qty) AS BIGINT) AS units
  FROM o GROUP BY a, channel) x),
ch AS (SELECT c.a, c.channel, CASE WHEN c.a % {FAULTS} <> 7 THEN c.revenue END AS revenue, c.orders, c.units,
         c.aov + CASE WHEN c.a % {FAULTS} = 2 THEN 1 ELSE 0 END AS aov,
         c.sh * CASE WHEN c.a % {FAULTS} = 4 THEN 0.9 ELSE 1.0 END AS share
       FROM (SELECT c.*, {O.pct_of('c.revenue', 'p.revenue')} AS sh FROM ch0 c JOIN pl p ON c.a = p.a) c
       WHERE NOT (c.a % {FAULTS} = 5 AND c.channel = '5-LOW')),
da AS (SELECT a, CASE WHEN a % {FAULTS} = 6 THEN CAST(order_date + INTERVAL 1200 MONTH AS DATE) ELSE order_date END AS order_date,
         revenue, orders FROM (
  SELECT a, order_date, CAST(SUM(net_before_tax) AS DOUBLE) AS revenue, COUNT(order_id) AS orders FROM o GROUP BY a, order_date) x
  WHERE a % {FAULTS} <> 8),
cf AS (SELECT a, COUNT(*) AS n, COUNT(revenue) AS nr, COUNT(share) AS ns, SUM(share) AS ss, SUM(COALESCE(revenue, 0)) AS parts,
         COUNT(DISTINCT channel) AS nc, MAX(CAST(channel IS NULL AS INT)) AS hn,
         bool_or(revenue < 0 OR orders < 0 OR units < 0) AS neg, bool_or(revenue > {P.max_plausible_revenue}) AS big,
         bool_or(orders <> 0 AND abs(revenue / orders - aov) > {P.aov_tolerance}) AS aov_off FROM ch GROUP BY a),
df AS (SELECT a, COUNT(*) AS n, bool_or({_out}) AS bad, bool_or(revenue < 0 OR orders < 0) AS neg,
         bool_or(revenue > {P.max_plausible_revenue}) AS big, {_months} AS seen FROM da GROUP BY a),
every AS (SELECT an.*, COALESCE(cf.n, 0) AS cn, COALESCE(df.n, 0) AS dn, tt.revenue AS t_rev, tt.orders AS t_orders, tt.aov AS t_aov,
            tt.units AS t_units, cf.nr, cf.ns, cf.ss, cf.parts, cf.nc, cf.hn, cf.neg AS c_neg, cf.big AS c_big, cf.aov_off AS c_aov,
            df.bad, df.neg AS d_neg, df.big AS d_big, COALESCE(len(list_intersect(df.seen, an.months)), 0) AS ov
          FROM an JOIN tt ON tt.a = an.a LEFT JOIN cf ON cf.a = an.a LEFT JOIN df ON df.a = an.a),
offs AS (SELECT a, u.name, u.severity, list_filter(u.ids, lambda x: x IS NOT NULL) AS ids FROM every, LATERAL (VALUES
  ('all_sub_queries_executed', 'warning', [CASE WHEN a % 17 = 0 THEN 'margins' END]),
  ('results_non_empty', 'warning', [CASE WHEN cn = 0 THEN 'by_channel' END, CASE WHEN dn = 0 THEN 'daily' END]),
  ('no_all_null_columns', 'warning', [CASE WHEN cn > 0 AND (nr = 0 OR ns = 0) THEN 'by_channel' END]),
  ('no_negative_measures', 'error', [CASE WHEN t_rev < 0 OR t_orders < 0 OR t_units < 0 THEN 'total' END,
                                     CASE WHEN c_neg THEN 'by_channel' END, CASE WHEN d_neg THEN 'daily' END]),
  ('aov_reconciles', 'error', [CASE WHEN t_orders <> 0 AND abs(t_rev / t_orders - t_aov) > {P.aov_tolerance} THEN 'total' END,
                               CASE WHEN c_aov THEN 'by_channel' END]),
  ('parts_sum_to_total', 'error', CASE WHEN nc + hn = {dict(P.exhaustive_dimensions)['channel']} AND abs(parts - t_rev) > {P.total_tolerance}
                                       THEN ['by_channel', 'total'] ELSE [NULL] END),
  ('shares_sum_to_100', 'warning', [CASE WHEN cn >= 2 AND ns = cn AND abs(ss - 100.0) > {P.share_tolerance} THEN 'by_channel' END]),
  ('revenue_within_plausible_bound', 'error', [CASE WHEN t_rev > {P.max_plausible_revenue} THEN 'total' END,
                                               CASE WHEN c_big THEN 'by_channel' END, CASE WHEN d_big THEN 'daily' END]),
  ('row_count_matches_expectation', 'warning', [CASE WHEN cn > top_n * len(months) AND cn >= 2 THEN 'by_channel' END,
                                                CASE WHEN dn > top_n * len(months) AND dn >= 2 THEN 'daily' END]),
  ('planned_metrics_present', 'warning', [CASE WHEN no_margin = 1 THEN 'margin_pct' END]),
  ('dates_within_data_range', 'error', [CASE WHEN bad THEN 'daily' END]),
  ('results_cover_the_window', 'warning', [CASE WHEN ov > 0 AND ov < len(months) THEN 'daily' END]),
  ('dimension_coverage', 'warning', [CASE WHEN top_n IS NULL AND cn > 0 AND nc > 0
                                          AND nc < {dict(P.exhaustive_dimensions)['channel']} THEN 'by_channel' END])
  ) u(name, severity, ids))"""


@register("verify_batch_report", O.with_star("""
SELECT a AS answer_id, name, severity, len(ids) = 0 AS passed,
  CASE WHEN name = 'parts_sum_to_total' THEN least(1, len(ids)) ELSE len(ids) END AS n_offenders,
  array_to_string(ids, ',') AS result_ids FROM offs""", extra_ctes=BATCH_CTES))
def verify_batch_report(star, spark, sf_dir):
    """The thirteen checks for one answer per store and month, in one plan (V-01 ... V-13, C-01 ... C-06)."""
    answers, results, cells = batch_inputs(star)
    rep = B.verify_batch(answers, results, cells, F.col("months"), P)
    return rep.withColumn("result_ids", F.array_join("result_ids", ","))


@register("verify_batch_verdicts", O.with_star("""
SELECT a AS answer_id, CASE WHEN e > 0 THEN 'failed' WHEN w > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS status,
  e AS errors, w AS warnings, array_to_string(list_sort(list_distinct(b)), ',') AS blamed
FROM (SELECT a, COUNT(CASE WHEN severity = 'error' AND len(ids) > 0 THEN 1 END) AS e,
             COUNT(CASE WHEN severity = 'warning' AND len(ids) > 0 THEN 1 END) AS w,
             flatten(list(CASE WHEN severity = 'error' THEN ids ELSE [] END)) AS b FROM offs GROUP BY a) x""",
                                             extra_ctes=BATCH_CTES))
def verify_batch_verdicts(star, spark, sf_dir):
    """Status and blamed results of every answer (V-14, V-15)."""
    answers, results, cells = batch_inputs(star)
    out = B.verdicts(B.verify_batch(answers, results, cells, F.col("months"), P))
    return out.withColumn("blamed", F.array_join("blamed", ","))
