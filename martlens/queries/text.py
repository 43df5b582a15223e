"""Registered text jobs: entity resolution (E-*), claim audit (N-*), text functions (F-10 ... F-15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from martlens import oracle as O
from martlens.functions import scalars as S
from martlens.plans import entities as E
from martlens.profile import TESTDATA as P
from martlens.registry import register

W = O.window_pred(P)


# --- mention texts, derived from the window's orders (same rule in Spark and SQL) -----------
def mention_texts(star):
    """One question per order, naming its store, geography and attributes; every eighth also
    names an identifier that the catalogue does not know."""
    wo = star.wide_orders
    k = F.col("order_id") % 4
    seg = F.coalesce(F.lower("customer_segment"), F.lit("walk-in"))
    num = F.substring("store_id", 3, 18).cast("int").cast("string")
    unknown = F.when(F.col("order_id") % 8 == 0, F.concat(F.lit(" against QX"), (F.col("order_id") % 97).cast("string"))
                     ).otherwise(F.lit(""))
    text = (F.when(k == 0, F.concat(F.lit("How is ST"), num, F.lit(" doing in "), F.col("city"), F.lit(" for "), seg, F.lit("s"), unknown,
                                    F.lit("?")))
            .when(k == 1, F.concat(F.lit("Compare "), F.col("store_name"), F.lit(" and "), F.col("day_name"),
                                   F.lit(" sales on "), F.lower("day_type"), F.lit("s")))
            .when(k == 2, F.concat(F.lit("Were delivery orders at "), F.col("store_format"), F.lit(" stores up on "),
                                   F.col("channel"), F.lit("?")))
            .otherwise(F.concat(F.lit("Show "), F.lower("region"), F.lit(" "), F.col("festive_period"),
                                F.lit(" margin in "), F.col("month_key"))))
    return wo.select(F.col("order_id").alias("text_id"), text.alias("text"))


TEXTS_SQL = f"""texts AS (
  SELECT order_id AS text_id,
    CASE order_id % 4
      WHEN 0 THEN 'How is ST' || CAST(CAST(substr(store_id, 3) AS INTEGER) AS VARCHAR) || ' doing in ' || city
                  || ' for ' || COALESCE(lower(customer_segment), 'walk-in') || 's'
                  || CASE WHEN order_id % 8 = 0 THEN ' against QX' || CAST(order_id % 97 AS VARCHAR) ELSE '' END || '?'
      WHEN 1 THEN 'Compare ' || store_name || ' and ' || day_name || ' sales on ' || lower(day_type) || 's'
      WHEN 2 THEN 'Were delivery orders at ' || store_format || ' stores up on ' || channel || '?'
      ELSE 'Show ' || lower(region) || ' ' || festive_period || ' margin in ' || month_key END AS text
  FROM wide_orders)"""


def _lit_list(vals) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in vals)


def catalogue_sql() -> str:
    parts = []
    for dim, table, col, ident in E.DIMENSIONS:
        v = f"CAST({col} AS VARCHAR)"
        parts.append(f"SELECT DISTINCT '{dim}' AS dimension, '{table}.{col}' AS \"column\", {v} AS value, "
                     f"{'TRUE' if ident else 'FALSE'} AS is_identifier FROM {table} "
                     f"WHERE {v} IS NOT NULL AND trim({v}) <> ''")
    return "cat AS (" + " UNION ALL ".join(parts) + ")"


def _alias_values() -> str:
    rows = ([(a, "city", v) for a, v in E.CITY_ALIASES.items()] + [(a, "channel", v) for a, v in E.CHANNEL_ALIASES.items()]
            + [(w, "channel", ch) for w in E.DELIVERY_WORDS for ch in P.delivery_channels])
    return ", ".join(f"('{a}', '{d}', '{t}')" for a, d, t in rows)


TOK = "[A-Za-z0-9&''\\-]+"
PIECES = "[A-Za-z0-9&''\\-]+|[^A-Za-z0-9&''\\-]+"
IDENT = "^([A-Za-z]{2,4})(\\d{1,6})$"


def resolve_sql(texts_cte: str) -> str:
    return f"""{texts_cte},
{catalogue_sql()},
tk AS (SELECT text_id, p, list_filter(range(1, len(p) + 1), lambda i: regexp_full_match(p[i], '{TOK}')) AS t
       FROM (SELECT text_id, regexp_extract_all(text, '{PIECES}') AS p FROM texts) x),
ph0 AS (SELECT text_id, p, t, unnest(range(0, len(t))) AS start FROM tk WHERE len(t) > 0),
ph1 AS (SELECT text_id, p, t, start, unnest(range(1, least(4, len(t) - start) + 1)) AS n_tokens FROM ph0),
ph AS (SELECT text_id, start, start + n_tokens - 1 AS "end", n_tokens,
              trim(array_to_string(p[t[start + 1]:t[start + n_tokens]], '')) AS phrase FROM ph1),
phs AS (SELECT *, lower(phrase) AS k FROM ph
        WHERE phrase <> '' AND NOT (n_tokens = 1 AND lower(phrase) IN ({_lit_list(E.STOPWORDS)}))),
al AS (SELECT a.alias, c.dimension, c."column", c.value
       FROM (VALUES {_alias_values()}) a(alias, dimension, target)
       JOIN cat c ON a.dimension = c.dimension AND lower(a.target) = lower(c.value)),
t1 AS (SELECT s.text_id, s.start, s."end", s.n_tokens, s.phrase, c.dimension, c."column", c.value,
              CASE WHEN s.phrase = c.value THEN 1.0 ELSE 0.98 END AS confidence, 'exact' AS method, 1 AS tier
       FROM phs s JOIN cat c ON s.k = lower(c.value)),
t2 AS (SELECT s.text_id, s.start, s."end", s.n_tokens, s.phrase, a.dimension, a."column", a.value,
              0.95 AS confidence, 'alias' AS method, 2 AS tier FROM phs s JOIN al a ON s.k = a.alias),
ids AS (SELECT dimension, "column", value, lower(regexp_extract(trim(value), '{IDENT}', 1)) AS ip,
               CAST(regexp_extract(trim(value), '{IDENT}', 2) AS BIGINT) AS inum
        FROM cat WHERE is_identifier AND regexp_matches(trim(value), '{IDENT}')),
t3 AS (SELECT s.text_id, s.start, s."end", s.n_tokens, s.phrase, i.dimension, i."column", i.value,
              CASE WHEN upper(s.phrase) = upper(i.value) THEN 1.0 ELSE 0.95 END AS confidence,
              'identifier' AS method, 3 AS tier
       FROM phs s JOIN ids i ON s.n_tokens = 1 AND regexp_matches(trim(s.phrase), '{IDENT}')
         AND lower(regexp_extract(trim(s.phrase), '{IDENT}', 1)) = i.ip
         AND CAST(regexp_extract(trim(s.phrase), '{IDENT}', 2) AS BIGINT) = i.inum),
nd AS (SELECT *, CASE WHEN length(k) > 4 AND suffix(k, 's') THEN substr(k, 1, length(k) - 1) ELSE k END AS needle
       FROM phs),
sf AS (SELECT dimension, "column", value, substr(lower(value), i) AS sfx
       FROM (SELECT dimension, "column", value, unnest(range(1, greatest(length(value), 1) + 1)) AS i
             FROM cat WHERE NOT is_identifier) x
       WHERE (i = 1 OR regexp_full_match(substr(lower(value), i - 1, 1), '\\s'))
         AND length(substr(lower(value), i)) >= 4),
t4 AS (SELECT DISTINCT n.text_id, n.start, n."end", n.n_tokens, n.phrase, f.dimension, f."column", f.value,
              0.8 AS confidence, 'substring' AS method, 4 AS tier
       FROM nd n JOIN sf f ON length(n.needle) >= 4 AND substr(n.needle, 1, 4) = substr(f.sfx, 1, 4)
         AND starts_with(f.sfx, n.needle)),
cands AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4),
won AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY text_id, start, "end") AS mt FROM cands) x
        WHERE tier = mt),
spans AS (SELECT text_id, list_sort(list({{'neg': -n_tokens, 'start': start, 'end': "end"}})) AS s
          FROM (SELECT DISTINCT text_id, start, "end", n_tokens FROM won) x GROUP BY text_id),
acc AS (SELECT text_id, unnest(list_reduce(s, lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.start <= x."end"
                AND x.start <= y."end")) > 0 THEN a ELSE list_append(a, x) END,
                []::STRUCT(neg BIGINT, start BIGINT, "end" BIGINT)[])) AS sp FROM spans),
kept AS (SELECT w.* FROM won w JOIN acc a ON w.text_id = a.text_id AND w.start = a.sp.start AND w."end" = a.sp."end"),
ranked AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY confidence DESC, dimension, value, start)
             AS match_rank FROM kept),
matches AS (SELECT text_id, phrase AS text, dimension, "column", value, CAST(confidence AS DOUBLE) AS confidence,
                   method, match_rank FROM ranked)"""


RESOLVE = resolve_sql(TEXTS_SQL)


def _resolve(star, fuzzy: bool, max_matches: int | None = None):
    """All matches of the mention texts; only the ordered list of E-09 has a cap."""
    found = E.resolved(star, mention_texts(star), "mentions", fuzzy=fuzzy)
    return found.where(F.col("match_rank") <= max_matches) if max_matches is not None else found


@register("entity_resolution_exact_tiers", O.with_star(
    f"SELECT * FROM matches WHERE match_rank <= {E.MAX_MATCHES}", extra_ctes=RESOLVE))
def entity_resolution_exact_tiers(star, spark, sf_dir):
    """Resolve mentions by the exact, alias, identifier and substring tiers (E-01 ... E-09, J-10, F-11, F-12)."""
    return _resolve(star, fuzzy=False, max_matches=E.MAX_MATCHES)


@register("entity_resolution_full", None)
def entity_resolution_full(star, spark, sf_dir):
    """All five tiers including the similarity ratio (E-06); rows-only: the ratio has no SQL equivalent."""
    return _resolve(star, fuzzy=True, max_matches=E.MAX_MATCHES)


@register("entity_ambiguity", O.with_star(f"""
SELECT text_id, text, n_dimensions, candidates FROM (
  SELECT text_id, lt AS text, COUNT(DISTINCT dimension) AS n_dimensions,
         array_to_string(list_sort(list(DISTINCT dimension || ':' || value)), ';') AS candidates
  FROM (SELECT *, lower(text) AS lt, max(confidence) OVER (PARTITION BY text_id, lower(text)) AS best FROM matches) m
  WHERE best - confidence <= {E.AMBIGUITY_BAND} + 1e-12 GROUP BY text_id, lt) g WHERE n_dimensions >= 2""",
                                            extra_ctes=RESOLVE))
def entity_ambiguity(star, spark, sf_dir):
    """Phrases matching two or more dimensions with close confidence (E-10)."""
    return E.ambiguous(_resolve(star, fuzzy=False))


@register("entity_by_dimension", O.with_star("""
SELECT text_id, dimension, COUNT(*) AS n_matches, array_to_string(list_sort(list(DISTINCT value)), ',') AS "values"
FROM matches GROUP BY text_id, dimension""", extra_ctes=RESOLVE))
def entity_by_dimension(star, spark, sf_dir):
    """Resolved values grouped per text and dimension (E-11)."""
    return E.group_by_dimension(_resolve(star, fuzzy=False))


@register("entity_catalogue_counts", O.with_star(
    "SELECT dimension, \"column\", is_identifier, COUNT(*) AS n_values FROM cat GROUP BY ALL",
    extra_ctes=catalogue_sql()))
def entity_catalogue_counts(star, spark, sf_dir):
    """Size of the catalogue per dimension (E-01, P-11)."""
    return E.lookup_tables(star)[0].groupBy("dimension", "column", "is_identifier").agg(F.count(F.lit(1)).alias("n_values"))


@register("topic_tags_conversations", f"""
SELECT conv_id, turn, {" ".join(
    f"CASE WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in words)} THEN {i + 1} ELSE"
    for i, (words, _l) in enumerate(E.TOPIC_RULES))} 0 {"END " * len(E.TOPIC_RULES)}AS rule,
  {" ".join(f"CASE WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{label}' ELSE"
            for words, label in E.TOPIC_RULES)} '{E.DEFAULT_TOPIC}' {"END " * len(E.TOPIC_RULES)}AS topic
FROM conversations""")
def topic_tags_conversations(star, spark, sf_dir):
    """First matching topic rule per conversation turn, over the whole conversations table (E-13)."""
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return E.topic_tag(conv.select("conv_id", "turn", "text"))


# --- claim audit (N-01 ... N-07) ---------------------------------------------------------------
from martlens.plans import analyses as A  # noqa: E402
from martlens.plans import claims as C  # noqa: E402
from martlens.queries.core import Q2_BASE  # noqa: E402

_M1, _M3 = P.window().months()[0], P.window().months()[-1]


#: Answers about customers come after those about stores.
CUSTOMER_ANSWERS = 1_000_000_000

_CLAIM_MEMO: dict[tuple[str, str], tuple] = {}


def _answer_text(who, subject, tail):
    """The wording of an answer, over columns of a row per subject."""
    fmt = lambda c: F.format_number(F.floor(c).cast("long"), 0)
    return F.concat(
        subject, F.lit(" ("), who, F.lit(") earned "), fmt(F.col("revenue")),
        F.lit(" INR from "), F.col("orders").cast("string"), F.lit(" orders, about "),
        fmt(F.col("revenue") / 1000.0), F.lit(" thousand; AOV "), fmt(F.col("aov")), F.lit(". A rival claim of "),
        fmt(F.col("revenue") * 1.37), F.lit(" INR ("), tail,
        F.lit(". May to July moved by "), fmt(F.abs(F.col("_m3") - F.col("_m1"))), F.lit(" INR."))


def _month_ends(monthly, key):
    return monthly.groupBy(key).agg(
        F.coalesce(F.max(F.when(F.col("month_key") == _M1, F.col("revenue"))), F.lit(0.0)).alias("_m1"),
        F.coalesce(F.max(F.when(F.col("month_key") == _M3, F.col("revenue"))), F.lit(0.0)).alias("_m3"))


def claim_inputs(star):
    """Answers written about each store of the window ranking and each customer of the window, and the cells
    they were written from; stored once per application, since five queries audit them."""
    from martlens.operators.numbering import stored
    from martlens.session import app_key

    key = (app_key(star.fact_orders.sparkSession), f"{star.source}|{star.profile.name}")
    if key in _CLAIM_MEMO:
        return _CLAIM_MEMO[key]
    rank = A.store_ranking(star)
    wo = star.wide_orders.filter(F.col("order_date").between(F.lit(P.window_start), F.lit(P.window_end)))
    revenue = F.sum("net_before_tax").cast("double").alias("revenue")
    monthly = wo.groupBy("store_id", "month_key").agg(revenue)
    aid = F.substring("store_id", 3, 18).cast("long")
    stores = rank.join(_month_ends(monthly, "store_id"), "store_id", "left").select(
        aid.alias("answer_id"), _answer_text(F.col("store_name"), F.col("store_id"), F.concat(
            F.floor("revenue_share_pct").cast("long").cast("string"), F.lit("% share) in 2001-06 for 2001 lists ST0"),
            F.substring("store_id", 3, 18))).alias("text"), F.lit(0.85).alias("confidence"),
        (F.col("rank") > 20).alias("verification_failed"))

    # one answer per customer with orders in the window
    named = wo.where(F.col("customer_id").isNotNull()).withColumn("customer", F.concat(F.lit("CU"), F.col("customer_id").cast("string")))
    by_month = named.groupBy("customer", "month_key").agg(revenue)
    number = F.substring("customer", 3, 18)
    cid = number.cast("long") + CUSTOMER_ANSWERS
    profile = named.groupBy("customer", "customer_segment").agg(
        revenue, F.count("order_id").alias("orders"), F.sum("total_qty").cast("long").alias("units")).withColumn(
        "aov", S.safe_ratio("revenue", "orders"))
    customers = profile.join(_month_ends(by_month, "customer"), "customer").select(
        cid.alias("answer_id"), _answer_text(F.col("customer_segment"), F.col("customer"), F.concat(
            F.lit("the largest) in 2001-06 for 2001 lists CU0"), number)).alias("text"), F.lit(0.85).alias("confidence"),
        (number.cast("long") % 10 == 0).alias("verification_failed"))
    cells = [C.long_cells(aid, "ranking", rank),
             C.long_cells(aid, "monthly", monthly.select("store_id", "month_key", "revenue")),
             C.long_cells(cid, "profile", profile), C.long_cells(cid, "monthly", by_month)]
    _CLAIM_MEMO[key] = (stored(stores.unionByName(customers), "claim-answers"),
                        stored(cells[0].unionByName(cells[1]).unionByName(cells[2]).unionByName(cells[3]), "claim-cells"))
    return _CLAIM_MEMO[key]


CLAIM_CTES = Q2_BASE + f""",
mon AS (SELECT store_id, month_key, CAST(SUM(net_before_tax) AS DOUBLE) AS revenue FROM wide_orders WHERE {W}
        GROUP BY store_id, month_key),
ends AS (SELECT store_id, COALESCE(MAX(CASE WHEN month_key = '{_M1}' THEN revenue END), 0.0) AS m1,
                COALESCE(MAX(CASE WHEN month_key = '{_M3}' THEN revenue END), 0.0) AS m3 FROM mon GROUP BY store_id),
cu AS (SELECT *, 'CU' || CAST(customer_id AS VARCHAR) AS customer FROM wide_orders WHERE {W} AND customer_id IS NOT NULL),
cmon AS (SELECT customer, month_key, CAST(SUM(net_before_tax) AS DOUBLE) AS revenue FROM cu GROUP BY customer, month_key),
cends AS (SELECT customer, COALESCE(MAX(CASE WHEN month_key = '{_M1}' THEN revenue END), 0.0) AS m1,
                 COALESCE(MAX(CASE WHEN month_key = '{_M3}' THEN revenue END), 0.0) AS m3 FROM cmon GROUP BY customer),
cpro AS (SELECT *, {O.safe_ratio('revenue', 'orders')} AS aov FROM (
           SELECT customer, customer_segment, CAST(SUM(net_before_tax) AS DOUBLE) AS revenue, COUNT(order_id) AS orders,
                  CAST(SUM(total_qty) AS BIGINT) AS units FROM cu GROUP BY customer, customer_segment) x),
answers AS (
  SELECT CAST(substr(r.store_id, 3) AS BIGINT) AS answer_id,
    r.store_id || ' (' || r.store_name || ') earned ' || format('{{:,}}', CAST(floor(r.revenue) AS BIGINT))
    || ' INR from ' || CAST(r.orders AS VARCHAR) || ' orders, about '
    || format('{{:,}}', CAST(floor(r.revenue / 1000.0) AS BIGINT)) || ' thousand; AOV '
    || format('{{:,}}', CAST(floor(r.aov) AS BIGINT)) || '. A rival claim of '
    || format('{{:,}}', CAST(floor(r.revenue * 1.37) AS BIGINT)) || ' INR ('
    || CAST(CAST(floor(r.revenue_share_pct) AS BIGINT) AS VARCHAR) || '% share) in 2001-06 for 2001 lists ST0'
    || substr(r.store_id, 3) || '. May to July moved by '
    || format('{{:,}}', CAST(floor(abs(e.m3 - e.m1)) AS BIGINT)) || ' INR.' AS text,
    0.85 AS confidence, r.rank > 20 AS verification_failed
  FROM ranked r LEFT JOIN ends e ON r.store_id = e.store_id
  UNION ALL
  SELECT {CUSTOMER_ANSWERS} + CAST(substr(r.customer, 3) AS BIGINT),
    r.customer || ' (' || r.customer_segment || ') earned ' || format('{{:,}}', CAST(floor(r.revenue) AS BIGINT))
    || ' INR from ' || CAST(r.orders AS VARCHAR) || ' orders, about '
    || format('{{:,}}', CAST(floor(r.revenue / 1000.0) AS BIGINT)) || ' thousand; AOV '
    || format('{{:,}}', CAST(floor(r.aov) AS BIGINT)) || '. A rival claim of '
    || format('{{:,}}', CAST(floor(r.revenue * 1.37) AS BIGINT)) || ' INR (the largest) in 2001-06 for 2001 lists CU0'
    || substr(r.customer, 3) || '. May to July moved by '
    || format('{{:,}}', CAST(floor(abs(e.m3 - e.m1)) AS BIGINT)) || ' INR.',
    0.85, CAST(substr(r.customer, 3) AS BIGINT) % 10 = 0
  FROM cpro r JOIN cends e ON r.customer = e.customer),
cells AS (
  SELECT CAST(substr(store_id, 3) AS BIGINT) AS answer_id, 'ranking' AS result_id, u.col AS "column",
         u.num, u.str
  FROM ranked, (SELECT 1) d,
  LATERAL (VALUES ('store_id', NULL, store_id), ('store_name', NULL, store_name), ('city', NULL, city),
                  ('region', NULL, region), ('revenue', revenue, NULL), ('orders', CAST(orders AS DOUBLE), NULL),
                  ('units', CAST(units AS DOUBLE), NULL), ('aov', aov, NULL),
                  ('units_per_order', units_per_order, NULL), ('revenue_share_pct', revenue_share_pct, NULL),
                  ('rank', CAST(rank AS DOUBLE), NULL)) u(col, num, str)
  UNION ALL
  SELECT CAST(substr(store_id, 3) AS BIGINT), 'monthly', u.col, u.num, u.str
  FROM mon, LATERAL (VALUES ('store_id', NULL, store_id), ('month_key', NULL, month_key),
                            ('revenue', revenue, NULL)) u(col, num, str)
  UNION ALL
  SELECT {CUSTOMER_ANSWERS} + CAST(substr(customer, 3) AS BIGINT), 'profile', u.col, u.num, u.str
  FROM cpro, LATERAL (VALUES ('customer', NULL, customer), ('customer_segment', NULL, customer_segment),
                             ('revenue', revenue, NULL), ('orders', CAST(orders AS DOUBLE), NULL),
                             ('units', CAST(units AS DOUBLE), NULL), ('aov', aov, NULL)) u(col, num, str)
  UNION ALL
  SELECT {CUSTOMER_ANSWERS} + CAST(substr(customer, 3) AS BIGINT), 'monthly', u.col, u.num, u.str
  FROM cmon, LATERAL (VALUES ('customer', NULL, customer), ('month_key', NULL, month_key),
                             ('revenue', revenue, NULL)) u(col, num, str)),
fa AS (SELECT answer_id, regexp_replace(text, '{C.DATE_LIKE_RE}', ' ', 'g') AS m FROM answers),
ft AS (SELECT answer_id, regexp_extract_all(m, '{C.NUMBER_RE}') AS t, regexp_split_to_array(m, '{C.NUMBER_RE}') AS s
       FROM fa),
fx AS (SELECT answer_id, t, s, unnest(range(0, len(t))) AS i FROM ft),
figs AS (SELECT answer_id, position, token, value FROM (
           SELECT answer_id, i AS position, t[i + 1] AS token, substr(s[i + 2], 1, 1) AS trail,
                  CAST(replace(t[i + 1], ',', '') AS DOUBLE) AS value FROM fx) x
         WHERE trail <> '%' AND token NOT IN ({", ".join(repr(y) for y in P.data_years())})
           AND value >= {P.min_checked_magnitude}),
sv AS (SELECT DISTINCT f.answer_id, f.position FROM figs f JOIN cells c ON f.answer_id = c.answer_id
         AND c.num IS NOT NULL,
       (VALUES {", ".join(f"({float(s)})" for s in P.scale_factors)}) sc(scale)
       WHERE abs(f.value * sc.scale - c.num) <= greatest(abs(c.num) * {P.number_match_tolerance}, 0.5)),
cv AS (SELECT answer_id, result_id, "column", num FROM cells WHERE num IS NOT NULL),
mv AS (SELECT cv.* FROM cv JOIN (SELECT answer_id, result_id, "column" FROM cv GROUP BY ALL HAVING COUNT(*) > 1) g
         USING (answer_id, result_id, "column")),
sd AS (SELECT DISTINCT f.answer_id, f.position FROM figs f JOIN mv a ON f.answer_id = a.answer_id
       JOIN mv b ON a.answer_id = b.answer_id AND a.result_id = b.result_id AND a."column" = b."column"
       WHERE b.num >= a.num + f.value - greatest(abs(f.value) * {P.number_match_tolerance}, 0.5)
         AND b.num <= a.num + f.value + greatest(abs(f.value) * {P.number_match_tolerance}, 0.5)),
unsup AS (SELECT answer_id, token, MIN(position) AS first_position FROM figs f
          WHERE NOT EXISTS (SELECT 1 FROM sv WHERE sv.answer_id = f.answer_id AND sv.position = f.position)
            AND NOT EXISTS (SELECT 1 FROM sd WHERE sd.answer_id = f.answer_id AND sd.position = f.position)
          GROUP BY answer_id, token),
idents AS (SELECT DISTINCT answer_id, unnest(regexp_extract_all(text, '{C.IDENTIFIER_RE}')) AS token FROM answers),
unsup_id AS (SELECT i.* FROM idents i WHERE NOT EXISTS (
               SELECT 1 FROM cells c WHERE c.answer_id = i.answer_id AND c.str IS NOT NULL AND contains(c.str, i.token)))"""


@register("claim_cells_long", O.with_star("SELECT * FROM cells", extra_ctes=CLAIM_CTES))
def claim_cells_long(star, spark, sf_dir):
    """Numeric and string cells of the results behind each answer, in long form (N-01)."""
    return claim_inputs(star)[1]


@register("claim_figures", O.with_star("SELECT * FROM figs", extra_ctes=CLAIM_CTES))
def claim_figures(star, spark, sf_dir):
    """Figure candidates after masking dates, rates, data years and small numbers (N-02, F-13)."""
    return C.figures(claim_inputs(star)[0], P)


@register("claim_unsupported_figures", O.with_star("SELECT * FROM unsup", extra_ctes=CLAIM_CTES))
def claim_unsupported_figures(star, spark, sf_dir):
    """Figures no value (at any scale, range join J-08) and no within-column difference supports (N-03 ... N-05)."""
    answers, cells = claim_inputs(star)
    return C.unsupported_figures(answers, cells, P)


@register("claim_unsupported_identifiers", O.with_star("SELECT * FROM unsup_id", extra_ctes=CLAIM_CTES))
def claim_unsupported_identifiers(star, spark, sf_dir):
    """Identifier tokens not contained in any string cell (N-06, F-14)."""
    answers, cells = claim_inputs(star)
    return C.unsupported_identifiers(answers, cells)


@register("claim_confidence", O.with_star(f"""
SELECT a.answer_id, u.answer_id IS NOT NULL AS has_unsupported_figure,
  CAST(CASE WHEN a.verification_failed THEN least(
         CASE WHEN u.answer_id IS NOT NULL THEN round(CAST(a.confidence AS DECIMAL(6,4)) * CAST(0.7 AS DECIMAL(2,1)), 2)
              ELSE CAST(a.confidence AS DECIMAL(6,4)) END, CAST({C.UNVERIFIED_CEILING} AS DECIMAL(6,4)))
       ELSE CASE WHEN u.answer_id IS NOT NULL THEN round(CAST(a.confidence AS DECIMAL(6,4)) * CAST(0.7 AS DECIMAL(2,1)), 2)
              ELSE CAST(a.confidence AS DECIMAL(6,4)) END END AS DOUBLE) AS adjusted_confidence
FROM answers a LEFT JOIN (SELECT DISTINCT answer_id FROM unsup) u ON a.answer_id = u.answer_id""",
                                           extra_ctes=CLAIM_CTES))
def claim_confidence(star, spark, sf_dir):
    """Confidence x0.7 on an unsupported figure, capped at 0.4 when verification failed (N-07)."""
    answers, cells = claim_inputs(star)
    return C.adjusted_confidence(answers, C.unsupported_figures(answers, cells, P))


@register("entity_unresolved_identifiers", O.with_star(f"""
SELECT t.text_id, t.token FROM (SELECT DISTINCT text_id, unnest(regexp_extract_all(text, '{E.TOKEN_RE.replace("'", "''")}'))
                                  AS token FROM texts) t
WHERE regexp_matches(t.token, '{IDENT}')
  AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.text_id = t.text_id AND m.text = t.token)""", extra_ctes=RESOLVE))
def entity_unresolved_identifiers(star, spark, sf_dir):
    """Identifier-shaped tokens that resolved to nothing (E-12)."""
    return E.unresolved_identifiers(mention_texts(star), _resolve(star, fuzzy=False))
