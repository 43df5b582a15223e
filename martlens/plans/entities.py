"""Entity resolution of free text against dimension values, as a batch job (E-01 ... E-13).

Mention-to-catalogue joins (J-10). Texts are the large side; the catalogue (distinct dimension values) is joined
to them by the planner: broadcast when its size is checked to be small, a
shuffle join otherwise (an identifier dimension such as SKU can be as large as
the product table).

A text is cut into alternating token / separator pieces, row by row, and every
1-4 token phrase is the concatenation of the pieces between its first and last
token, so separators inside a phrase are kept exactly as written. Each phrase
is matched by five tiers, all as joins:

1. exact (1.0, or 0.98 case-folded)       equi-join on lower(phrase)
2. alias (0.95)                             equi-join on the alias table
3. identifier (1.0 as written, else 0.95)  equi-join on (lower prefix, number)
4. word-start substring (0.8)               equi-join on the first 4 needle
                                            characters against every word-start
                                            suffix of a value, then startswith
5. fuzzy (0.7 x ratio)                      length-band join, then an Arrow UDF
                                            computing the similarity ratio on
                                            distinct (token, value) pairs

The first tier that hits wins per phrase. Longer phrases then claim their
tokens greedily (size descending, then left to right); matches are ordered by
confidence, dimension, value and capped per text.

Most phrases name nothing. A bit set of the hashes of the dictionary's keys (of
bounded size) is broadcast, and the texts are read once: only phrases that the
dictionary may hold, a few per cent of the others and words long enough for
tier 5 are written. The tiers are worked out once per distinct phrase of these, and what
a text's phrases won is found by one join. Claims and ranks work on numbers
of phrases and matches; the matched values are attached last.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.functions.arrays import covered, let, picked
from martlens.operators.joins import broadcast_if_small, broadcast_literal, is_small
from martlens.operators.numbering import stored
from martlens.sources.star import Star

# --- Fixed values of the matching rules (must equal the source system's) -------------
FUZZY_THRESHOLD = 0.84
MIN_FUZZY_LENGTH = 5
MIN_SUBSTRING_LENGTH = 4
CONFIDENCE_EXACT = 1.0
CONFIDENCE_CASE_INSENSITIVE = 0.98
CONFIDENCE_NORMALISED_ID = 0.95
CONFIDENCE_ALIAS = 0.95
CONFIDENCE_SUBSTRING = 0.8
CONFIDENCE_FUZZY_BASE = 0.7
AMBIGUITY_BAND = 0.1
MAX_MATCHES = 24
MAX_WORDS = 4
FUZZY_BAND = 0.02

STOPWORDS = (
    "all", "and", "any", "are", "average", "best", "between", "both", "but",
    "compare", "comparison", "count", "customer", "customers", "data",
    "day", "days", "did", "does", "doing", "down", "drop", "each", "every",
    "for", "from", "growth", "had", "has", "have", "high", "highest", "how",
    "into", "last", "least", "low", "lowest", "many", "margin",
    "month", "months", "most", "much", "new", "not", "off", "old", "only",
    "order", "orders", "our", "over", "per", "performance", "performing",
    "product", "products", "quarter", "rank", "ranking", "rate", "revenue",
    "sales", "segment", "share", "show", "since", "sold", "store", "stores",
    "than", "that", "the", "their", "these", "they", "this", "top", "total",
    "trend", "units", "value", "versus", "was", "week", "weeks", "were",
    "what", "when", "where", "which", "who", "why", "with", "worst", "year",
    "years",
)
CITY_ALIASES = {
    "bangalore": "Bengaluru", "banglore": "Bengaluru", "blr": "Bengaluru", "bombay": "Mumbai",
    "calcutta": "Kolkata", "madras": "Chennai", "gurgaon": "Gurugram", "ggn": "Gurugram",
    "trivandrum": "Thiruvananthapuram", "poona": "Pune", "mysore": "Mysuru", "baroda": "Vadodara",
    "cochin": "Kochi", "pondicherry": "Puducherry", "new delhi": "Delhi", "ncr": "Delhi", "hyd": "Hyderabad",
}
CHANNEL_ALIASES = {
    "dine in": "Dine-in", "dinein": "Dine-in", "eat in": "Dine-in", "take away": "Takeaway",
    "takeout": "Takeaway", "take out": "Takeaway", "pickup": "Takeaway", "pick up": "Takeaway",
}
DELIVERY_WORDS = ("delivery", "aggregator", "aggregators", "online")

TOKEN_CLASS = "A-Za-z0-9&'\\-"
TOKEN_RE = f"[{TOKEN_CLASS}]+"
PIECES_RE = f"([{TOKEN_CLASS}]+|[^{TOKEN_CLASS}]+)"
IDENT_RE = r"^([A-Za-z]{2,4})(\d{1,6})$"

# (dimension, star table, column, is_identifier)
DIMENSIONS = (
    ("store_id", "dim_store", "store_id", True),
    ("store_name", "dim_store", "store_name", False),
    ("city", "dim_store", "city", False),
    ("region", "dim_store", "region", False),
    ("store_format", "dim_store", "store_format", False),
    ("sku_id", "dim_product", "sku_id", True),
    ("sku_name", "dim_product", "sku_name", False),
    ("category", "dim_product", "category", False),
    ("veg_nonveg", "dim_product", "veg_nonveg", False),
    ("channel", "fact_orders", "channel", False),
    ("customer_segment", "dim_customer", "customer_segment", False),
    ("promo_name", "dim_promotion", "promo_name", False),
    ("promo_type", "dim_promotion", "promo_type", False),
    ("festive_period", "dim_calendar", "festive_period", False),
    ("day_name", "dim_calendar", "day_name", False),
    ("day_type", "dim_calendar", "day_type", False),
)
TOPIC_RULES = (
    (("competitor", "competitors", "rival", "market share", "mcdonald", "kfc", "domino", "burger king", "subway",
      "starbucks", "industry", "versus the market", "peers"), "competitors"),
    (("weather", "rain", "temperature", "monsoon", "climate", "season forecast"), "weather"),
    (("staff", "employee", "headcount", "labour", "labor", "manager", "shift", "hiring", "wages", "salary",
      "attrition"), "staffing"),
    (("marketing spend", "ad spend", "advertising", "campaign cost", "cac", "acquisition cost", "budget",
      "roi on marketing"), "marketing"),
    (("rent", "overhead", "utilities", "electricity", "fixed cost", "operating cost", "opex", "profit after",
      "net profit", "ebitda"), "costs"),
    (("review", "rating", "nps", "complaint", "satisfaction", "feedback", "sentiment", "opinion", "survey"),
     "opinion"),
    (("forecast", "predict", "projection", "next year", "next month", "next quarter", "will we", "expect",
      "future", "2027"), "forecast"),
    (("delivery time", "eta", "driver", "rider", "logistics", "preparation time", "wait time", "queue"),
     "fulfilment"),
    (("stock", "inventory", "wastage", "waste", "spoilage", "supplier", "procurement", "shelf life"), "inventory"),
)
DEFAULT_TOPIC = "answerable"

MATCH_SCHEMA = ("text_id long, text string, dimension string, column string, value string, confidence double, "
                "method string")


# --- E-01: catalogue ----------------------------------------------------------------------
def catalogue(star: Star) -> DataFrame:
    """Distinct non-blank values of the 16 dimensions (E-01, P-11)."""
    tables = star.tables()
    parts = []
    for dim, table, col, ident in DIMENSIONS:
        v = F.col(col).cast("string")
        parts.append(tables[table].select(v.alias("value")).filter(v.isNotNull() & (F.trim(v) != "")).distinct()
                     .select(F.lit(dim).alias("dimension"), F.lit(f"{table}.{col}").alias("column"), "value",
                             F.lit(ident).alias("is_identifier")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def alias_table(cat: DataFrame, delivery_channels: tuple[str, ...]) -> DataFrame:
    """Aliases filtered to values that exist (E-07); delivery words name every delivery channel."""
    spark = cat.sparkSession
    rows = ([(a, "city", v) for a, v in CITY_ALIASES.items()] + [(a, "channel", v) for a, v in CHANNEL_ALIASES.items()]
            + [(w, "channel", ch) for w in DELIVERY_WORDS for ch in delivery_channels])
    al = broadcast_literal(spark.createDataFrame(rows, "alias string, dimension string, target string"))
    c = cat.select("dimension", "column", "value", F.lower("value").alias("target_l"))
    return (al.join(c, (al.dimension == c.dimension) & (F.lower(al.target) == c.target_l))
            .select("alias", c.dimension, "column", "value"))


# --- F-10 ... F-12 helpers --------------------------------------------------------------------
def singular(c: Column) -> Column:
    """F-11: lower-case; drop a trailing 's' when longer than 4 characters."""
    return _without_s(F.lower(c))


def _without_s(low: Column) -> Column:
    return F.when((F.length(low) > MIN_SUBSTRING_LENGTH) & low.endswith("s"),
                  low.substr(F.lit(1), F.length(low) - 1)).otherwise(low)


def ident_prefix(c: Column) -> Column:
    return F.when(F.trim(c).rlike(IDENT_RE), F.lower(F.regexp_extract(F.trim(c), IDENT_RE, 1)))


def ident_number(c: Column) -> Column:
    return F.when(F.trim(c).rlike(IDENT_RE), F.regexp_extract(F.trim(c), IDENT_RE, 2).cast("long"))


# --- E-02 / E-03: phrases ------------------------------------------------------------------------
def phrases(texts: DataFrame) -> DataFrame:
    """All 1-4 token phrases with their token span, stop-word singles removed (E-02, E-03).

    Per text: the tokens, and the separators between them (a split on the
    token pattern). A phrase of k tokens from token i on is token_i + separator_i + token_i+1 ...,
    read from both arrays by position, so it costs its own length; rows then carry only their own
    phrase: linear in the text length. Nothing here is a lambda, so all of it is compiled.
    """
    return _phrases_from(_words(texts)).select(
        "text_id", "start", (F.col("start") + F.col("n_tokens") - 1).alias("end"), "n_tokens", "phrase")


def _words(texts: DataFrame) -> DataFrame:
    """A row per token: its place and, for the phrases from it on, the tokens and separators of its text."""
    toks = F.regexp_extract_all("text", F.lit(TOKEN_RE), 0)
    seps = F.split("text", TOKEN_RE, -1)
    return texts.select("text_id", toks.alias("_t"), seps.alias("_s")).select(
        "text_id", "_t", "_s", F.posexplode("_t").alias("start", "_w"))


def _phrases_from(words: DataFrame, longer: Column | None = None) -> DataFrame:
    """(text_id, start, n_tokens, phrase) of the phrases from each token on; only the token itself where ``longer`` is
    false. A phrase begins and ends with a token, so there is nothing to trim."""
    levels = [F.col("_w")]
    for k in range(1, MAX_WORDS):
        i = F.col("start") + k  # null beyond the last token
        levels.append(F.concat(levels[-1], F.get("_s", i), F.get("_t", i)))
    structs = [F.struct(F.lit(k).alias("n_tokens"), x.alias("phrase")) for k, x in enumerate(levels, start=1)]
    some = F.array(*structs) if longer is None else F.when(longer, F.array(*structs)).otherwise(F.array(structs[0]))
    out = words.select("text_id", "start", F.explode(some).alias("_x")).where(F.col("_x.phrase").isNotNull()).select(
        "text_id", "start", "_x.n_tokens", "_x.phrase")
    return out.filter((F.col("n_tokens") > 1) | ~F.lower("phrase").isin(list(STOPWORDS)))


def _value_suffixes(cat: DataFrame) -> DataFrame:
    """Every word-start suffix (lower-cased, at least 4 characters) of every non-identifier value."""
    low = F.lower("value")
    pos = F.filter(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))),
                   lambda i: (i == 1) | low.substr(i - 1, F.lit(1)).rlike(r"^\s$"))
    return (cat.filter(~F.col("is_identifier")).select("dimension", "column", "value", low.alias("_low"),
                                                       F.explode(pos).alias("_pos"))
            .select("dimension", "column", "value",
                    F.col("_low").substr(F.col("_pos"), F.length("_low") - F.col("_pos") + 1).alias("suffix"))
            .filter(F.length("suffix") >= MIN_SUBSTRING_LENGTH))


def _value_prefixes(cat: DataFrame) -> DataFrame:
    """Every prefix, from 4 characters on, of every word-start suffix: what a contained needle can be (E-05, J-10)."""
    sfx = _value_suffixes(cat)
    n = F.explode(F.sequence(F.lit(MIN_SUBSTRING_LENGTH), F.length("suffix"))).alias("_n")
    return sfx.select("dimension", "column", "value", "suffix", n).select(
        "dimension", "column", "value", F.col("suffix").substr(F.lit(1), F.col("_n")).alias("prefix"))


#: Rows of a dictionary that is broadcast whole; of a larger one, the bit set of its keys is.
BROADCAST_KEYS = 100_000
#: Bits per key of the bit set (a key that is not held passes with a chance of at most 1 in 32), and its size at most.
BITS_PER_KEY, MAX_BITS = 32, 1 << 28
_WORD, _BLOCK = 64, 64 * 1024

#: Values in one row of the dictionary; a key of more values has more rows.
POSTINGS = 256


def key_table(cat: DataFrame, delivery_channels: tuple[str, ...]) -> DataFrame:
    """The dictionary of tiers 1-4: (key, tier, entries), entries being the (dimension, column, value) of a key.

    exact: ``x:`` + lower(value); alias: ``x:`` + alias; identifier: ``i:`` + prefix + ``:`` + number; substring:
    ``s:`` + every prefix of a word-start suffix. Every tier is decided by the key alone, so the join with
    phrases has no residual test and its output is no larger than the matches. The values of a key
    are dealt to rows of about POSTINGS, so no row or task grows with the values that share a key.
    """
    own = ("dimension", "column", "value")
    exact = cat.select(F.concat(F.lit("x:"), F.lower("value")).alias("key"), F.lit(1).alias("tier"), *own)
    al = alias_table(cat, delivery_channels).select(
        F.concat(F.lit("x:"), F.col("alias")).alias("key"), F.lit(2).alias("tier"), *own)
    ids = cat.filter("is_identifier").select(
        F.concat(F.lit("i:"), ident_prefix(F.col("value")), F.lit(":"),
                 ident_number(F.col("value")).cast("string")).alias("key"),
        F.lit(3).alias("tier"), *own).filter(F.col("key").isNotNull())
    sub = _value_prefixes(cat).select(F.concat(F.lit("s:"), F.col("prefix")).alias("key"), F.lit(4).alias("tier"), *own)
    rows = exact.unionByName(al).unionByName(ids).unionByName(sub)
    sizes = rows.groupBy("key", "tier").agg(F.count(F.lit(1)).alias("_n"))
    dealt = rows.join(sizes, ["key", "tier"]).withColumn(
        "_row", F.pmod(F.xxhash64(*own), F.ceil(F.col("_n") / POSTINGS)))
    return dealt.groupBy("key", "tier", "_row").agg(F.collect_set(F.struct(*own)).alias("entries")).drop("_row")


def phrase_keys(ph: DataFrame) -> DataFrame:
    """The lookup keys a phrase may hit: its lower form, its identifier key, its needle."""
    low = F.lower("phrase")
    needle = singular(F.col("phrase"))
    idk = F.when(F.col("n_tokens") == 1, F.concat(F.lit("i:"), ident_prefix(F.col("phrase")), F.lit(":"),
                                                  ident_number(F.col("phrase")).cast("string")))
    sk = F.when(F.length(needle) >= MIN_SUBSTRING_LENGTH, F.concat(F.lit("s:"), needle))
    keys = F.array(F.concat(F.lit("x:"), low), idk, sk)
    return ph.select("*", F.explode(keys).alias("key")).where(F.col("key").isNotNull())


def _bits_for(n: int) -> int:
    return min(MAX_BITS, max(_BLOCK, 1 << math.ceil(math.log2(BITS_PER_KEY * max(n, 1)))))


def key_bits(hashes: DataFrame, bits: int) -> DataFrame:
    """(block, words): the bit set of the hashes in column ``h``, in rows of 1,024 words; every block is there."""
    slot = hashes.select(F.pmod("h", F.lit(bits)).alias("_h"))
    held = slot.groupBy(F.floor(F.col("_h") / _WORD).alias("id")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_h") % _WORD).cast("int"))).alias("_w"))
    every = hashes.sparkSession.range(bits // _WORD).join(held, "id", "left")
    per = _BLOCK // _WORD
    blocks = every.groupBy(F.floor(F.col("id") / per).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("id", F.coalesce("_w", F.lit(0).cast("long")).alias("w")))).alias("_s"))
    return blocks.select("block", F.transform("_s", lambda x: x["w"]).alias("words"))


def may_be_held(keys: DataFrame, kt: DataFrame) -> DataFrame:
    """The rows of ``keys`` whose key the dictionary may hold: all that it holds, and few others (J-10)."""
    key = F.xxhash64("key")
    bits = _bits_for(kt.count())
    set_ = key_bits(kt.select(key.alias("h")), bits)
    return _with_bit(keys, key, set_, bits, "_held").where("_held").drop("_held")


def _with_bit(df: DataFrame, hash_: Column, set_: DataFrame, bits: int, name: str) -> DataFrame:
    """df with the boolean ``name``: whether the bit set has the hash. The set is broadcast: 32 MB at most, by MAX_BITS."""
    h = F.pmod(hash_, F.lit(bits))
    word = F.get("words", F.shiftright(h, 6).bitwiseAND(F.lit(_BLOCK // _WORD - 1)).cast("int"))
    return df.join(broadcast_literal(set_), F.shiftright(h, 16) == F.col("block")).withColumn(
        name, F.getbit(word, h.bitwiseAND(F.lit(_WORD - 1)).cast("int")) == 1).drop("block", "words")


def _mark(low: Column) -> Column:
    """One string for every way in which a lower-cased phrase can hit: its singular, without the zeros that pad
    the number of an identifier. A phrase that hits a key has the mark of that key."""
    return F.when((F.length(low) <= 10) & low.contains("0"), F.regexp_replace(low, r"^([a-z]+)0+(\d+)$", "$1$2")).otherwise(low)


def _first_word(low: Column) -> Column:
    """Hash of a phrase's first token, apart from the hashes of marks."""
    return F.xxhash64(F.lit("first"), low)


def _dictionary_hashes(kt: DataFrame) -> DataFrame:
    """Hashes of the marks of the dictionary's keys, and of the first tokens of those that go on after it."""
    key = F.col("key").substr(F.lit(3), F.length("key"))
    mark = (F.when(F.col("key").startswith("x:"), _mark(_without_s(key))).when(F.col("key").startswith("s:"), _mark(key))
            .otherwise(_mark(F.translate(key, ":", ""))))
    run = F.regexp_extract(key, f"^{TOKEN_RE}", 0)
    on = F.when(~F.col("key").startswith("i:") & (run != "") & (F.length(run) < F.length(key)), _first_word(run))
    return kt.select(F.explode(F.array(F.xxhash64(mark), on)).alias("h")).where(F.col("h").isNotNull()).distinct()


def phrases_to_look_up(texts: DataFrame, kt: DataFrame, fuzzy: bool) -> DataFrame:
    """(text_id, start, n_tokens, phrase) of the phrases that the dictionary may hold: all that it holds, and few
    others; with ``fuzzy`` also every token long enough for it (J-10).

    A token that begins no longer key gives no longer phrases; where the separator after it is not plain ASCII
    its lower form may join them, so these always do.
    """
    hashes = stored(_dictionary_hashes(kt), "dictionary-hashes")
    bits = _bits_for(hashes.count())
    set_ = key_bits(hashes, bits)
    sep = F.get("_s", F.col("start") + 1)
    words = _with_bit(_words(texts), _first_word(F.lower("_w")), set_, bits, "_on")
    ph = _phrases_from(words, F.col("_on") | (F.octet_length(sep) != F.length(sep))).withColumn("_low", F.lower("phrase"))
    ph = _with_bit(ph.withColumn("_needle", _without_s(F.col("_low"))), F.xxhash64(_mark(F.col("_needle"))), set_, bits, "_held")
    long = (F.col("n_tokens") == 1) & (F.length("phrase") >= MIN_FUZZY_LENGTH)
    return ph.where(F.col("_held") | long if fuzzy else F.col("_held")).select("text_id", "start", "n_tokens", "phrase")


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio (difflib) of two lower-cased strings, per Arrow batch."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _least_shared(la: Column, lb: Column) -> Column:
    """Pairs of neighbouring characters that strings of these lengths share at least if their ratio reaches the
    threshold. The ratio is 2M / (la + lb) for M characters matched in blocks; between two blocks a character
    of either string is unmatched, so there are at most 1 + la + lb - 2M of them, and a block of k
    characters holds k - 1 pairs."""
    m = F.ceil(F.lit(FUZZY_THRESHOLD) * (la + lb) / 2 - 1e-9)
    return (3 * m - 1 - (la + lb)).cast("int")


def _with_pairs(df: DataFrame, name: str) -> DataFrame:
    """The strings in ``name`` with their length, their pairs of neighbouring characters (each with its
    occurrence number, by hash) and the first of these, of which one is shared with any string whose ratio
    reaches the threshold: all but so many as the two must share, less one."""
    s, n = F.col(name), F.length(name)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: s.substr(i, F.lit(2)))
    counted = let(pairs, lambda p: F.transform(p, lambda g, i: F.concat(
        g, F.size(F.filter(F.slice(p, F.lit(1), i + 1), lambda x: x == g)).cast("string"))))
    by_hash = F.transform(F.array_sort(F.transform(counted, lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g")))),
                          lambda x: x["g"])
    other = F.sequence(F.greatest(F.lit(1), F.floor(n * FUZZY_THRESHOLD / (2 - FUZZY_THRESHOLD)).cast("int")),
                       F.ceil(n * (2 - FUZZY_THRESHOLD) / FUZZY_THRESHOLD).cast("int"))
    least = F.array_min(F.transform(other, lambda m: _least_shared(n, m)))
    out = df.where(n >= 2).select(name, n.alias(f"_n_{name}"), by_hash.alias(f"_g_{name}"), F.greatest(F.lit(1), least).alias("_t"))
    return out.select("*", F.slice(f"_g_{name}", F.lit(1), F.greatest(F.lit(1), F.col(f"_n_{name}") - F.col("_t"))).alias("_first")).drop("_t")


def _fuzzy_candidates(ph: DataFrame, cat: DataFrame) -> DataFrame:
    """Tier 5 on distinct (token, value) pairs (E-06).

    Candidates are an equi-join on shared pairs of characters: strings that reach the threshold share at
    least ``_least_shared`` pairs, so one of the first few of each in one fixed order. The exact
    count of shared pairs leaves few for the similarity itself. Nothing that reaches the threshold is lost.
    Both sides are written distinct: the optimizer would else move the filters on their pairs below
    the aggregation and work the pairs out for every phrase.
    """
    tokens = (ph.filter((F.col("n_tokens") == 1) & (F.length("phrase") >= MIN_FUZZY_LENGTH))
              .select(F.lower("phrase").alias("tok")).distinct())
    vals = cat.filter(~F.col("is_identifier")).select(F.lower("value").alias("vl")).distinct()
    one, two = (_with_pairs(stored(df, f"fuzzy-{c}"), c).withColumn("_key", F.explode("_first")).drop("_first")
                for df, c in ((tokens, "tok"), (vals, "vl")))
    la, lb = F.col("_n_tok"), F.col("_n_vl")
    pairs = one.join(two, "_key").where(F.least(la, lb) * 2.0 >= FUZZY_THRESHOLD * (la + lb)).dropDuplicates(["tok", "vl"])
    near = pairs.where(F.size(F.array_intersect("_g_tok", "_g_vl")) >= _least_shared(la, lb)).select("tok", "vl")
    return near.withColumn("ratio", similarity_ratio("tok", "vl")).filter(F.col("ratio") >= FUZZY_THRESHOLD)


_SPAN = ("array<struct<n_tokens:int,start:int,end:int,phrase:string,"
         "found:array<struct<tier:int,loss:double,phrase_id:bigint>>>>")
#: A text whose spans end before this token is claimed by the bits of one number.
MASKED_TOKENS = 63


def claimed(spans: Column) -> Column:
    """The spans that a text keeps: the longest first, left to right among equal ones, none that shares a
    token with one before (E-08). spans: array of (n_tokens, start, end, ...) sorted by start.

    One pass per length class: a class drops the spans with a token that a longer class has taken, found in an
    array of taken tokens, and picks among the rest left to right. Linear in tokens and spans.
    """
    def longer_first(kept: Column, n: int) -> Column:
        def pick(taken: Column) -> Column:
            free = F.filter(spans, lambda x: (x["n_tokens"] == n) & ~F.exists(
                F.sequence(x["start"], x["end"]), lambda i: F.coalesce(F.get(taken, i), F.lit(False))))
            return picked(free, "start", "end", _SPAN)

        return let(covered(kept, "start", "end"), lambda taken: let(pick(taken), lambda new: F.array_sort(
            F.concat(kept, new), lambda a, b: a["start"] - b["start"])))

    def step(kept: Column, n: int) -> Column:
        return kept if n == 0 else let(longer_first(kept, n), lambda k: step(k, n - 1))

    return step(F.array().cast(_SPAN), MAX_WORDS)


def claimed_by_bits(spans: Column) -> Column:
    """``claimed`` of spans that come longest first and left to right, and all end before token MASKED_TOKENS: one pass
    with the taken tokens as the bits of a number."""
    def add(a: Column, x: Column) -> Column:
        one = F.lit(1).cast("long")
        mask = F.call_function("shiftleft", F.call_function("shiftleft", one, x["n_tokens"]) - one, x["start"])
        return F.when(a["taken"].bitwiseAND(mask) != 0, a).otherwise(F.struct(
            a["taken"].bitwiseOR(mask).alias("taken"), F.concat(a["kept"], F.array(x)).alias("kept")))

    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("taken"), F.array().cast(_SPAN).alias("kept")), add,
                       lambda a: a["kept"])


def _phrase_matches(words: DataFrame, cat: DataFrame, kt: DataFrame, fuzzy: bool, cat_key: str | None) -> DataFrame:
    """What each distinct phrase (phrase, n_tokens) matches, by its first tier that hits: (phrase, tier, ratio,
    dimension, column, value, confidence, method) (E-04). ratio is that of tier 5, null in the others."""
    keys = phrase_keys(words)
    if is_small(kt, BROADCAST_KEYS, cat_key):
        found = keys.join(F.broadcast(kt), "key")
    elif is_small(words, BROADCAST_KEYS):
        found = kt.join(F.broadcast(keys), "key")
    else:
        found = may_be_held(keys, kt).join(kt, "key")
    found = stored(found.select("phrase", "tier", "entries"), "found")
    first = found.groupBy("phrase").agg(F.min("tier").alias("tier"))
    won = found.join(first, ["phrase", "tier"]).select("phrase", "tier", F.inline("entries"))
    conf = (F.when(F.col("tier") == 1, F.when(F.col("phrase") == F.col("value"), F.lit(CONFIDENCE_EXACT))
                   .otherwise(F.lit(CONFIDENCE_CASE_INSENSITIVE)))
            .when(F.col("tier") == 2, F.lit(CONFIDENCE_ALIAS))
            .when(F.col("tier") == 3, F.when(F.upper("phrase") == F.upper("value"), F.lit(CONFIDENCE_EXACT))
                  .otherwise(F.lit(CONFIDENCE_NORMALISED_ID)))
            .otherwise(F.lit(CONFIDENCE_SUBSTRING)))
    method = F.element_at(F.array(*[F.lit(m) for m in ("exact", "alias", "identifier", "substring")]), F.col("tier"))
    out = won.select("phrase", "tier", F.lit(None).cast("double").alias("ratio"), "dimension", "column", "value",
                     conf.alias("confidence"), method.alias("method"))
    if fuzzy:
        rest = words.where((F.col("n_tokens") == 1) & (F.length("phrase") >= MIN_FUZZY_LENGTH)).join(first, "phrase", "left_anti")
        fz = _fuzzy_candidates(rest, cat)
        vals = cat.filter(~F.col("is_identifier")).select("dimension", "column", "value", F.lower("value").alias("vl"))
        # the pairs within the band of their token's best, the only ones that can be within it of the best of a span
        best_of = fz.groupBy("tok").agg(F.max("ratio").alias("_b"))
        fz = stored(fz.join(best_of, "tok").where(F.col("ratio") >= F.col("_b") - FUZZY_BAND).drop("_b").join(vals, "vl"),
                    "fuzzy-pairs")
        out = out.unionByName(rest.withColumn("tok", F.lower("phrase")).join(broadcast_if_small(fz, BROADCAST_KEYS), "tok").select(
            "phrase", F.lit(5).alias("tier"), "ratio", "dimension", "column", "value",
            F.round(F.lit(CONFIDENCE_FUZZY_BASE) * F.col("ratio"), 3).alias("confidence"), F.lit("fuzzy").alias("method")))
    return out.distinct()


@contextmanager
def _sorted_groups(spark: SparkSession) -> Iterator[None]:
    """Collecting aggregations sort their rows once; hashed, every one of them would sort anew beyond 128 groups."""
    name = "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _finish_per_text(spans: DataFrame, found: DataFrame, max_matches: int | None, shared: bool) -> DataFrame:
    """Per text: greedy span claiming, order and cap (E-08, E-09), of the phrases in ``spans`` with a match in ``found``.

    Phrases and matches are numbered, the matches in their order, so that what is sorted per text is numbers.
    ``shared`` tells whether texts share an id: they are resolved as one, so a span may have several phrases.
    """
    own = ("confidence", "dimension", "value", "column", "method")
    order = [F.desc("confidence"), *own[1:]]
    matches = stored(found.select(*own).distinct().orderBy(*order).withColumn("match_id", F.monotonically_increasing_id()), "matches")
    phrases_ = stored(found.groupBy("phrase").agg(F.min("tier").alias("tier"), (-F.max("ratio")).alias("loss")).withColumn(
        "phrase_id", F.monotonically_increasing_id()), "phrases-won")
    place = F.min("match_id").over(Window.partitionBy(*own[:3]))  # equal but for the column or method
    won = stored(found.join(phrases_.select("phrase", "phrase_id"), "phrase")
                 .join(matches.withColumn("place", place), list(own)).select("phrase_id", "tier", "ratio", "place", "match_id"), "won")
    hits = spans.join(broadcast_if_small(phrases_, BROADCAST_KEYS), "phrase")
    # the aggregations below and the ranks stay within the partitioning by text
    hits = hits.repartition("text_id").withColumn("_f", F.struct("tier", "loss", "phrase_id"))
    by_span = hits.groupBy("text_id", "start", "n_tokens").agg(
        F.min("phrase").alias("phrase"), F.collect_set("_f").alias("found")) if shared else hits.withColumn("found", F.array("_f"))
    span = F.struct("n_tokens", "start", (F.col("start") + F.col("n_tokens") - 1).alias("end"), "phrase",
                    F.sort_array("found").alias("found"))
    longest_first = F.sort_array(F.collect_list(F.struct((-F.col("n_tokens")).alias("n"), "start", span.alias("s"))))
    per_text = by_span.groupBy("text_id").agg(longest_first.alias("_s")).select("text_id", F.col("_s.s").cast(_SPAN).alias("_s"))
    in_order = F.array_sort("_s", lambda a, b: a["start"] - b["start"])
    kept = per_text.select("text_id", F.explode(F.when(F.array_max("_s.end") < MASKED_TOKENS, claimed_by_bits(F.col("_s")))
                                                .otherwise(let(in_order, claimed))).alias("_k"))
    each = kept.select("text_id", "_k.start", "_k.phrase", F.get("_k.found", F.lit(0)).alias("_first"), F.explode("_k.found").alias("_f"))
    each = each.where(F.col("_f.tier") == F.col("_first.tier")).select(
        "text_id", "start", "phrase", (-F.col("_first.loss") - FUZZY_BAND).alias("_least"), F.col("_f.phrase_id").alias("phrase_id"))
    each = each.join(broadcast_if_small(won, BROADCAST_KEYS), "phrase_id").where(
        F.col("ratio").isNull() | (F.col("ratio") >= F.col("_least")))
    # order by confidence desc, dimension, value (then position) and cap; a match that two phrases of a span share counts once
    w = Window.partitionBy("text_id").orderBy("place", "start", "match_id")
    at = F.struct("start", "match_id")
    ranked = each.select("text_id", "phrase", "match_id", F.dense_rank().over(w).cast("long").alias("match_rank"),
                         at.eqNullSafe(F.lag(at).over(w)).alias("_again")).where(~F.col("_again"))
    capped = ranked.where(F.col("match_rank") <= max_matches) if max_matches is not None else ranked
    return capped.join(broadcast_if_small(matches, BROADCAST_KEYS), "match_id").select(
        "text_id", F.col("phrase").alias("text"), "dimension", "column", "value", "confidence", "method", "match_rank")


_LOOKUP_MEMO: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}
_MATCH_MEMO: dict[tuple[str, str, bool], DataFrame] = {}


def resolved(star: Star, texts: DataFrame, name: str, fuzzy: bool = False) -> DataFrame:
    """All matches of a text table of the star, resolved once per application and stored like the
    dictionary; a cap is a filter on match_rank. ``name`` tells the text tables of a star apart."""
    from martlens.session import app_key

    spark = star.fact_orders.sparkSession
    key = (app_key(spark), f"{star.source}|{star.profile.name}|{name}", fuzzy)
    if key not in _MATCH_MEMO:
        cat, kt = lookup_tables(star)
        found = resolve(texts, cat, star.profile.delivery_channels, fuzzy=fuzzy, kt=kt, cat_key=f"{star.source}/keytable")
        with _sorted_groups(spark):
            _MATCH_MEMO[key] = stored(found, f"matches-{name}")
    return _MATCH_MEMO[key]


def lookup_tables(star: Star) -> tuple[DataFrame, DataFrame]:
    """Catalogue and key table of a star, built once and checkpointed to the shared folder.

    Both are ETL products (distinct dimension values and their lookup keys);
    every resolution joins against the materialised copy instead of re-deriving
    the 16 distinct scans.
    """
    from martlens.session import app_key, ensure_checkpoint_dir

    spark = star.fact_orders.sparkSession
    key = (app_key(spark), f"{star.source}|{star.profile.name}")
    if key not in _LOOKUP_MEMO:
        ensure_checkpoint_dir(spark)
        cat = catalogue(star).checkpoint(eager=True)
        kt = key_table(cat, star.profile.delivery_channels).checkpoint(eager=True)
        _LOOKUP_MEMO[key] = (cat, kt)
    return _LOOKUP_MEMO[key]


def resolve(texts: DataFrame, cat: DataFrame, delivery_channels: tuple[str, ...], fuzzy: bool = True,
            max_matches: int | None = None, cat_key: str | None = None, kt: DataFrame | None = None) -> DataFrame:
    """Matches per text: (text_id, text, dimension, column, value, confidence, method, match_rank) (E-04 ... E-09).

    The texts are read once, for the phrases that may match; the tiers are an equi-join of the distinct phrases
    with the dictionary and the fuzzy pairs; everything after stays within one partitioning by text.
    """
    kt = kt if kt is not None else stored(key_table(cat, delivery_channels), "dictionary")
    spans = stored(phrases_to_look_up(texts, kt, fuzzy), "spans")
    words = stored(spans.select("phrase", "n_tokens").distinct(), "words")
    found = stored(_phrase_matches(words, cat, kt, fuzzy, cat_key), "phrase-matches")
    shared = not texts.groupBy("text_id").count().where("count > 1").isEmpty()
    return _finish_per_text(spans, found, max_matches, shared)


# --- E-10 ... E-13 ---------------------------------------------------------------------------------
def ambiguous(matches: DataFrame) -> DataFrame:
    """Phrases matching >= 2 dimensions within the band of the best confidence (E-10)."""
    g = Window.partitionBy("text_id", "_lt")
    m = matches.withColumn("_lt", F.lower("text")).withColumn("_best", F.max("confidence").over(g))
    close = m.filter(F.col("_best") - F.col("confidence") <= AMBIGUITY_BAND + 1e-12)
    dims = close.groupBy("text_id", "_lt").agg(F.countDistinct("dimension").alias("n_dimensions"),
                                             F.array_join(F.array_sort(F.collect_set(
                                                 F.concat_ws(":", "dimension", "value"))), ";").alias("candidates"))
    return dims.filter(F.col("n_dimensions") >= 2).withColumnRenamed("_lt", "text")


def group_by_dimension(matches: DataFrame) -> DataFrame:
    """Values per (text, dimension) (E-11)."""
    return matches.groupBy("text_id", "dimension").agg(
        F.count(F.lit(1)).alias("n_matches"),
        F.array_join(F.array_sort(F.collect_set("value")), ",").alias("values"))


def unresolved_identifiers(texts: DataFrame, matches: DataFrame) -> DataFrame:
    """Identifier-shaped tokens that resolved to nothing (E-12)."""
    toks = (texts.select("text_id", F.explode(F.regexp_extract_all("text", F.lit(TOKEN_RE), 0)).alias("token"))
            .filter(F.col("token").rlike(IDENT_RE)).distinct())
    resolved = matches.select("text_id", F.col("text").alias("token")).distinct()
    return toks.join(resolved, ["text_id", "token"], "left_anti")


def topic_tag(texts: DataFrame) -> DataFrame:
    """First rule (in order) whose keyword occurs in the lower-cased text, else the default (E-13)."""
    low = F.lower("text")
    expr = None
    for i, (words, label) in enumerate(TOPIC_RULES):
        cond = None
        for w in words:
            c = low.contains(w)
            cond = c if cond is None else (cond | c)
        expr = (F.when(cond, F.struct(F.lit(i + 1).alias("rule"), F.lit(label).alias("topic"))) if expr is None
                else expr.when(cond, F.struct(F.lit(i + 1).alias("rule"), F.lit(label).alias("topic"))))
    tag = expr.otherwise(F.struct(F.lit(0).alias("rule"), F.lit(DEFAULT_TOPIC).alias("topic")))
    keys = [c for c in texts.columns if c != "text"]
    return texts.select(*keys, tag.alias("_t")).select(*keys, "_t.rule", "_t.topic")
