"""Registered queries of the text operators, over whole tables, with production parameters.

``QUERIES`` maps a name to (spark, sf_dir) -> DataFrame; ``SQL`` holds DuckDB SQL
where SQL can express the result. The other queries are tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.llm import (bpe, codes, hmm, jaccard, mixture, multiset, ordinal, pii, records, resample, simhash, urls,
                          winnow)
from martlens.llm.common import crc_fold, join_by_count, saved, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

END_ID = 2


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text, and the round trip, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, drop_text=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token records written in id order and read back through the offset index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = records.write_records(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return records.read_records(index).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near duplicates (five words, similarity 0.8) of every document."""
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every whole text."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = pii.of_kinds(F.col("pii"), *pii.BASE_KINDS)
    counts = [F.size(pii.of_kinds(F.col("pii"), k)).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"),
                        pii.joined(F.col("pii")).alias("spans"))


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, with their likenesses."""
    rows = multiset.edit_report(table(spark, sf_dir, "documents"))
    own, edited, after = F.col("own"), F.col("edited"), F.col("next")
    return rows.select("doc_id", "n_chars", "edited_sha256", multiset.text_of(own).alias("fingerprint"),
                       multiset.text_of(edited).alias("edited_fingerprint"),
                       multiset.likeness(own, edited).alias("near_edited"),
                       multiset.likeness(own, after).alias("near_next"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside an occurrence of a benchmark window, and the items."""
    found = winnow.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                 table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query
def op10_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every whole text under the hidden Markov model and the unigram base."""
    return hmm.language_model(table(spark, sf_dir, "documents"))


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and decision of the ordinal regression for every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grades = labels.select("doc_id", ordinal.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    fitted = ordinal.fit(ordinal.sample(docs, grades))
    return ordinal.grade_texts(docs.select("doc_id", "text"), fitted).drop("text")


@query
def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the other two folds."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), mixture.FOLDS) == mixture.HELD_OUT
    names, probabilities = mixture.train(docs.where(~held_out))
    found = mixture.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), names, probabilities)
    return found.select("doc_id", "held_out", "lang_pred", "score", "languages")


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings by eight codebooks of 16 entries, with their errors per vector and label."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    points = codes.integer_vectors(vectors)
    books = codes.fit(points)
    if books is None:
        return points.select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")),
                             F.lit("").alias("codebooks_sha256"))
    coded = saved(codes.encode(points, books).withColumn(
        "group", F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0)).alias("label"))), "vector-codes")
    by_label = coded.groupBy("group").agg(F.sum(F.col("error").cast("decimal(20,0)")).cast("long").alias("label_error"),
                                          F.count("*").alias("n"))
    return join_by_count(coded, by_label, "group", "n", coded.count()).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


@query
def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-equal fingerprints (at most two differing bits) of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark texts and the five percent drawn by them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resample.resample(docs, table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def _digits(text: Column, n: int) -> Column:
    """A number of 0 to 9999 that follows from a text: four hexadecimal digits of its md5."""
    return F.conv(F.substring(F.md5(text), 4 * n + 1, 4), 16, 10).cast("int") % 10000


def _derived_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts and first path steps of the pages. By their md5, a third of the
    hosts is blocked for some time, some of them twice, and an eighth of the steps is allowed."""
    hosts = pages.select(urls.host_of(F.col("url")).alias("key")).where("key is not null").distinct()
    steps = pages.select(F.regexp_extract(F.concat(urls.host_of(F.col("url")), urls.path_of(F.col("url"))),
                                          "^[^/]+/[^/]+", 0).alias("key")).where("key <> ''").distinct()
    start = F.lit("2024-01-01").cast("date")
    added = F.date_add(start, _digits(F.col("key"), 1) % 200)
    removed = F.date_add(added, 20 + _digits(F.col("key"), 2) % 100)
    again = F.date_add(removed, 10 + _digits(F.col("key"), 3) % 60)

    def dated(df: DataFrame, verdict: str, at: Column, action: str, every: int) -> DataFrame:
        return df.where(_digits(F.col("key"), 0) % every == 0).select(
            "key", F.lit(verdict).alias("verdict"), F.lit(action).alias("action"), at.alias("at"))

    return (dated(hosts, "block", added, "add", 3).unionByName(dated(hosts, "block", removed, "remove", 3))
            .unionByName(dated(hosts, "block", again, "add", 6)).unionByName(dated(steps, "allow", added, "add", 8)))


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page by the list entries that held when it was fetched. The tables have no
    fetch times and no list: a page is fetched on day page_id * 37 modulo 365 of 2024, and the list
    is derived from the pages' own hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"),
                                                         F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")))
    return urls.judge(captures, _derived_list(pages)).select(
        "page_id", "host", "fetched_at", "verdict", "listed_key", "listed_from", "n_active")


SQL["op9_url_filter"] = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(((page_id * 37) % 365 + 365) % 365 AS INT) AS fetched_at,
    nullif(regexp_replace(lower(regexp_replace(regexp_replace(
      regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '^[^@]*@', ''), ':[0-9]*$', '')),
      '\.+$', ''), '') AS host,
    regexp_replace(regexp_replace(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1),
      '/+', '/', 'g'), '/$', '') AS path
  FROM pages),
keys AS (
  SELECT DISTINCT host AS key, 'host' AS kind FROM p WHERE host IS NOT NULL
  UNION ALL
  SELECT DISTINCT regexp_extract(host || path, '^[^/]+/[^/]+'), 'prefix' FROM p
  WHERE host IS NOT NULL AND regexp_matches(path, '^/[^/]')),
d AS (
  SELECT key, kind, CAST('0x' || substr(md5(key), 1, 4) AS INT) % 10000 AS d0,
    CAST('0x' || substr(md5(key), 5, 4) AS INT) % 10000 AS d1, CAST('0x' || substr(md5(key), 9, 4) AS INT) % 10000 AS d2,
    CAST('0x' || substr(md5(key), 13, 4) AS INT) % 10000 AS d3 FROM keys),
dates AS (
  SELECT *, DATE '2024-01-01' + CAST(d1 % 200 AS INT) AS added,
    DATE '2024-01-01' + CAST(d1 % 200 + 20 + d2 % 100 AS INT) AS removed,
    DATE '2024-01-01' + CAST(d1 % 200 + 20 + d2 % 100 + 10 + d3 % 60 AS INT) AS again FROM d),
valid AS (
  SELECT key, 'block' AS verdict, added AS valid_from, removed AS valid_to FROM dates WHERE kind = 'host' AND d0 % 3 = 0
  UNION ALL SELECT key, 'block', again, NULL FROM dates WHERE kind = 'host' AND d0 % 6 = 0
  UNION ALL SELECT key, 'allow', added, NULL FROM dates WHERE kind = 'prefix' AND d0 % 8 = 0),
active AS (
  SELECT p.page_id, p.url, v.*, length(v.key) - length(replace(replace(v.key, '.', ''), '/', '')) AS depth
  FROM p JOIN valid v ON p.fetched_at >= v.valid_from AND (v.valid_to IS NULL OR p.fetched_at < v.valid_to)
    AND (p.host = v.key OR p.host LIKE '%.' || v.key
         OR p.host || p.path = v.key OR starts_with(p.host || p.path, v.key || '/'))),
best AS (
  SELECT page_id, url, count(*) AS n_active,
    max(struct_pack(depth := depth, allowed := verdict = 'allow', f := valid_from, k := key, v := verdict)) AS b
  FROM active GROUP BY page_id, url)
SELECT p.page_id, p.host, p.fetched_at, coalesce(b.b.v, 'unlisted') AS verdict, b.b.k AS listed_key,
  b.b.f AS listed_from, coalesce(b.n_active, 0) AS n_active
FROM p LEFT JOIN best b ON p.page_id = b.page_id AND p.url IS NOT DISTINCT FROM b.url
"""
