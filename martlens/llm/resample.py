"""Importance resampling towards a target distribution, counting each distinct line once.

A text's features are all runs of one to three consecutive words, each hashed to one of ``BUCKETS``
buckets by the CRC-32 of its bytes. A bucket's gain is the logarithm of its smoothed share in the
target texts over that in all documents; a document's weight is the sum of its gains, its score
the weight plus a Gumbel variate drawn from its id, and those of the highest scores are drawn:
a sample without replacement in proportion to exp(weight).

Texts are cut at newlines. Lines repeat across documents, so Spark groups equal lines first,
however many documents hold them, and the features of a distinct line are computed once and stored
with its number of occurrences, by which its counts are multiplied. Runs of words that cross
a newline belong to no line: they are counted per document and added. Weights follow the same
way: one number per distinct line, looked up for the lines of each document, plus that of
the crossing runs.

What reaches the driver are two histograms of ``BUCKETS`` numbers. Lines that hold a large share of
all occurrences are looked up in a broadcast of at most ``common.HOT_SHARE`` rows, the others by a
shuffle join; ranks come from a range partition with an offset per partition.

Defined cases: a null, empty or wordless text has no features and weight 0 and still has a score; fewer than
``LEAST_WORDS`` words are never drawn, and do not count for the number drawn; equal scores go by the
smaller id, null ids last, as the text '' in the draw; repeated rows are drawn each on its own (with
one variate); an empty table gives an empty result, an empty target gives the smoothed gains; other
columns pass through, and input columns named like result columns are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.llm.common import join_by_count, lower_ascii, saved
from martlens.llm.textkit import ALNUM, buffer_of
from martlens.operators.numbering import numbered

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
RESULT = ("n_words", "n_features", "weight", "score", "rank")

#: Lower-cases A-Z and turns what is no part of a word into spaces.
_WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if ALNUM[c + 32 if 65 <= c <= 90 else c] else 32 for c in range(256))
_HAS_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"


def line_features(line: bytes) -> np.ndarray:
    """Buckets of all runs of one to three words, repeats included."""
    words = line.translate(_WORDS).split()
    one = list(map(crc32, words))
    spaced = [b" " + w for w in words[1:]]
    two = list(map(crc32, spaced, one))  # a checksum continues from that of the words before
    three = map(crc32, islice(spaced, 1, None), two)
    n = len(words)
    return (np.fromiter([*one, *two, *three], dtype=np.int64, count=n + max(0, n - 1) + max(0, n - 2)) % BUCKETS).astype("<u2")


def crossing_features(lines: list[bytes]) -> tuple[int, list[int]]:
    """Words of a text, and the buckets of its runs of two or three words that cross a newline."""
    n, tail, found = 0, [], []
    for line in lines:
        words = line.translate(_WORDS).split()
        n += len(words)
        around = tail + words[:2]
        for p in range(len(tail), len(around)):
            first = len(tail) - p  # 0 or -1: this word is the first or second of its line
            if first == 0 and p >= 1:
                found.append(crc32(b" ".join(around[p - 1:p + 1])) % BUCKETS)
            if p >= 2:
                found.append(crc32(b" ".join(around[p - 2:p + 1])) % BUCKETS)
        tail = (tail + words)[-2:]
    return n, found


def line_key(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line)


def distinct_lines(docs: DataFrame) -> DataFrame:
    """key, n (occurrences) and features (buckets, two bytes each) of every distinct line with words; a table."""
    lines = docs.select(F.explode(F.split(lower_ascii(F.col("text")), "\n")).alias("line")) \
        .where(F.col("line").rlike(_HAS_WORD)).groupBy("line").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column(0))
            rows = [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([line_key(x) for x in rows], pa.binary()), batch.column(1),
                 pa.array([line_features(x).tobytes() for x in rows], pa.binary())], names=["key", "n", "features"])

    return saved(lines.mapInArrow(run, "key binary, n long, features binary"), "resample-lines")


def with_lines(docs: DataFrame) -> DataFrame:
    """Input columns but text, n_words, lines (array of key and n: the distinct lines with words) and
    crossing (buckets of the runs across newlines), with a number ``_row``; a table."""
    keep = [f for f in docs.schema.fields if f.name not in ("text", "_row", "_lines", "_crossing", *RESULT)]
    line = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType())])
    schema = T.StructType([*keep, T.StructField("n_words", T.LongType()), T.StructField("_lines", T.ArrayType(line)),
                           T.StructField("_crossing", T.BinaryType())])
    kind = pa.list_(pa.struct([("key", pa.binary()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column(len(keep)))
            n_words, lines, crossing = [], [], []
            for a, b in zip(offsets, offsets[1:], strict=False):
                cut = data[a:b].tobytes().lower().split(b"\n")  # bytes: A-Z only
                n, found = crossing_features(cut)
                n_words.append(n)
                crossing.append(np.array(found, dtype="<u2").tobytes())
                lines.append([{"key": line_key(x), "n": c} for x, c in Counter(cut).items() if x.translate(_WORDS).strip()])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(keep))), pa.array(n_words, pa.int64()), pa.array(lines, kind),
                 pa.array(crossing, pa.binary())], names=schema.names)

    read = docs.select(*(F.col(f"`{f.name}`") for f in keep), F.col("text").cast("string").alias("_text"))
    return saved(read.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "resample-documents")


def bucket_counts(lines: DataFrame, docs: DataFrame) -> np.ndarray:
    """Features of all texts per bucket: those of the lines by their occurrences, and the crossing ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            features, times = batch.column(0), batch.column(1).to_numpy()
            found = [np.frombuffer(x.as_buffer(), dtype="<u2") for x in features]
            bucket = np.concatenate(found) if found else np.empty(0, dtype="<u2")
            by = np.repeat(times, [len(x) for x in found]).astype(np.float64)
            total += np.bincount(bucket, weights=by, minlength=BUCKETS).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    each = lines.select("features", "n").unionByName(
        docs.select(F.col("_crossing").alias("features"), F.lit(1).cast("long").alias("n")))
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in each.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(all_counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of (share in the target / share in all documents)), both shares smoothed by one."""
    s_all, t_all = int(all_counts.sum()), int(target.sum())
    return np.array([floor(1000 * log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS))))
                     for s, t in zip(all_counts.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def _weighed(df: DataFrame, features: str, gain: np.ndarray) -> DataFrame:
    """df with the features replaced by weight (sum of gains) and n_features."""
    keep = [f for f in df.schema.fields if f.name != features]
    schema = T.StructType([*keep, T.StructField("weight", T.LongType()), T.StructField("n_features", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), dtype="<u2") for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(keep))), pa.array([int(gain[x].sum()) for x in found], pa.int64()),
                 pa.array([len(x) for x in found], pa.int64())], names=schema.names)

    return df.select(*(F.col(f"`{f.name}`") for f in keep), features).mapInArrow(run, schema)


def gumbel(doc_id: Column) -> Column:
    """floor(1000 * a Gumbel variate) that follows from the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("long")


def weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Input columns but text, n_words, n_features and weight."""
    own, lines = with_lines(docs), distinct_lines(docs)
    wanted = target.select(F.col("text").cast("string"))
    gain = gains(bucket_counts(lines, own), bucket_counts(distinct_lines(wanted), with_lines(wanted)))
    per_line = _weighed(lines, "features", gain)
    held = own.select("_row", F.explode("_lines").alias("line")).select("_row", "line.key", F.col("line.n").alias("times"))
    total = lines.agg(F.sum("n")).first()[0] or 0
    by_line = join_by_count(held, per_line, "key", "n", total).groupBy("_row").agg(
        F.sum(F.col("weight") * F.col("times")).alias("_weight"), F.sum(F.col("n_features") * F.col("times")).alias("_features"))
    rest = _weighed(own.drop("_lines"), "_crossing", gain)
    return rest.join(by_line, "_row", "left").withColumns({
        "weight": F.col("weight") + F.coalesce("_weight", F.lit(0)),
        "n_features": F.col("n_features") + F.coalesce("_features", F.lit(0))}).drop("_row", "_weight", "_features")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Input columns but text, n_words, n_features, weight, score and rank (1, 2, 3 ... among the drawn, null
    elsewhere). docs: doc_id, text; target: text."""
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    scored = saved(weights(docs, target).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"))), "resample-scores")
    able = F.col("n_words") >= LEAST_WORDS
    n = numbered(scored.where(able), [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features")], "rank")
    drawn = scored.where(able).count() * percent // 100
    none = F.lit(None).cast("long")
    return n.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(
        scored.where(~able).withColumn("rank", none))
