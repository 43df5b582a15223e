"""Benchmark decontamination by winnowing.

A fingerprint is a k-gram hash of words that is the least of ``WINDOW - K + 1``
consecutive ones (the last of equal ones). A text and an item that share ``WINDOW`` words
in a row choose the same fingerprint inside them, so joining fingerprints misses no
shared window. Each hit carries the ``WINDOW - K`` words on both sides of its k-gram; the
k-gram is extended over them while words agree, and a run of ``WINDOW`` words or more
marks its words. Items with fewer words are one window of their own length n, and are
found the same way with every n-gram as fingerprint.

The join is on hashes, and the words themselves decide. Before the join, fingerprints of
documents pass a bitmap of those of the items. Its size is fixed (``BITMAP_BITS``), it is
merged from one bitmap per partition of the items, and it only saves work. Hot
fingerprints are dealt by a salt of the document on one side and repeated on the other.

Defined cases: null or wordless texts have no words and no hits; null or wordless items
never occur; repeated rows are judged each on its own; repeated item ids count once per
id; an empty table on either side gives no hits; other columns pass through, and input columns
named like result columns (or ``_row`` and ``hits``) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.llm.common import saved
from martlens.llm.textkit import ALNUM, Words, slices

WINDOW = 10
K = 6
BITMAP_BITS = 1 << 24
SALTS = 16
RESULT = ("n_words", "n_hit", "n_items", "items", "spans")

_HIT = "struct<hash:long,span:string,from:int,gram:int,positions:array<int>>"


def _chosen(words: Words) -> np.ndarray:
    """Word positions of the k-grams that winnowing keeps, for texts of WINDOW words or more."""
    grams, width = words.grams(K), WINDOW - K + 1
    if len(grams) < width:
        return np.empty(0, dtype=np.int64)
    n = len(grams) - width + 1
    least, place = grams[:n].copy(), np.arange(n)
    for j in range(1, width):  # the last least one of every window
        here = grams[j:j + n]
        better = here <= least
        least[better] = here[better]
        place[better] = np.flatnonzero(better) + j
    # windows that lie within one text
    first, last = words.first[:-1], words.first[1:] - WINDOW
    inside = np.zeros(n + 1, dtype=np.int64)
    ok = last >= first
    np.add.at(inside, first[ok], 1)
    np.add.at(inside, last[ok] + 1, -1)
    return np.unique(place[np.cumsum(inside[:n]) > 0])


def _bit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)) % np.uint64(BITMAP_BITS)


def _context(words: Words, d: int, at: int) -> tuple[int, int]:
    """Words around the k-gram at ``at`` in text d: first, and after the last."""
    side = WINDOW - K
    return max(int(words.first[d]), at - side), min(int(words.first[d + 1]), at + K + side)


def item_fingerprints(items: DataFrame) -> DataFrame:
    """hash, item_id, n (words in the window asked for), span (the words with their context, or the
    whole short item) and at (place of the k-gram in the span)."""
    schema = "hash long, item_id string, n int, span string, at int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            for i, _, words in slices(batch.column("text"), ALNUM):
                rows, grams = [], words.grams(K)
                owner = np.searchsorted(words.first, np.arange(len(words.start)), side="right") - 1
                for p in _chosen(words).tolist():
                    d = int(owner[p])
                    a, b = _context(words, d, p)
                    rows.append((int(grams[p].view(np.int64)), ids[i + d], WINDOW, words.words(a, b), p - a))
                for d in range(words.n_docs):
                    a, b = int(words.first[d]), int(words.first[d + 1])
                    if 0 < b - a < WINDOW:
                        h = words.grams(b - a)[a]
                        rows.append((int(h.view(np.int64)), ids[i + d], b - a, words.words(a, b), 0))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                            pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32()), strict=True)],
                        names=["hash", "item_id", "n", "span", "at"])

    return items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, schema)


def _bitmap(prints: DataFrame) -> np.ndarray:
    """Bits of all fingerprints; one map of fixed size per partition is merged here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITMAP_BITS, dtype=bool)
        for batch in batches:
            bits[_bit(batch.column("hash").to_numpy().view(np.uint64))] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    merged = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for row in prints.select("hash").coalesce(16).mapInArrow(run, "bits binary").toLocalIterator():
        merged |= np.frombuffer(row.bits, dtype=np.uint8)
    return np.unpackbits(merged).astype(bool)


def _candidates(docs: DataFrame, bits: np.ndarray, short: list[int]) -> DataFrame:
    """Input columns without the text, n_words, and the fingerprints that pass the bitmap."""
    keep = [f for f in docs.schema.fields if f.name not in ("text", "_row", "hits", *RESULT)]
    names = [f.name for f in keep] + ["n_words", "hits"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "n_words long",
                        f"hits array<{_HIT}>"])
    packed = np.packbits(bits).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(packed, dtype=np.uint8)).astype(bool)
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("span", pa.string()), ("from", pa.int32()),
                                   ("gram", pa.int32()), ("positions", pa.list_(pa.int32()))]))
        for batch in batches:
            for i, j, words in slices(batch.column("text"), ALNUM):
                hits: list[list[dict]] = [[] for _ in range(words.n_docs)]
                grams, chosen = words.grams(K), _chosen(words)
                chosen = chosen[known[_bit(grams[chosen])]]
                owner = np.searchsorted(words.first, chosen, side="right") - 1
                for p, d in zip(chosen.tolist(), owner.tolist(), strict=True):
                    a, b = _context(words, d, p)
                    hits[d].append({"hash": int(grams[p].view(np.int64)), "span": words.words(a, b), "from": p - a,
                                    "gram": WINDOW, "positions": [a - int(words.first[d])]})
                for n in short:
                    grams = words.grams(n)
                    found = np.flatnonzero(known[_bit(grams)]) if len(grams) else np.empty(0, dtype=np.int64)
                    owner = np.searchsorted(words.first, found, side="right") - 1
                    found, owner = (x[found + n <= words.first[owner + 1]] for x in (found, owner))
                    same: dict[tuple[int, int], dict] = {}
                    for p, d in zip(found.tolist(), owner.tolist(), strict=True):
                        key = (d, int(grams[p].view(np.int64)))
                        if key not in same:
                            same[key] = {"hash": key[1], "span": words.words(p, p + n), "from": 0, "gram": n,
                                         "positions": []}
                            hits[d].append(same[key])
                        same[key]["positions"].append(p - int(words.first[d]))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(f.name).slice(i, j - i) for f in keep),
                     pa.array(np.diff(words.first), pa.int64()), pa.array(hits, kind)], names=names)

    return docs.select(*(F.col(f"`{f.name}`") for f in keep), "text").mapInArrow(run, schema)


def _runs(mine: Column, at: Column, theirs: Column, place: Column) -> tuple[Column, Column]:
    """How far words agree to the left of both k-grams, and from their first words on."""
    def agreeing(a: Column, b: Column) -> Column:
        pairs = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        stop = F.array_position(pairs, False)
        return F.when(stop > 0, stop - 1).otherwise(F.size(pairs)).cast("int")

    none = F.array().cast("array<string>")

    def before(words: Column, n: Column) -> Column:
        return F.when(n > 0, F.reverse(F.slice(words, F.lit(1), n))).otherwise(none)

    left = agreeing(before(mine, at), before(theirs, place))
    right = agreeing(F.slice(mine, at + 1, F.size(mine)), F.slice(theirs, place + 1, F.size(theirs)))
    return left, right


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Input columns but text, and per document n_words, n_hit (words inside an occurrence of an
    item's window), n_items, items (ids as text, sorted), spans (stretches of words hit)."""
    prints = saved(item_fingerprints(items), "item-fingerprints")
    short = sorted(r.n for r in prints.where(F.col("n") < WINDOW).select("n").distinct().collect())
    docs = docs.withColumn("text", F.col("text").cast("string"))
    base = saved(_candidates(docs, _bitmap(prints), short).withColumn("_row", F.monotonically_increasing_id()),
                 "document-fingerprints")

    hits = base.select("_row", F.explode("hits").alias("hit")).select(
        "_row", F.col("hit.hash").alias("hash"), F.col("hit.span").alias("span"), F.col("hit.from").alias("at"),
        F.col("hit.gram").alias("n"), F.col("hit.positions").alias("positions"),
        F.pmod("_row", F.lit(SALTS)).cast("int").alias("salt"))
    wanted = prints.select("hash", "n", F.col("span").alias("their_span"), F.col("at").alias("their_at"), "item_id",
                           F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    left, right = _runs(F.split("span", " "), F.col("at"), F.split("their_span", " "), F.col("their_at"))
    found = (hits.join(wanted, ["hash", "n", "salt"])
             .select("_row", "item_id", "n", "at", "positions", left.alias("left"), right.alias("right"))
             .where("left + right >= n")
             .select("_row", "item_id", F.explode("positions").alias("p"), "at", "left", "right")
             .select("_row", "item_id", (F.col("p") + F.col("at") - F.col("left")).alias("begin"),
                     (F.col("p") + F.col("at") + F.col("right")).alias("end")))
    # the same stretch can come from many items and fingerprints
    spans = found.groupBy("_row", "begin", "end").agg(F.collect_set("item_id").alias("ids"))
    per_doc = spans.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    union = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["begin"], acc["upto"]))).alias("n"),
            F.greatest(acc["upto"], s["end"]).alias("upto")), lambda acc: acc["n"])
    per_doc = per_doc.select("_row", union.cast("long").alias("n_hit"), "items", "spans")
    out = base.drop("hits").join(per_doc, "_row", "left")
    return out.select(
        *(F.col(f"`{c}`") for c in base.columns if c not in ("_row", "hits", "n_words")), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int>>")).alias("spans"))
