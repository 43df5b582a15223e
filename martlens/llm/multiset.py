"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

A paragraph is a stretch between line breaks that is not empty, a word a stretch of it
between spaces. A paragraph is hashed to a wide
vector, and a document's fingerprint is the sum of its paragraphs' vectors: equal for
the same paragraphs in any order, and kept up to date by adding the vector of an
inserted paragraph or subtracting that of a deleted one. The vector has two parts:

* ``EQUAL_LANES`` sums modulo 2**32 of hashes of the whole paragraph, for equality;
* ``SKETCH_LANES`` sums modulo 2**32, as signed numbers, of +1/-1, one for each word of the paragraph with
  its neighbours there, hashed to signs. The squared distance of two such sums estimates
  how many words with their neighbours differ (a tug-of-war sketch), which gives the
  likeness of two documents from their fingerprints alone. A lane holds sums from -2**31
  to 2**31 - 1, so no text that fits a string can wrap it.

All of it is column expressions and sums. Bits of a 64-bit hash are summed two lanes at
a time, as ``(hash >>> j) & 0x100000001``.

Defined cases: a null or empty text has no paragraph, and its fingerprint is all zeros;
two fingerprints of zeros have likeness 1, one alone has 0; in ``edited`` ids ascend
with nulls first and equal ids by a hash of the text, rows that repeat both count as one
document there and get equal rows; a lone document follows itself; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlens.llm.common import saved

EQUAL_LANES = 4  # a multiple of 2
SKETCH_LANES = 64  # a multiple of 64
_KEY = ["ki", "ko", "h"]
_PAIR = 0x100000001


def _elements(text: Column) -> Column:
    """(before, word, after) for every word, and (null, paragraph, null) for every paragraph."""
    lines = F.replace(text, F.lit("\r"), F.lit("\n"))
    words = F.split(F.concat(F.lit("\n "), F.replace(lines, F.lit("\n"), F.lit(" \n ")), F.lit(" \n")), " ")
    n = F.size(words)
    triples = F.arrays_zip(words.alias("before"), F.slice(words, F.lit(2), n).alias("word"),
                           F.slice(words, F.lit(3), n).alias("after"))
    paragraphs = F.transform(F.split(lines, "\n"), lambda p: F.struct(
        F.lit(None).cast("string").alias("before"), p.alias("word"), F.lit(None).cast("string").alias("after")))
    return F.concat(triples, paragraphs)


def lanes(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One row per key: ``n`` words, ``equal`` and ``packed`` sketch lanes summed over the key's rows."""
    rows = df.select(*key, F.inline(_elements(F.coalesce(F.col(text), F.lit("")))))
    is_par = F.col("before").isNull()
    is_word = ~is_par & F.coalesce(~F.col("word").isin("\n", ""), F.lit(False))
    rows = rows.select(
        *key, F.when(is_word, 1).otherwise(0).alias("is_word"),
        *(F.when(is_word, F.xxhash64("before", "word", "after", F.lit(i))).otherwise(F.lit(0)).alias(f"w{i}")
          for i in range(SKETCH_LANES // 64)),
        *(F.when(is_par & (F.col("word") != ""), F.xxhash64("word", F.lit(i))).otherwise(F.lit(0)).alias(f"p{i}")
          for i in range(EQUAL_LANES // 2)))
    sums = [F.sum(F.shiftrightunsigned(f"w{i}", j).bitwiseAND(F.lit(_PAIR))).alias(f"s{i}_{j}")
            for i in range(SKETCH_LANES // 64) for j in range(32)]
    sums += [F.sum(F.shiftrightunsigned(f"p{i}", 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"e{i}_{half}")
             for i in range(EQUAL_LANES // 2) for half in range(2)]
    out = rows.groupBy(*key).agg(F.sum("is_word").alias("n"), *sums)
    packed = F.array(*(f"s{i}_{j}" for i in range(SKETCH_LANES // 64) for j in range(32)))
    equal = F.array(*(f"e{i}_{half}" for i in range(EQUAL_LANES // 2) for half in range(2)))
    return out.select(*key, "n", equal.alias("equal"), packed.alias("packed"))


def fingerprint(n: Column, equal: Column, packed: Column) -> Column:
    """The lanes modulo their powers: struct(equal: EQUAL_LANES x 32 bits, sketch: SKETCH_LANES x
    32 bits, signed)."""
    low = F.transform(packed, lambda s: _signed(2 * s.bitwiseAND(F.lit(0xFFFFFFFF)) - n).cast("int"))
    high = F.transform(packed, lambda s: _signed(2 * F.shiftrightunsigned(s, 32) - n).cast("int"))
    return F.struct(F.transform(equal, lambda s: s.bitwiseAND(F.lit(0xFFFFFFFF))).alias("equal"),
                    F.concat(low, high).alias("sketch"))


def fingerprints(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key and ``fingerprint``; rows of a key are parts of one document."""
    return lanes(docs, key, text).select(*key, fingerprint(F.col("n"), F.col("equal"), F.col("packed"))
                                         .alias("fingerprint"))


def _each(a: Column, b: Column, sign: int) -> Column:
    return F.struct(
        F.zip_with(a["equal"], b["equal"], lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32))).alias("equal"),
        F.zip_with(a["sketch"], b["sketch"], lambda x, y: _signed(x.cast("long") + sign * y.cast("long")).cast("int")).alias("sketch"))


def insert(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return _each(a, b, 1)


def delete(a: Column, b: Column) -> Column:
    """Fingerprint of a's paragraphs without those of b, which a must have."""
    return _each(a, b, -1)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprints: 1 - |a-b|^2 / (|a|^2 + |b|^2) of the sketch lanes; 1 where all
    lanes agree."""
    def square(lanes_: Column) -> Column:
        return F.aggregate(lanes_, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))

    apart = square(F.zip_with(a["sketch"], b["sketch"], lambda x, y: _signed(x.cast("long") - y.cast("long"))))
    sizes = square(a["sketch"]) + square(b["sketch"])
    return F.when((a["equal"] == b["equal"]) & (a["sketch"] == b["sketch"]), F.lit(1.0)) \
        .when(sizes > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - apart / sizes))).otherwise(F.lit(0.0))


def _signed(x: Column) -> Column:
    """A number modulo 2**32, from -2**31 on."""
    return F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)


def text_of(fp: Column) -> Column:
    """The fingerprint as text: hexadecimal lanes."""
    return F.concat_ws(":", F.array_join(F.transform(fp["equal"], lambda x: F.lpad(F.hex(x), 8, "0")), ""),
                       F.array_join(F.transform(fp["sketch"], lambda x: F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << 32))), 8, "0")), ""))


def _successors(docs: DataFrame) -> DataFrame:
    """Key, number of equal rows and the next document's key, over narrow rows only."""
    order = [F.col("ko").desc(), F.col("ki"), F.col("h")]
    keys = saved(docs.groupBy(*_KEY).agg(F.first("n_chars").alias("n_chars"), F.count("*").alias("copies"))
                 .repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "fingerprint-order")
    me = F.struct(*_KEY)
    # the first key of the next range that has rows: one row per range
    ranges = keys.groupBy("part").agg(F.min_by(me, F.struct(~F.col("ko"), "ki", "h")).alias("first"))
    around = Window.orderBy("part")
    ranges = ranges.select("part", F.coalesce(F.lead("first").over(around), F.first("first").over(
        around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    return (keys.withColumn("next", F.lead(me).over(Window.partitionBy("part").orderBy(*order)))
            .join(ranges, "part")
            .select(*_KEY, "n_chars", "copies", F.coalesce("next", "after").alias("next")))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and a hash of the text as join keys that are never null, and the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("ki"),
                       F.col("doc_id").isNull().alias("ko"), F.xxhash64(text).alias("h"), text.alias("text"))


def edited_texts(docs: DataFrame, order: DataFrame) -> DataFrame:
    """Key, text and edited: the last quarter of the code points replaced by as many (or all) of the
    beginning of the next document. The texts are shuffled once, by key, for both joins."""
    whole = docs.groupBy(*_KEY).agg(F.first("text").alias("text"))  # repeated rows once
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    wanted = order.select(*(F.col(k).alias(f"my_{k}") for k in _KEY), quarter.alias("quarter"), "next.*")
    heads = wanted.join(whole, _KEY).select(
        *(F.col(f"my_{k}").alias(k) for k in _KEY), "quarter",
        F.substring("text", F.lit(1), F.col("quarter")).alias("head"))
    return whole.join(heads, _KEY).select(*_KEY, "text", F.concat(
        F.substring("text", F.lit(1), F.length("text") - F.col("quarter")), F.col("head")).alias("edited"))


def edit_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, and the fingerprints (struct columns) of
    its text, of its edited text and of the next document's text: own, edited, next."""
    docs = _keyed(docs)
    order = saved(_successors(docs.select(*_KEY, F.length("text").cast("long").alias("n_chars"))),
                  "fingerprint-successors")
    # rows that repeat id and text add up to a multiple of one vector
    sums = lanes(docs, _KEY).join(order.select(*_KEY, "copies"), _KEY)
    own = saved(sums.select(*_KEY, fingerprint(
        F.expr("n div copies"), F.expr("transform(equal, s -> s div copies)"),
        F.expr("transform(packed, s -> s div copies)")).alias("own")), "fingerprints")

    edits = edited_texts(docs, order).select(*_KEY, F.unhex(F.sha2("edited", 256)).alias("sha"), "edited")
    changed = fingerprints(edits, [*_KEY, "sha"], "edited")
    after = own.select(F.struct(*_KEY).alias("next"), F.col("own").alias("next_fp"))
    return (own.join(order, _KEY).join(after, "next").join(changed, _KEY)
            .select(F.when(~F.col("ko"), F.col("ki")).alias("doc_id"), "n_chars",
                    F.lower(F.hex("sha")).alias("edited_sha256"), "own", F.col("fingerprint").alias("edited"),
                    F.col("next_fp").alias("next"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
            .drop("col"))
