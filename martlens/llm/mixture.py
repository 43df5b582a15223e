"""Language identification by multilingual mixture inference.

Each language has a distribution of hashed letter n-grams, counted over all training
texts by Spark. A word's likelihood in a language is the product of its n-grams'; a
document is a mixture of languages with unknown proportions, found by expectation-
maximisation over its words. Sets of one language up to all, nested by first proportion,
are compared by log-likelihood less a penalty per language that grows with the log of the
words; a set whose penalty alone is worse than the best so far is not tried. The
prediction is the language with the largest proportion in the chosen set.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and no
languages; training texts without a language are not used; without any training text
every prediction is ``und``; ties go to the language first by name; repeated rows are
judged each on its own; an empty table gives an empty result; other columns pass
through, and input columns named like result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.llm.textkit import buffer_of, mix, row_slices

FOLDS, HELD_OUT = 3, 1
GRAM_SIZES = (2, 3, 4)  # bytes, with a space at each end of a word
BUCKETS = 1 << 15
ROUNDS = 8
PENALTY = 4.0
UNKNOWN = "und"
_ADD = 0.5
_SHARPNESS = 0.5  # n-grams of a word overlap, so their product overstates its evidence

# letters keep their lower-case byte, bytes of other alphabets too; the rest is a space
_SYMBOL = np.full(256, 32, dtype=np.uint8)
_SYMBOL[97:123] = np.arange(97, 123)
_SYMBOL[65:91] = np.arange(97, 123)
_SYMBOL[128:] = np.arange(128, 256)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """First place of every word, the place after it, the text it is in, and for each n-gram size
    the bucket from every place on, in a copy of the bytes with a space around every text."""
    n = len(offsets) - 1
    wide = np.full(len(data) + n + 1 + max(GRAM_SIZES), 32, dtype=np.uint8)
    wide[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = _SYMBOL[data]
    letter = wide != 32
    start = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    end = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    owner = np.searchsorted(offsets + np.arange(n + 1), start, side="right") - 1
    code, buckets = wide.astype(np.uint64), []
    for k in GRAM_SIZES:
        m = len(wide) - k
        h = np.full(m, k, dtype=np.uint64)
        for j in range(k):
            h = h * np.uint64(257) + code[j:j + m]
        buckets.append((mix(h) % np.uint64(BUCKETS)).astype(np.int32))
    return start, end, owner, buckets


def gram_counts(texts: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all texts; columns text and lang."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            column, lang = batch.column("text"), np.array(batch.column("lang").to_pylist(), dtype=object)
            if not batch.num_rows:
                continue
            data, offsets = buffer_of(column)
            for i, j in row_slices(column):
                start, end, owner, buckets = _grams(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                for name in set(lang[i:j]):
                    mine = lang[i:j][owner] == name
                    into = total.setdefault(name, np.zeros(BUCKETS * len(GRAM_SIZES)))
                    for g, (k, b) in enumerate(zip(GRAM_SIZES, buckets, strict=True)):
                        steps = np.zeros(len(b) + 1, dtype=np.int32)
                        a, z = start[mine] - 1, np.maximum(end[mine] - k + 2, start[mine])
                        np.add.at(steps, a, 1)
                        np.add.at(steps, np.minimum(z, len(b)), -1)
                        inside = np.cumsum(steps[:-1]) > 0
                        into[g * BUCKETS:(g + 1) * BUCKETS] += np.bincount(b[inside], minlength=BUCKETS)
        for name, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)),
                 pa.array(n[some].astype(np.int64))], names=["lang", "bucket", "n"])

    return (texts.select("text", "lang").mapInArrow(run, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def train(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names of the languages, and log probabilities (n-gram size x bucket) x language."""
    rows = gram_counts(texts.where("text is not null and lang is not null")).toPandas()
    names = sorted(rows["lang"].unique()) if len(rows) else []
    n = np.zeros((BUCKETS * len(GRAM_SIZES), len(names)))
    if names:
        n[rows["bucket"], rows["lang"].map({x: i for i, x in enumerate(names)})] = rows["n"]
    parts = n.reshape(len(GRAM_SIZES), BUCKETS, len(names)) + _ADD
    return names, np.log(parts / parts.sum(axis=1, keepdims=True)).reshape(n.shape).astype(np.float32)


def _word_likelihoods(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text of every word, and its log-likelihood in every language."""
    start, end, owner, buckets = _grams(data, offsets)
    total = np.zeros((len(start), table.shape[1]))
    for g, (k, b) in enumerate(zip(GRAM_SIZES, buckets, strict=True)):
        a, z = start - 1, np.minimum(np.maximum(end - k + 2, start), len(b))
        for lang in range(table.shape[1]):
            sums = np.zeros(len(b) + 1)
            np.cumsum(table[g * BUCKETS:(g + 1) * BUCKETS, lang][b], dtype=np.float64, out=sums[1:])
            total[:, lang] += sums[z] - sums[a]
    return owner, _SHARPNESS / len(GRAM_SIZES) * total


def mixtures(owner: np.ndarray, likelihood: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) in the set of languages of the best penalised
    log-likelihood, and the number of languages in it."""
    n_langs = likelihood.shape[1]
    best = likelihood.max(axis=1, keepdims=True)
    p, first = np.exp(likelihood - best), np.searchsorted(owner, np.arange(n_docs + 1))
    words = np.diff(first)
    some = np.flatnonzero(words)

    def rounds(shares: np.ndarray, allowed: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihood of the texts ``mine``, which have words, from first shares."""
        inside = np.zeros(n_docs, dtype=bool)
        inside[mine] = True
        q, of = p[inside[owner]], np.repeat(np.arange(len(mine)), words[mine])
        cuts = np.r_[0, np.cumsum(words[mine])[:-1]]
        shares = np.where(allowed, shares, 0.0) + np.where(allowed, 1e-6, 0.0)
        shares /= shares.sum(axis=1, keepdims=True)
        log = np.zeros(len(mine))
        for _ in range(ROUNDS):
            joint = shares[of] * q
            whole = np.maximum(joint.sum(axis=1), 1e-300)
            shares = np.add.reduceat(joint / whole[:, None], cuts, axis=0) / words[mine, None]
            log = np.add.reduceat(np.log(whole), cuts)
        return shares, log

    chosen, size, value = np.zeros((n_docs, n_langs)), np.zeros(n_docs, dtype=np.int64), np.full(n_docs, -np.inf)
    if not len(some):
        return chosen, size
    shares = np.zeros((n_docs, n_langs))
    shares[some], _ = rounds(np.full((len(some), n_langs), 1 / n_langs), np.ones((len(some), n_langs), dtype=bool), some)
    rank = np.argsort(np.argsort(-shares, axis=1, kind="stable"), axis=1, kind="stable")
    price = PENALTY * np.log(np.maximum(words, 2))
    for m in range(1, n_langs + 1):
        mine = some[value[some] < -m * price[some]]  # a log-likelihood is at most 0
        if not len(mine):
            break
        got, log = rounds(shares[mine], rank[mine] < m, mine)
        log -= m * price[mine]
        better = log > value[mine]
        chosen[mine[better]], size[mine[better]], value[mine[better]] = got[better], m, log[better]
    return chosen, size


def identify(docs: DataFrame, names: list[str], table: np.ndarray, text: str = "text") -> DataFrame:
    """Input columns plus lang_pred, score (the proportion of that language) and languages (those of
    the chosen set, by falling proportion)."""
    new = ["lang_pred", "score", "languages"]
    keep = [f for f in docs.schema.fields if f.name not in new]
    schema = T.StructType([*keep, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("languages", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = buffer_of(batch.column(text))
            for i, j in row_slices(batch.column(text)):
                if names:
                    owner, likelihood = _word_likelihoods(data[offsets[i]:offsets[j]],
                                                          offsets[i:j + 1] - offsets[i], table)
                    shares, size = mixtures(owner, likelihood, j - i)
                else:
                    shares, size = np.zeros((j - i, 1)), np.zeros(j - i, dtype=np.int64)
                order = np.argsort(-shares, axis=1, kind="stable")
                lettered = batch.column("_lettered").slice(i, j - i).to_numpy(zero_copy_only=False) & (size > 0)
                top = shares.max(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(f.name).slice(i, j - i) for f in keep),
                     pa.array([names[o[0]] if ok else UNKNOWN for o, ok in zip(order, lettered, strict=True)]),
                     pa.array(np.where(lettered, np.clip(top, 0.0, 1.0), 0.0)),
                     pa.array([[names[x] for x in o[:m]] if ok else [] for o, m, ok in
                               zip(order, size.tolist(), lettered, strict=True)], pa.list_(pa.string()))],
                    names=schema.names)

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_lettered")
    return docs.select(*(f.name for f in keep), lettered).mapInArrow(run, schema)
