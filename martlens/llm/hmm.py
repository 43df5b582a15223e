"""Hidden Markov language model: Baum-Welch over partitions, exact scaled forward scores.

Words are emitted in two steps: a latent state emits the word's class, and the class emits
the word by its count in training. The most frequent words are classes of their own, their number in proportion
to the root of the number of distinct words, so the states learn of more words the larger the corpus
is (up to HOT_WORDS); all others fall into hashed classes. Training is Baum-Welch over every training document:
each task runs forward-backward over its documents, cut into segments of ``SEGMENT``
words, and the expected counts of all tasks are summed by Spark before the next step.
Scores use the whole text: a scaled forward recursion without cuts, so the score is the
exact log-likelihood of the sequence.

Counts are exact and cover all training documents. Words among the ``HOT_WORDS`` most
frequent are looked up inside the tasks (a table of bounded size); the others by a join
on their hash, where no word can hold a large share of the rows any more.

Defined cases: a null or empty text is the end token alone; a null id has the fold of an
empty text; words are compared by 64-bit hashes; without training documents every count
is zero and the model is uniform; repeated rows are scored each on its own; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.llm.common import crc_fold, most_frequent, saved
from martlens.llm.textkit import NON_SPACE, slices

FOLDS = 10
STATES = 8
ITERATIONS = 6
SEGMENT = 128
#: Words looked up inside tasks (16 bytes each).
HOT_WORDS = 1 << 18
#: Classes of several words each, told by their hash.
HASHED_CLASSES = 4096
#: Words with a class of their own: so many at least, and so many times the root of the number of distinct words,
#: of those looked up. What a task sends for every step grows with the classes, so they grow slower than the words.
LEAST_OWN, OWN_PER_ROOT = 4096, 4
ADD = 0.1
_PRIOR = 20.0  # weight of the class frequencies in each state's emissions
_TOKENS_AT_ONCE = 500_000


@dataclass
class Counts:
    """What the tasks know of the corpus, all of bounded size."""

    tokens: int
    distinct: int
    ends: int
    hot: np.ndarray  # hashes of frequent words, sorted
    hot_count: np.ndarray
    own: np.ndarray  # hashes of the words with a class of their own, sorted
    own_class: np.ndarray
    n_own: int  # classes of a single word; hashed classes follow
    class_tokens: np.ndarray | None = None
    class_words: np.ndarray | None = None

    @property
    def end(self) -> int:
        """The end token's class, which is the last one."""
        return self.n_own + HASHED_CLASSES

    def classes(self, h: np.ndarray) -> np.ndarray:
        out = (self.n_own + (h % np.uint64(HASHED_CLASSES)).astype(np.int64)).astype(np.int32)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
            mine = self.own[at] == h
            out[mine] = self.own_class[at[mine]]
        return out

    def log_class(self) -> np.ndarray:
        """log10 of what a word's count plus ADD is divided by, given its class."""
        unseen = np.r_[np.zeros(self.n_own), np.ones(HASHED_CLASSES)]
        whole = self.class_tokens + ADD * (self.class_words + unseen)
        return np.r_[np.log10(np.where(whole > 0, whole, 1.0)), np.log10(self.ends + ADD)]


def count_words(docs: DataFrame) -> DataFrame:
    """(h, c): hash and number of every word of the texts, combined within each batch first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.unique(w.hash, return_counts=True) for _, _, w in slices(batch.column("text"), NON_SPACE)]
            if parts:
                h, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                c = np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(h))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))],
                                                 names=["h", "c"])

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def corpus_counts(vocabulary: DataFrame, ends: int) -> Counts:
    """Totals, frequent words and class totals of a vocabulary table."""
    total = vocabulary.agg(F.sum("c"), F.count("*")).first()
    top = most_frequent(vocabulary, "c", HOT_WORDS).toPandas().sort_values(["c", "h"], ascending=[False, True])
    h = top["h"].to_numpy(dtype=np.int64).view(np.uint64)
    c = top["c"].to_numpy(dtype=np.float64)
    n_own = max(LEAST_OWN, min(HOT_WORDS, OWN_PER_ROOT * isqrt(total[1])))
    mine = h[:n_own]
    by_hash, own = np.argsort(h), np.argsort(mine)
    counts = Counts(int(total[0] or 0) + ends, total[1] + (1 if ends else 0), ends, h[by_hash], c[by_hash],
                    mine[own], own.astype(np.int32), n_own)
    n_classes = counts.end

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(n_classes), np.zeros(n_classes)
        for batch in batches:
            k = counts.classes(batch.column("h").to_numpy().view(np.uint64))
            n += np.bincount(k, weights=batch.column("c").to_numpy(), minlength=n_classes)
            v += np.bincount(k, minlength=n_classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_classes)), pa.array(n), pa.array(v)],
                                         names=["k", "n", "v"])

    rows = (vocabulary.mapInArrow(by_class, "k long, n double, v double").groupBy("k")
            .agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toPandas())
    counts.class_tokens, counts.class_words = np.zeros(n_classes), np.zeros(n_classes)
    counts.class_tokens[rows["k"]], counts.class_words[rows["k"]] = rows["n"], rows["v"]
    return counts


def _sequences(docs: DataFrame, counts: Counts) -> DataFrame:
    """Per document its class sequence with the end, what its frequent words add to the log
    counts, and its other words with how often they occur."""
    end_log, end_known = float(np.log10(counts.ends + ADD)), int(counts.ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.log10(counts.hot_count + ADD)
        for batch in batches:
            for i, j, words in slices(batch.column("text"), NON_SPACE):
                n, h = words.n_docs, words.hash
                size = np.diff(words.first)
                owner = np.repeat(np.arange(n), size)
                at = np.minimum(np.searchsorted(counts.hot, h), max(0, len(counts.hot) - 1))
                hot = counts.hot[at] == h if len(counts.hot) else np.zeros(len(h), dtype=bool)
                log_hot = np.bincount(owner[hot], weights=logs[at[hot]], minlength=n)
                known = np.bincount(owner[hot], minlength=n)
                rest, whose = h[~hot], owner[~hot]
                order = np.lexsort((rest, whose))
                rest, whose = rest[order], whose[order]
                new = np.ones(len(rest), dtype=bool)
                new[1:] = (rest[1:] != rest[:-1]) | (whose[1:] != whose[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.r_[first, len(rest)])
                cut = np.searchsorted(whose[first], np.arange(n + 1)).astype(np.int32)
                seq = np.full(len(h) + n, counts.end, dtype="<u4")
                seq[np.arange(len(h)) + owner] = counts.classes(h)
                raw, at_seq = seq.tobytes(), 4 * (words.first + np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i),
                     pa.array(size + 1, pa.int64()), pa.array(log_hot + end_log), pa.array(known + end_known, pa.int64()),
                     pa.array([raw[a:b] for a, b in zip(at_seq, at_seq[1:], strict=False)], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(cut), pa.array(rest[first].view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(cut), pa.array(times.astype(np.int32)))],
                    names=["doc_id", "held_out", "n_tokens", "log_hot", "known_hot", "classes", "rest", "times"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, log_hot double, known_hot long, "
                                "classes binary, rest array<long>, times array<int>")


@dataclass
class Model:
    start: np.ndarray  # states at the first word
    inside: np.ndarray  # states at any word, for segments that begin inside a text
    move: np.ndarray  # states x states
    emit: np.ndarray  # states x classes, the end token's last


def _class_share(counts: Counts) -> np.ndarray:
    n = np.r_[counts.class_tokens, counts.ends] + ADD
    return n / n.sum()


def first_model(counts: Counts, states: int = STATES) -> Model:
    """Class frequencies with a fixed random tilt per state, and states that tend to stay."""
    share, r = _class_share(counts), np.random.default_rng(7)
    emit = share * r.uniform(0.25, 1.75, (states, len(share)))
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    even = np.full(states, 1 / states)
    return Model(even, even, move, emit / emit.sum(axis=1, keepdims=True))


def _segments(sequences: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(matrix of classes, lengths, begins a text) for segments of about equal number of words."""
    flat = np.frombuffer(b"".join(sequences), dtype="<u4").astype(np.int32)
    size = np.array([len(s) // 4 for s in sequences])
    begin = np.cumsum(size) - size
    pieces = -(-size // SEGMENT)
    first = np.repeat(np.cumsum(pieces) - pieces, pieces)
    nth = np.arange(len(first)) - first
    at = np.repeat(begin, pieces) + nth * SEGMENT
    length = np.minimum(SEGMENT, np.repeat(begin + size, pieces) - at)
    order = np.argsort(-length, kind="stable")
    step = max(1, _TOKENS_AT_ONCE // SEGMENT)
    for i in range(0, len(order), step):
        o = order[i:i + step]
        place = at[o, None] + np.arange(int(length[o[0]]))[None, :]
        yield flat[np.minimum(place, len(flat) - 1)], length[o], nth[o] == 0


def expected_counts(model: Model, classes: np.ndarray, length: np.ndarray, begins: np.ndarray):
    """Scaled forward-backward over segments of falling length: log-likelihood, and expected
    counts of first states, of moves and of emissions."""
    n, most = classes.shape
    k = len(model.start)
    seen = model.emit.T[classes.T]  # word x segment x state
    live = np.searchsorted(-length, -np.arange(1, most + 1), side="right")  # segments that reach a word
    forward, scale = np.zeros((most, n, k)), np.ones((most, n))
    for t in range(most):
        m = live[t]
        a = np.where(begins[:m, None], model.start, model.inside) if t == 0 else forward[t - 1, :m] @ model.move
        a = a * seen[t, :m]
        scale[t, :m] = a.sum(axis=1)
        forward[t, :m] = a / scale[t, :m, None]
    moves = np.zeros((k, k))
    backward = np.ones((n, k))
    for t in range(most - 1, 0, -1):
        m = live[t]
        ahead = seen[t, :m] * backward[:m] / scale[t, :m, None]
        moves += forward[t - 1, :m].T @ ahead
        forward[t, :m] *= backward[:m]  # now the state posterior
        backward[:m] = ahead @ model.move.T
    forward[0] *= backward
    valid = np.arange(most)[:, None] < length[None, :]
    words, weight = classes.T[valid], forward[valid]
    emits = np.stack([np.bincount(words, weights=weight[:, s], minlength=model.emit.shape[1]) for s in range(k)], axis=1)
    return float(np.log10(scale[valid]).sum()), forward[0][begins].sum(axis=0), moves * model.move, emits


def baum_welch_step(texts: DataFrame, model: Model, counts: Counts) -> tuple[Model, float]:
    """One step over all texts. Each task sends one row per class; Spark sums them."""
    k, n = model.emit.shape  # states, classes
    columns = [f"s{s}" for s in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # classes, then a row of moves per state, then first states, then the log-likelihood
        total = np.zeros((n + k + 2, k))
        for batch in batches:
            raw = batch.column("classes").to_pylist()
            for i in range(0, len(raw), 2000):
                for classes, length, begins in _segments(raw[i:i + 2000]):
                    log, first, moves, emits = expected_counts(model, classes, length, begins)
                    total[:n] += emits
                    total[n:n + k] += moves
                    total[-2] += first
                    total[-1, 0] += log
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(total[some, s]) for s in range(k))],
                                         names=["row", *columns])

    schema = "row int, " + ", ".join(f"{c} double" for c in columns)
    rows = texts.select("classes").mapInArrow(run, schema).groupBy("row").agg(
        *(F.sum(c).alias(c) for c in columns)).toPandas()
    total = np.zeros((n + k + 2, k))
    total[rows["row"]] = rows[columns]
    emits, moves, first = total[:n].T, total[n:-2], total[-2]
    emit = (emits + _PRIOR * _class_share(counts)) / (emits.sum(axis=1, keepdims=True) + _PRIOR)
    moves, first, inside = moves + 1 / k, first + 1 / k, emits.sum(axis=1) + 1 / k
    return Model(first / first.sum(), inside / inside.sum(), moves / moves.sum(axis=1, keepdims=True), emit), \
        float(total[-1, 0])


def train(texts: DataFrame, counts: Counts, states: int = STATES, iterations: int = ITERATIONS) -> Model:
    model = first_model(counts, states)
    for _ in range(iterations):
        model, _ = baum_welch_step(texts, model, counts)
    return model


def log_likelihoods(model: Model, sequences: list[bytes]) -> np.ndarray:
    """log10 probability of whole class sequences by the scaled forward recursion."""
    flat = np.frombuffer(b"".join(sequences), dtype="<u4").astype(np.int32)
    size = np.array([len(s) // 4 for s in sequences], dtype=np.int64)
    begin = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], begin[order]
    emit, out = np.ascontiguousarray(model.emit.T), np.zeros(len(order))
    state = np.broadcast_to(model.start, (len(order), len(model.start)))
    live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if len(size) else 1), side="right")
    for t, m in enumerate(live.tolist()):
        state = (state[:m] if t == 0 else state[:m] @ model.move) * emit[flat[begin[:m] + t]]
        total = state.sum(axis=1)
        out[:m] += np.log10(total)
        state = state / total[:, None]
    back = np.empty_like(out)
    back[order] = out
    return back


def _model_scores(texts: DataFrame, model: Model, counts: Counts) -> DataFrame:
    log_class = counts.log_class()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("classes").to_pylist()
            if not raw:
                continue
            whole = np.concatenate([[0.0], np.cumsum(log_class[np.frombuffer(b"".join(raw), dtype="<u4")])])
            ends = np.cumsum([len(r) // 4 for r in raw])
            given = np.diff(whole[np.r_[0, ends]])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(log_likelihoods(model, raw) - given)],
                                             names=["row", "log_model"])

    return texts.select("row", "classes").mapInArrow(run, "row long, log_model double")


def language_model(docs: DataFrame) -> DataFrame:
    """Train on the training fold and score every document: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                       (crc_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"))
    training = docs.where(~F.col("held_out"))
    vocabulary = saved(count_words(training), "vocabulary")
    counts = corpus_counts(vocabulary, training.count())
    texts = saved(_sequences(docs, counts).withColumn("row", F.monotonically_increasing_id()), "class-sequences")
    model = train(texts.where(~F.col("held_out")), counts)

    rest = (texts.select("row", F.explode(F.arrays_zip("rest", "times")).alias("w"))
            .select("row", F.col("w.rest").alias("h"), F.col("w.times").alias("times"))
            .join(vocabulary, "h", "left").groupBy("row")
            .agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).alias("log_rest"),
                 F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known_rest")))
    whole = float(np.log10(counts.tokens + ADD * (counts.distinct + 1)))
    log_counts = F.col("log_hot") + F.coalesce("log_rest", F.lit(0.0))
    return (texts.drop("classes", "rest", "times").join(rest, "row", "left")
            .join(_model_scores(texts, model, counts), "row")
            .select("doc_id", "held_out", "n_tokens",
                    (F.col("known_hot") + F.coalesce("known_rest", F.lit(0))).cast("long").alias("n_known"),
                    F.lit(counts.tokens).cast("long").alias("train_tokens"),
                    (log_counts - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
                    (log_counts + F.col("log_model")).alias("score")))
