"""Quality classifier: ordinal cumulative-link regression on text features.

A grade rises from 0 to ``GRADES - 1``. One weight vector over hashed words, beginnings of
words, runs of marks and two shares (repeated words, runs of marks) gives a text's level, and ordered thresholds cut the level into grades:

    P(grade >= j) = 1 / (1 + exp(threshold_j - level))

so one set of weights serves all grades, and the expected grade and every tail
probability come from the same level. The fit uses at most ``MAX_LABELLED`` labelled
documents, those of the least hashed ids; it takes quasi-Newton steps on gradients that Spark
sums over their sparse features, while scoring is one map over all documents with the weights. A feature is the 64-bit hash of its
bytes with its family in the two low bits, so no other word stands for a screened one, and
in a text above ``STRETCH`` words it counts by its average in so many: a long text is judged
like its average stretch, whatever its length, and a short bad passage weighs less in it.

Defined cases: a null or empty text has no features and the level 0; labels with a null
id or grade are not used; the lowest of several grades of a document counts, and the least of several texts; without
labels of two grades nothing is rejected; repeated rows are scored each on its own; an
empty table gives an empty result; other columns pass through, and input columns named
like result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.llm.common import saved
from martlens.llm.textkit import ALNUM, NON_SPACE, Words, buffer_of, mix, row_slices

GRADES = 3
#: Bound of the labelled sample.
MAX_LABELLED = 20_000
#: A feature has a weight if so many labelled documents have it, and if their mean grade
#: differs from that of all by so many standard errors.
LEAST_DOCS, LEAST_ERRORS = 5, 4.5
PREFIX_BYTES = 4
#: In a text of more words and runs of marks than these, a feature counts by its average in so many.
STRETCH = 1000
DECAY = 2e-4
#: Quasi-Newton steps at most, those remembered, shorter tries of one at most, and the relative gain that ends them.
STEPS, MEMORY, BACKTRACKS, TOLERANCE = 60, 20, 8, 3e-5
#: Kept are documents whose chance of the highest grade is at least this.
KEEP_TOP = 0.5

_LOWER_MARKS = ~ALNUM & NON_SPACE
_SHAPE = 3  # family of the shares, in the two low bits of a feature
_SCREEN_ROWS = 500
_SUMS = 8  # tasks of a gradient; the sample is bounded


@dataclass
class Fitted:
    features: np.ndarray  # uint64, rising
    weights: np.ndarray  # float32, one for each feature
    thresholds: np.ndarray  # GRADES - 1, rising
    usable: bool


def _beginnings(words: Words) -> np.ndarray:
    """Hash of the first bytes of every word."""
    h = np.zeros(len(words.start), dtype=np.uint64)
    for k in range(PREFIX_BYTES):
        at = words.start + k
        here = np.where(at < words.end, words.data[np.minimum(at, len(words.data) - 1)], 0) if len(at) else h
        h = h * np.uint64(257) + here.astype(np.uint64) + np.uint64(1)
    return mix(h)


def _shape(words: Words, marks: Words) -> np.ndarray:
    """Per text the tenth that its share of words equal to the word before is in, and that of runs
    of several marks per word, as numbers of features."""
    n = np.maximum(np.diff(words.first), 1)
    same = np.zeros(len(words.start), dtype=bool)
    same[1:] = words.hash[1:] == words.hash[:-1]
    inner = words.first[:-1][words.first[:-1] < len(same)]
    same[inner] = False
    long = marks.end - marks.start > 1
    found = [np.bincount(np.repeat(np.arange(len(n)), np.diff(w.first)), weights=x, minlength=len(n))
             for w, x in ((words, same), (marks, long))]
    return np.stack([16 * k + np.minimum(9, np.floor(10 * x / n)).astype(np.int64) for k, x in enumerate(found)], axis=1)


def _features(batch: pa.RecordBatch, text: str, used: np.ndarray | None = None,
              ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, row of each feature, feature, value) of slices of a batch, by row and
    feature; of all features or of the sorted ``used`` alone."""
    column = batch.column(text)
    if not batch.num_rows:
        return
    data, offsets = buffer_of(column)
    for i, j in row_slices(column):
        part, cut, rows, keys = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], [], []
        words, marks = Words(part, cut, ALNUM), Words(part, cut, _LOWER_MARKS)
        for family, (w, h) in enumerate(((words, words.hash), (words, _beginnings(words)), (marks, marks.hash))):
            row, key = np.repeat(np.arange(j - i), np.diff(w.first)), h & ~np.uint64(3) | np.uint64(family)
            if used is not None:
                some = _among(key, used)
                row, key = row[some], key[some]
            rows.append(row)
            keys.append(key)
        shape = _shape(words, marks)
        rows.append(np.repeat(np.arange(j - i), shape.shape[1]))
        keys.append(shape.astype(np.uint64).ravel() << np.uint64(2) | np.uint64(_SHAPE))
        if used is not None:
            some = _among(keys[-1], used)
            rows[-1], keys[-1] = rows[-1][some], keys[-1][some]
        row, key = np.concatenate(rows), np.concatenate(keys)
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])][:len(row)])
        n, row, key = np.diff(np.r_[new, len(row)]), row[new], key[new]
        size = np.diff(words.first) + np.diff(marks.first)
        per = np.where(key & np.uint64(3) == _SHAPE, 1.0, np.minimum(1.0, STRETCH / np.maximum(size, 1))[row])
        yield i, j, row, key, np.log1p(n * per).astype(np.float32)


def _among(key: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array ``used``."""
    if not len(used):
        return np.zeros(len(key), dtype=bool)
    return used[np.minimum(np.searchsorted(used, key), len(used) - 1)] == key


def sample(docs: DataFrame, grades: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """(grade, features, values) of the labelled sample. grades: doc_id, grade."""
    labels = (grades.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    rows = (docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")  # at most `bound` narrow rows
            .groupBy("doc_id", "grade").agg(F.min("text").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grade = batch.column("grade").to_numpy()
            for i, j, row, feature, value in _features(batch, "text"):
                cut = np.searchsorted(row, np.arange(j - i + 1))
                feature, value = feature.astype("<u8"), value.astype("<f4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grade[i:j], pa.int32()),
                     *(pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())
                       for x in (feature, value))], names=["grade", "features", "vals"])

    return rows.select("text", F.col("grade").cast("int")).mapInArrow(run, "grade int, features binary, vals binary")


def _screened(rows: DataFrame) -> np.ndarray:
    """Features that enough documents have and whose mean grade differs enough, found by Spark."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _SCREEN_ROWS):
                part = batch.slice(i, _SCREEN_ROWS)
                feature = [np.frombuffer(x, dtype="<u8") for x in part.column("features").to_pylist()]
                grade = np.repeat(part.column("grade").to_numpy(), [len(x) for x in feature])
                feature, at = np.unique(np.concatenate(feature), return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(feature.view(np.int64)), pa.array(np.bincount(at, minlength=len(feature)).astype(np.float64)),
                     pa.array(np.bincount(at, weights=grade, minlength=len(feature)).astype(np.float64))],
                    names=["feature", "n", "total"])

    whole = rows.agg(F.avg("grade"), F.stddev_pop("grade")).first()
    features = (rows.select("grade", "features").mapInArrow(count, "feature long, n double, total double")
                .groupBy("feature").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where(F.col("n") >= LEAST_DOCS))
    errors = F.abs(F.col("total") / F.col("n") - F.lit(whole[0])) * F.sqrt("n") / F.lit(whole[1])
    return np.sort(np.array([r.feature for r in features.where(errors >= LEAST_ERRORS).select("feature").collect()],
                            dtype=np.int64).view(np.uint64))


def _matrix(rows: DataFrame, used: np.ndarray) -> DataFrame:
    """(grade, columns, vals): the places of the used features of every row, and their values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for f, v in zip(batch.column("features").to_pylist(), batch.column("vals").to_pylist(), strict=True):
                feature = np.frombuffer(f, dtype="<u8")
                keep = _among(feature, used)
                out.append((np.searchsorted(used, feature[keep]).astype("<i4").tobytes(),
                            np.frombuffer(v, dtype="<f4")[keep].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("grade"), *(pa.array([x[k] for x in out], pa.binary()) for k in range(2))],
                names=["grade", "columns", "vals"])

    return saved(rows.mapInArrow(run, "grade int, columns binary, vals binary").coalesce(_SUMS), "labelled-matrix")


def _cuts(free: np.ndarray) -> np.ndarray:
    """Rising thresholds of free parameters: the first one, and the logarithms of the gaps."""
    return free[0] + np.r_[0.0, np.cumsum(np.exp(free[1:]))]


def partial_loss(grade: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, w: np.ndarray,
                 free: np.ndarray) -> np.ndarray:
    """Sum of -log P(grade) over rows, and its gradient by the free parameters and the weights."""
    n, cuts = len(grade), _cuts(free)
    level = np.bincount(row, weights=value * w[col], minlength=n)
    tail = 1 / (1 + np.exp(np.clip(cuts[None, :] - level[:, None], -40, 40)))  # P(grade >= j)
    full = np.c_[np.ones(n), tail, np.zeros(n)]
    mine = np.maximum(full[np.arange(n), grade] - full[np.arange(n), grade + 1], 1e-9)
    slope, j = tail * (1 - tail) / mine[:, None], np.arange(1, GRADES)[None, :]
    # derivative of -log P(grade) by each tail's own level
    part = np.where(j == grade[:, None] + 1, slope, 0.0) - np.where(j == grade[:, None], slope, 0.0)
    by_cut = -part.sum(axis=0)
    by_free = [by_cut.sum(), *(by_cut[k + 1:].sum() * np.exp(free[k + 1]) for k in range(GRADES - 2))]
    by_weight = np.bincount(col, weights=value * part.sum(axis=1)[row], minlength=len(w))
    return np.r_[-np.log(mine).sum(), by_free, by_weight]


def _loss(matrix: DataFrame, n: int, at: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss with the decay of the weights, and its gradient. Every task sends one vector of the
    gradient's length; there are at most _SUMS tasks."""
    free, w = at[:GRADES - 1], at[GRADES - 1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + len(at))
        for batch in batches:
            size = np.asarray(pc.binary_length(batch.column("columns"))) // 4
            col, value = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=t) for c, t in (("columns", "<i4"), ("vals", "<f4")))
            total += partial_loss(batch.column("grade").to_numpy(), np.repeat(np.arange(len(size)), size), col, value, w, free)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                          pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    parts = sorted(matrix.mapInArrow(run, "part int, total binary").collect())  # in order, so a rerun adds up the same
    total = np.sum([np.frombuffer(r.total) for r in parts], axis=0) / n
    total[GRADES:] += DECAY * w
    return float(total[0] + DECAY / 2 * w @ w), total[1:]


def _squares(matrix: DataFrame, n: int, columns: int) -> np.ndarray:
    """Mean square of every column's values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(columns)
        for batch in batches:
            col, value = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=t) for c, t in (("columns", "<i4"), ("vals", "<f4")))
            total += np.bincount(col, weights=value.astype(np.float64) ** 2, minlength=columns)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                          pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    parts = sorted(matrix.mapInArrow(run, "part int, total binary").collect())
    return np.sum([np.frombuffer(r.total) for r in parts], axis=0) / n


def _minimum(loss, at: np.ndarray) -> np.ndarray:
    """A point of least loss by limited-memory quasi-Newton steps with backtracking."""
    value, slope = loss(at)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        step, back = slope.copy(), []
        for s, y in reversed(moves):
            back.append(s @ step / (s @ y))
            step -= back[-1] * y
        step *= moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, np.linalg.norm(slope))
        for (s, y), a in zip(moves, reversed(back), strict=True):
            step += (a - y @ step / (s @ y)) * s
        pace = 1.0
        for _ in range(BACKTRACKS):
            new = at - pace * step
            found, ahead = loss(new)
            if found <= value - 1e-4 * pace * (slope @ step):
                break
            pace /= 4
        else:
            return at
        if (new - at) @ (ahead - slope) > 1e-12:
            moves = [*moves[-MEMORY + 1:], (new - at, ahead - slope)]
        done = value - found < TOLERANCE * value
        at, value, slope = new, found, ahead
        if done:
            break
    return at


def fit(rows: DataFrame) -> Fitted:
    """Fit weights and thresholds to the bounded sample. Spark screens the features and sums the
    gradients; the driver holds the screened features, their weights and a few gradients."""
    rows = saved(rows, "labelled-sample")
    counts = {r.grade: r["count"] for r in rows.groupBy("grade").count().collect()}
    if len(counts) < 2:
        return Fitted(np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.float32),
                      np.arange(GRADES - 1, dtype=np.float64), False)
    used, n = _screened(rows), sum(counts.values())
    matrix = _matrix(rows, used)
    share = np.array([sum(c for g, c in counts.items() if g >= j) / n for j in range(1, GRADES)]).clip(0.01, 0.99)
    cuts = np.maximum.accumulate(np.log(1 / share - 1) + 1e-3 * np.arange(GRADES - 1))
    first = np.r_[cuts[0], np.log(np.maximum(np.diff(cuts), 1e-2)), np.zeros(len(used))]
    # weights are fitted in units in which all columns are about as steep, which takes fewer steps
    unit = np.r_[np.ones(GRADES - 1), 1 / np.sqrt(_squares(matrix, n, len(used)) + 1e-3)]

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        value, slope = _loss(matrix, n, at * unit)
        return value, slope * unit

    best = _minimum(loss, first / unit) * unit
    return Fitted(used, best[GRADES - 1:].astype(np.float32), _cuts(best[:GRADES - 1]), True)


def grade_texts(docs: DataFrame, fitted: Fitted, text: str = "text") -> DataFrame:
    """Input columns plus expected_grade, tail probabilities p_1 .. p_(GRADES-1), grade and keep."""
    tails = [f"p_{j}" for j in range(1, GRADES)]
    new = ["expected_grade", *tails, "grade", "keep"]
    keep = [f for f in docs.schema.fields if f.name not in new]
    schema = T.StructType([*keep, T.StructField("expected_grade", T.DoubleType()),
                           *(T.StructField(t, T.DoubleType()) for t in tails),
                           T.StructField("grade", T.IntegerType()), T.StructField("keep", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, row, feature, value in _features(batch, text, fitted.features):
                level = np.bincount(row, weights=value * fitted.weights[np.searchsorted(fitted.features, feature)],
                                    minlength=j - i)
                tail = 1 / (1 + np.exp(np.clip(fitted.thresholds[None, :] - level[:, None], -40, 40)))
                each = -np.diff(np.c_[np.ones(j - i), tail, np.zeros(j - i)], axis=1)
                kept = (tail[:, -1] >= KEEP_TOP) | (not fitted.usable)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(f.name).slice(i, j - i) for f in keep), pa.array(tail.sum(axis=1)),
                     *(pa.array(tail[:, k]) for k in range(GRADES - 1)),
                     pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(kept)], names=schema.names)

    return docs.select(*(f.name for f in keep)).mapInArrow(run, schema)


def grade_of(quality: Column, toxic: Column) -> Column:
    """Graded rating of the label columns: 0 toxic, 1 of low quality, 2 good; null where unknown."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 2)
