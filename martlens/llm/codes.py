"""Vector code compression: parts of vectors become indexes into small codebooks.

A component x becomes the integer floor(4096 * x); a vector is cut into ``PARTS`` equal
consecutive parts, and every part position has a codebook that starts as that part of the
vectors of the smallest ids and moves to the floored means of its parts for ``ROUNDS`` rounds.

The nearest entry (squared Euclidean distance, ties to the lower index) is found by slicing
and intersecting bitmasks. For every dimension of a part position the entries' coordinates
are sorted, and for every place in that order a mask of 64-bit words holds the entries before it.
The distance to one entry, the next one along the widest dimension, gives an initial radius r:
an entry that is as near lies within r in every dimension. Two binary searches per dimension
give the slice of coordinates within r, the masks at its ends differ in the entries of the
slice, and the masks of all dimensions ANDed leave the candidates, among which the nearest
is by construction. Only their distances are computed. Nothing is approximate.

Spark sums the parts of each entry in every round; the driver sees the sums only, whose number is
parts * entries * (dimensions + 1) whatever the input. Codebooks travel with the tasks.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite component are
dropped, and so are rows of another length than the most frequent one that the parts divide
(ties to the shorter one); integers beyond what keeps a squared distance within 64 bits
are set to that bound (with 64 dimensions 1.9e8, x of 46,000); null ids come last among the
smallest ids, repeated ids are told apart by their vectors; fewer vectors than entries give fewer entries;
repeated rows are coded each on its own; an empty table gives an empty result; other
columns pass through, and input columns named like result columns are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.llm.common import saved

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
_WORD = 64


class Slices:
    """The codebook of one part position: entries, and per dimension their sorted coordinates and
    the masks of the entries before each place."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = np.asarray(entries, dtype=np.int64)
        k, d = self.entries.shape
        self.order = np.argsort(self.entries, axis=0, kind="stable")
        self.coordinates = np.take_along_axis(self.entries, self.order, axis=0).T.copy()
        self.before = np.zeros((d, -(-k // _WORD), k + 1), dtype=np.uint64)
        for j in range(d):
            for place, e in enumerate(self.order[:, j].tolist()):
                self.before[j, :, place + 1] = self.before[j, :, place]
                self.before[j, e // _WORD, place + 1] |= np.uint64(1 << (e % _WORD))
        self.widest = int(np.argmax(self.coordinates[:, -1] - self.coordinates[:, 0]))

    def within(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks (words x points) of the entries within the radius in every dimension."""
        masks = np.full((self.before.shape[1], len(points)), ~np.uint64(0), dtype=np.uint64)
        for j, line in enumerate(self.coordinates):
            lo = np.searchsorted(line, points[:, j] - radius, side="left")
            hi = np.searchsorted(line, points[:, j] + radius, side="right")
            masks &= self.before[j][:, hi] & ~self.before[j][:, lo]
        return masks

    def radius(self, points: np.ndarray) -> np.ndarray:
        """A radius within which the nearest entry lies: the distance to one entry, rounded up."""
        j = self.widest
        place = np.minimum(np.searchsorted(self.coordinates[j], points[:, j]), len(self.entries) - 1)
        gap = points - self.entries[self.order[place, j]]
        return np.sqrt((gap * gap).sum(axis=1).astype(np.float64)).astype(np.int64) + 1

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of every point."""
        masks = self.within(points, self.radius(points))
        index = np.zeros(len(points), dtype=np.int64)
        best = np.full(len(points), np.iinfo(np.int64).max)
        for e in range(len(self.entries)):
            rows = np.flatnonzero(masks[e // _WORD] >> np.uint64(e % _WORD) & np.uint64(1))
            gap = points[rows] - self.entries[e]
            found = (gap * gap).sum(axis=1)
            nearer = found < best[rows]  # ties stay with the lower index
            rows = rows[nearer]
            best[rows], index[rows] = found[nearer], e
        return index, best


class Codebooks:
    """Integer entries of all part positions: an array of parts x entries x dimensions of a part."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self._slices: list[Slices] | None = None

    def __getstate__(self):
        return {"entries": self.entries, "_slices": None}

    def assign(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every part of every point, both points x parts."""
        if self._slices is None:
            self._slices = [Slices(e) for e in self.entries]
        size = self.entries.shape[2]
        found = [s.nearest(np.ascontiguousarray(points[:, p * size:(p + 1) * size])) for p, s in enumerate(self._slices)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integer_vectors(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS) -> DataFrame:
    """The other columns and ``point`` (array of int), of the rows that are kept; a written table."""
    keep = [f for f in vectors.schema.fields if f.name not in (vector, "point")]
    schema = T.StructType([*keep, T.StructField("point", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            size = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
            flat = column.flatten()  # null lists have no values here
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            owner = np.repeat(np.arange(len(size)), size)
            bad = np.bincount(owner[~np.isfinite(x)], minlength=len(size)) > 0  # nulls are read as NaN
            ok = (size > 0) & (size % parts == 0) & ~bad
            most = np.array([(isqrt((1 << 63) // max(1, int(n))) >> 1) - 1 for n in size], dtype=np.float64)
            some = ok[owner]
            bound = np.minimum(most, np.iinfo(np.int32).max)[owner[some]]
            point = np.clip(np.floor(x[some] * SCALE), -bound, bound).astype(np.int32)
            offsets = np.r_[0, np.cumsum(size[ok])].astype(np.int32)
            rows = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(rows) for k in range(len(keep))),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(point))], names=schema.names)

    read = vectors.select(*(F.col(f"`{f.name}`") for f in keep), F.col(vector).cast("array<double>").alias("_x"))
    points = saved(read.mapInArrow(run, schema), "integer-vectors")
    usual = points.groupBy(F.size("point").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return points.where(F.size("point") == (usual.n if usual else 0))


def _points(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), -1)


def first_codebooks(points: DataFrame, vec_id: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the vectors of the smallest ids; None without vectors."""
    rows = points.orderBy(F.col(vec_id).asc_nulls_last(), "point").select("point").limit(entries).collect()
    if not rows:
        return None
    first = np.array([r.point for r in rows], dtype=np.int64)
    return Codebooks(first.reshape(len(first), parts, -1).transpose(1, 0, 2).copy())


def improved(points: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the floored mean of its parts; an unused one stays."""
    parts, entries, size = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, size + 1, entries), dtype=np.int64)  # the counts come last
        for batch in batches:
            x = _points(batch.column(0))
            index, _ = books.assign(x)
            for p in range(parts):
                for j in range(size):
                    sums[p, j] += np.bincount(index[:, p], weights=x[:, p * size + j], minlength=entries).astype(np.int64)
                sums[p, size] += np.bincount(index[:, p], minlength=entries)
        p, j, e = (a.ravel() for a in np.indices(sums.shape))
        yield pa.RecordBatch.from_arrays([*(pa.array(a.astype(np.int32)) for a in (p, j, e)), pa.array(sums.ravel())],
                                         names=["part", "place", "entry", "total"])

    sums = np.zeros((parts, size + 1, entries), dtype=object)
    rows = points.select("point").mapInArrow(run, "part int, place int, entry int, total long")
    for r in rows.groupBy("part", "place", "entry").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect():
        sums[r.part, r.place, r.entry] = int(r.total)
    new = books.entries.copy()
    for p in range(parts):
        for e in range(entries):
            if n := sums[p, size, e]:
                new[p, e] = [sums[p, j, e] // n for j in range(size)]
    return Codebooks(new)


def fit(points: DataFrame, vec_id: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES,
        rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of the integer vectors, from all of them; None without vectors."""
    books = first_codebooks(points, vec_id, parts, entries)
    for _ in range(rounds if books else 0):
        books = improved(points, books)
    return books


def encode(points: DataFrame, books: Codebooks) -> DataFrame:
    """Input columns but point, ``code`` (the entries' indexes, two hexadecimal digits each, four above 256
    entries) and ``error`` (sum of the squared distances)."""
    keep = [f for f in points.schema.fields if f.name not in ("point", "code", "error")]
    schema = T.StructType([*keep, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint8 if books.entries.shape[1] <= 256 else np.dtype(">u2")
        for batch in batches:
            index, error = books.assign(_points(batch.column(len(keep))))
            code = [row.tobytes().hex() for row in index.astype(kind)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(code, pa.string()),
                                              pa.array(error.sum(axis=1))], names=schema.names)

    return points.select(*(F.col(f"`{f.name}`") for f in keep), "point").mapInArrow(run, schema)


def decode(codes: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """Input columns plus ``vector``: the entries that a code names, as components (array of double)."""
    keep = [f for f in codes.schema.fields if f.name != "vector"]
    schema = T.StructType([*keep, T.StructField("vector", T.ArrayType(T.DoubleType()))])
    parts = len(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint8 if books.entries.shape[1] <= 256 else np.dtype(">u2")
        for batch in batches:
            index = [None if c is None else np.frombuffer(bytes.fromhex(c), dtype=kind) for c in batch.column(code).to_pylist()]
            vectors = [None if i is None else np.concatenate([books.entries[p, i[p]] for p in range(parts)]) / SCALE
                       for i in index]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep),
                                              pa.array(vectors, pa.list_(pa.float64()))], names=schema.names)

    return codes.select(*(F.col(f"`{f.name}`") for f in keep)).mapInArrow(run, schema)
