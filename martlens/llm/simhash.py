"""SimHash near duplicates by the generalised pigeonhole principle.

A text's fingerprint has 64 bits; a bit is 1 if it is set in over half of the hashes (XXH64,
seed 42) of its shingles of three words, repeats included. Texts link when fingerprints differ in
at most ``DISTANCE`` bits. Equal fingerprints are one record, however many documents carry them.

Links between records are found by partitions of the bits. If thresholds t_i of the partitions,
each -1 or more, have t_i + 1 in sum DISTANCE + 1, then two fingerprints within DISTANCE differ in at
most t_i bits in some partition i; -1 leaves a partition out. So:

1. Co-occurrences of bits over all records are summed by Spark, and bits that go together are put
   into one partition, which keeps the others near to uniform. Their number is the one with the
   least expected work for so many records.
2. Counts of records per partition and value, in ``SLOTS`` slots, give an estimate of the
   candidates that a partition brings under each threshold. For every record, dynamic
   programming over partitions and thresholds allots the thresholds with the least work: rows to
   probe with, and candidates.
3. Every record is indexed under its values, and probes with all values within its thresholds; the
   join on (partition, value) gives candidates, which are verified on all bits.
4. A record of a dense family would meet all of it in any partition. Where probing costs more than
   ``DISTANCE`` met halfway in one partition of all bits, it does that instead: all fingerprints
   within DISTANCE / 2 bits of it are its rows (65), two records are within DISTANCE if they share
   one, and a star to the least record of each value joins them without pairs. Pairs of a
   dense and another record are found by the other one's probes. Index rows of values that are
   too frequent for any probe are left out, as no probe asks for them.

So a record costs at most the rows of step 4 or candidates worth as much, however many copies,
near copies or frequent values there are, and the join loses no link.

Defined cases: null, empty and blank texts have the fingerprint zero and link like any other; a
text of fewer words than a shingle has one shingle, all of it; repeated rows are copies of
each other; a component's id is its least non-null doc_id, null if it has none; an empty table gives an
empty result; other columns pass through, and input columns named like result columns are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb, inf, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.llm.common import join_by_count, saved
from martlens.llm.graph import components
from martlens.llm.textkit import buffer_of

BITS = 64
SHINGLE_WORDS = 3
SEED = 42
#: Fingerprints link at so many differing bits; an even number, since step 4 halves it.
DISTANCE = 2
#: Slots of the counts per partition; a bound of what travels with the tasks, values share slots beyond it.
SLOTS = 1 << 18
#: Work of a candidate to be verified against that of a row to be probed with.
CANDIDATE = 0.25
MOST_PARTITIONS = 8

_CHUNK = 1 << 15
_ROWS = 1 << 13
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
_BYTE_PLACE = 256 * np.arange(8)


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: bytes) -> int:
    """The fingerprint of a text's UTF-8 bytes, unsigned."""
    words = text.lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][:len(words) - SHINGLE_WORDS + 1]
    ends = ends[SHINGLE_WORDS - 1:]
    ones = np.zeros((8, 8), dtype=np.int64)
    for i in range(0, len(starts), _CHUNK):
        cuts = map(slice, starts[i:i + _CHUNK].tolist(), ends[i:i + _CHUNK].tolist())
        n = min(_CHUNK, len(starts) - i)
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), dtype="<u8", count=n)
        per_byte = np.bincount((h.view(np.uint8).reshape(n, 8) + _BYTE_PLACE).ravel(), minlength=2048).reshape(8, 256)
        ones += per_byte @ _BIT_OF_BYTE
    return int(np.packbits((2 * ones > len(starts)).ravel(), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Input columns but the text, and ``fingerprint`` (long, the 64 bits as a signed number)."""
    keep = [f for f in docs.schema.fields if f.name not in (text, "fingerprint")]
    schema = T.StructType([*keep, T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column(len(keep)))
            found = np.array([fingerprint(data[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)],
                             dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(found)],
                                             names=schema.names)

    return docs.select(*(F.col(f"`{f.name}`") for f in keep), F.col(text).cast("string").alias("_text")) \
        .mapInArrow(run, schema)


# ---------------------------------------------------------------- partitions

def together(records: DataFrame) -> np.ndarray:
    """Matrix of how often two bits are 1 in the same record; the diagonal counts the bit itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), dtype=np.int64)
        for batch in batches:
            f = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(f), _ROWS):
                bits = ((f[i:i + _ROWS, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
        a, b = (x.ravel().astype(np.int32) for x in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total.ravel())], names=["a", "b", "n"])

    out = np.zeros((BITS, BITS))
    for r in records.select("fingerprint").mapInArrow(run, "a int, b int, n long").groupBy("a", "b") \
            .agg(F.sum("n").alias("n")).collect():
        out[r.a, r.b] = r.n
    return out


def arranged(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The bits in m partitions of nearly equal size, each grown from one bit by the bit that is most
    correlated with those in it. both: ``together`` of n records."""
    share = both / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(share - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, groups = list(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        group = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (tie[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _least_work(work: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Dynamic programming over partitions. work: (partitions, total + 1, records), the work with
    threshold t - 1 in a partition. Returns the least work per record and its t per partition."""
    m, _, n = work.shape
    best = np.full((total + 1, n), inf)
    best[0] = 0
    choice = np.zeros((m, total + 1, n), dtype=np.int8)
    for i in range(m):
        new = np.full_like(best, inf)
        for used in range(total + 1):
            for t in range(used + 1):
                here = best[used - t] + work[i, t]
                better = here < new[used]
                new[used][better] = here[better]
                choice[i, used][better] = t
        best = new
    taken = np.zeros((m, n), dtype=np.int8)
    used, rows = np.full(n, total), np.arange(n)
    for i in range(m - 1, -1, -1):
        taken[i] = choice[i, used, rows]
        used = used - taken[i]
    return best[total], taken


def halfway_rows(distance: int = DISTANCE) -> int:
    """Fingerprints within half the distance of one."""
    return sum(comb(BITS, k) for k in range(distance // 2 + 1))


def how_many_partitions(n: int, distance: int = DISTANCE) -> int:
    """The number of partitions with the least expected work for n evenly spread records."""
    def expected(m: int) -> float:
        work = np.full((m, distance + 2, 1), inf)
        work[:, 0] = 0
        for i in range(m):
            width = BITS // m + (i < BITS % m)
            for t in range(1, distance + 2):
                probes = sum(comb(width, k) for k in range(t))
                work[i, t] = probes * (1 + CANDIDATE * n / 2.0 ** width)
        return float(_least_work(work, distance + 1)[0][0])
    return min(range(1, MOST_PARTITIONS + 1), key=lambda m: (expected(m), m))


class Plan:
    """Partitions, counts of their values, and from them the thresholds of every record."""

    def __init__(self, groups: list[list[int]], n: int, distance: int = DISTANCE) -> None:
        self.groups, self.n, self.distance = groups, n, distance
        self.counts = np.zeros((len(groups), SLOTS), dtype=np.float32)
        self.most = float(halfway_rows(distance))
        # thresholds whose probes alone cost too much are never taken
        self.flips = [[self._flips(len(g), t) for t in range(distance + 1)
                       if sum(comb(len(g), k) for k in range(t + 1)) <= self.most] for g in groups]

    @staticmethod
    def _flips(width: int, distance: int) -> np.ndarray:
        """Masks of up to ``distance`` differing bits."""
        return np.array([sum(1 << b for b in c) for k in range(distance + 1) for c in combinations(range(width), k)],
                        dtype=np.uint64)

    def value(self, i: int, f: np.ndarray) -> np.ndarray:
        """The bits of partition i, packed."""
        out = np.zeros(len(f), dtype=np.uint64)
        for k, b in enumerate(self.groups[i]):
            out |= (f >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
        return out

    def slot(self, i: int, value: np.ndarray) -> np.ndarray:
        if len(self.groups[i]) <= log2(SLOTS):
            return value.astype(np.int64)
        spread = value * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(BITS - int(log2(SLOTS)))).astype(np.int64)

    def estimate(self, i: int, value: np.ndarray) -> np.ndarray:
        """About how many records have a value in partition i: the count of its slot less what others
        are expected to bring to it."""
        width = len(self.groups[i])
        others = max(0.0, self.n / SLOTS - self.n / 2.0 ** width) if width > log2(SLOTS) else 0.0
        return np.maximum(self.counts[i][self.slot(i, value)] - others, 0.0)

    def too_many(self, i: int, value: np.ndarray) -> np.ndarray:
        """Values that no record can afford to probe: it would take the way halfway instead."""
        return 1 + CANDIDATE * self.estimate(i, value) > self.most

    def thresholds(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(work, threshold + 1 per partition) of every record."""
        work = np.full((len(self.groups), self.distance + 2, len(f)), inf)
        work[:, 0] = 0
        for i, flips in enumerate(self.flips):
            value, total, done = self.value(i, f), np.zeros(len(f)), 0
            for t, masks in enumerate(flips):
                for mask in masks[done:]:
                    total += 1 + CANDIDATE * self.estimate(i, value ^ mask)
                done = len(masks)
                work[i, t + 1] = total
        return _least_work(work, self.distance + 1)


def plan(records: DataFrame, n: int, distance: int = DISTANCE, partitions: int | None = None) -> Plan:
    """Partitions and counts of the values of all n records."""
    out = Plan(arranged(together(records), n, partitions or how_many_partitions(n, distance)), n, distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy().view(np.uint64)
            for i in range(len(out.groups)):
                slot, count = np.unique(out.slot(i, out.value(i, f)), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((slot + i * SLOTS).astype(np.int32)), pa.array(count.astype(np.int64))], names=["slot", "n"])

    counted = records.select("fingerprint").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")) \
        .where(F.col("n") > 1)  # a record alone in its slot is no other's candidate
    got = counted.toArrow()  # at most SLOTS rows per partition of the bits
    counts = np.zeros(out.counts.size, dtype=np.float32)
    counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    out.counts = counts.reshape(out.counts.shape)
    return out


# ---------------------------------------------------------------- links

def _rows_of(records: DataFrame, plan: Plan) -> DataFrame:
    """(kind, part, value, f): index rows, probes, and the rows of those that meet halfway."""
    radius = plan.distance // 2
    around = Plan._flips(BITS, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(whole), _ROWS):
                f = whole[at:at + _ROWS]
                work, taken = plan.thresholds(f)
                dense = work > plan.most
                out = []
                for i, flips in enumerate(plan.flips):
                    value = plan.value(i, f)
                    some = ~plan.too_many(i, value)
                    out.append((0, i, value[some], f[some]))
                    for t, masks in enumerate(flips):
                        asks = (taken[i] == t + 1) & ~dense
                        out.append((1, i, (value[asks][:, None] ^ masks[None, :]).ravel(), np.repeat(f[asks], len(masks))))
                for k in range(0, int(dense.sum()), 1024):
                    own = f[dense][k:k + 1024]
                    out.append((2, 0, (own[:, None] ^ around[None, :]).ravel(), np.repeat(own, len(around))))
                for kind, i, value, own in out:
                    if len(own):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(own), kind, dtype=np.int8)), pa.array(np.full(len(own), i, dtype=np.int8)),
                             pa.array(value.view(np.int64)), pa.array(own.view(np.int64))],
                            names=["kind", "part", "value", "f"])

    return records.select("fingerprint").mapInArrow(run, "kind byte, part byte, value long, f long")


def links(records: DataFrame, plan: Plan) -> DataFrame:
    """(u, v) fingerprints within the distance: all pairs with a record that is not dense, and for the
    dense ones a star that connects all that are within the distance of each other."""
    rows = saved(_rows_of(records, plan), "simhash-rows")
    index, probes, halfway = (rows.where(F.col("kind") == k).drop("kind") for k in range(3))
    found = (index.join(probes.withColumnRenamed("f", "q"), ["part", "value"])
             .where((F.col("f") != F.col("q")) & (F.bit_count(F.col("f").bitwiseXOR(F.col("q"))) <= plan.distance))
             .select(F.least("f", "q").alias("u"), F.greatest("f", "q").alias("v")))
    halfway = halfway.select("value", "f")
    least = halfway.groupBy("value").agg(F.min("f").alias("v"), F.max("f").alias("last")).where("v < last").drop("last")
    stars = halfway.join(least, "value").select(F.col("f").alias("u"), "v").where("u <> v")
    return found.unionByName(stars)


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, partitions: int | None = None) -> DataFrame:
    """Input columns but text, ``fingerprint`` (long) and ``component_id`` (the least doc_id of the
    component). ``partitions`` fixes the number of partitions, which changes the work only."""
    if distance % 2 or distance < 0:
        raise ValueError("the distance is an even number of bits")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    owners = saved(fingerprints(docs.drop("component_id")), "simhash-fingerprints")
    records = saved(owners.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")),
                    "simhash-records")
    size = records.agg(F.count("*"), F.sum("n")).first()
    found = components(links(records, plan(records, size[0], distance, partitions)))
    named = records.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left") \
        .withColumn("root", F.coalesce("root", "fingerprint"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = saved(named.join(ids, "root").select("fingerprint", "component_id", "n"), "simhash-components")
    return join_by_count(owners, labels, "fingerprint", "n", size[1] or 0).select(*owners.columns, "component_id")
