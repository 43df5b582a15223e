"""N-gram Jaccard join by T-occurrence search (DivideSkip), and its components.

Two documents link when their sets of distinct word shingles have a Jaccard
similarity of at least 4/5, that is 9 * overlap >= 4 * (size + size). The join is
exact on 64-bit hashes of which 54 bits stay in lists:

1. Equal sets are one record (a signature), however many documents carry them.
2. Shingles go through one shuffle, packed into one integer each, to count in how
   many records they occur. Those of one record cannot add to an overlap and stop
   there; the others go back to their records, rarest first.
3. Two similar records share one of the first ``n - ceil(4n/5) + 1`` shingles of
   that order. Records that share such a shingle, directly or by others, form a
   block; stars to the least record of every list give the blocks without pairs.
4. A block is searched in one task with inverted lists: short lists are merged by
   counting, the longest ones are only probed, by binary search, for records that
   the short ones leave within reach of the required overlap. A block above
   ``BLOCK_SHINGLES`` or ``BLOCK_RECORDS`` is dealt in chunks, one task for each pair of chunks.
5. Components of the links found.

Shingles of very many records (found by exact counts within batches, at most
``HOT_SHINGLES``) skip the shuffle of step 2, so no list there holds a large share
of the rows; they stay in the sets and come last in the order. That choice changes
the work only, never the result.

Defined cases: null or blank texts have empty sets and link with nothing; a text of
fewer words than a shingle has one shingle, its whole sequence; repeated rows are
copies of each other; a component's id is its least non-null doc_id, null if it has
none; an empty table gives an empty result; other columns pass through, and input
columns named like result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.llm.common import most_frequent, saved
from martlens.llm.graph import components
from martlens.llm.textkit import NON_SPACE, mix, row_slices, shingle_sets, slices

SHINGLE_WORDS = 5
#: Shingles that skip the counting shuffle; bounds the broadcast list (8 bytes each).
HOT_SHINGLES = 1 << 17
#: Bytes of text whose records are packed together.
PACKED_TEXT = 4 << 20
#: A shingle counts towards the hot ones from so many records of one pack on.
HOT_IN_BATCH = 4
#: Counting groups, and one more for so many shingles of all documents.
LEAST_BUCKETS, SHINGLES_PER_BUCKET = 8, 1 << 20
#: Shingles of a block in one chunk; a block of many records is dealt in chunks of so many too, up to a number of chunks.
BLOCK_SHINGLES, BLOCK_RECORDS, RECORD_CHUNKS = 4_000_000, 512, 16
#: Weight of a binary probe against a merge step when the number of long lists is chosen.
PROBE_WEIGHT = 1.0

_HASH_BITS = np.uint64(54)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One 64-bit signature per set; equal for equal sets only (up to hashing)."""
    out = np.empty(len(sets), dtype=np.int64)
    for i, s in enumerate(sets):
        h = np.sum(mix(s ^ np.uint64(0x5BD1E9955BD1E995)), dtype=np.uint64) + np.uint64(len(s))
        out[i] = mix(np.array([h], dtype=np.uint64)).view(np.int64)[0]
    return out


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose records are handled together, of fewer than 2**16 rows."""
    for batch in batches:
        for i, j in row_slices(batch.column("text"), PACKED_TEXT):
            for at in range(i, j, 1 << 14):
                yield batch.slice(at, min(1 << 14, j - at))


def _distinct(batch: pa.RecordBatch, seen: dict[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """(signature, set) of the non-empty sets of a batch that it has not seen before."""
    for _, _, words in slices(batch.column("text"), NON_SPACE):
        sets = shingle_sets(words, SHINGLE_WORDS)
        for sig, s in zip(_signatures(sets).tolist(), sets, strict=True):
            if len(s) and sig not in seen:
                seen[sig] = len(seen)
                yield sig, s


def _order_class(df: np.ndarray) -> np.ndarray:
    return np.minimum(63, 2 * np.log2(df)).astype(np.uint64)


def _short_hash(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(16)) << np.uint64(6)) | (h & np.uint64(63))


def hot_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and order keys of the shingles found in most records."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _packs(batches):
            sets = [s for _, s in _distinct(batch, {})]
            if sets:
                h, n = np.unique(np.concatenate(sets), return_counts=True)
                h, n = h[n >= HOT_IN_BATCH], n[n >= HOT_IN_BATCH]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))],
                                                 names=["h", "n"])

    counts = saved(docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")),
                   "hot-shingles")
    rows = most_frequent(counts, "n", HOT_SHINGLES).toArrow()
    h, n = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy().astype(np.float64)
    order = np.argsort(h)
    h, n = h[order], n[order]
    return h, ((np.uint64(64) + _order_class(np.maximum(n, 1))) << _HASH_BITS) | _short_hash(h)


def _is_hot(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(s), dtype=bool)
    return hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s


def signatures(docs: DataFrame, hot: np.ndarray, keys: np.ndarray) -> DataFrame:
    """Input columns but text, n_shingles, sig, and the order keys of the hot shingles of the set."""
    keep = [f for f in docs.schema.fields if f.name not in ("text", "n_shingles", "sig", "hot")]
    schema = T.StructType([*keep, T.StructField("n_shingles", T.LongType()), T.StructField("sig", T.LongType()),
                           T.StructField("hot", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in slices(batch.column("text"), NON_SPACE):
                sets = shingle_sets(words, SHINGLE_WORDS)
                own = [np.sort(keys[np.searchsorted(hot, s[_is_hot(s, hot)])]).view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(f.name).slice(i, j - i) for f in keep), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(_signatures(sets)), pa.array(own, pa.list_(pa.int64()))], names=schema.names)

    return docs.select(*(f.name for f in keep), "text").mapInArrow(run, schema)


def shared_shingles(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """(sig, key) for every shingle, but the hot ones, that two records or more have."""
    low = np.uint64((1 << 16) - 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _packs(batches):
            found = [(sig, s[~_is_hot(s, hot)]) for sig, s in _distinct(batch, {})]
            if not found:
                continue
            sigs = np.array([sig for sig, _ in found], dtype=np.int64)
            h = np.concatenate([s for _, s in found])
            local = np.repeat(np.arange(len(found), dtype=np.uint64), [len(s) for _, s in found])
            bucket = (h & low) % np.uint64(min(buckets, 1 << 16))
            if buckets > 1 << 16:  # more bits are taken from the other end of the hash
                bucket += np.uint64(1 << 16) * ((h >> np.uint64(40)) % np.uint64(-(-buckets >> 16)))
            order = np.argsort(bucket.astype(np.int64), kind="stable")
            bucket, entry = bucket[order].astype(np.int64), ((h & ~low) | local)[order]
            low6 = (h & np.uint64(63))[order].astype(np.uint8)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            rows = []
            for b, e, six in zip(bucket[np.r_[0, cuts]] if len(bucket) else [], np.split(entry, cuts),
                                 np.split(low6, cuts), strict=False):
                used, place = np.unique(e & low, return_inverse=True)
                rows.append((int(b), sigs[used.astype(np.int64)].tobytes(),
                             ((e & ~low) | place.astype(np.uint64)).tobytes(), six.tobytes()))
            if rows:
                b, s, e, six = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b, pa.int64()), *(pa.array(x, pa.binary()) for x in (s, e, six))],
                    names=["bucket", "sigs", "entries", "low6"])

    def shared(group: pa.Table) -> pa.Table:
        h, sig = [], []
        for s, e, six in zip(*(group.column(c).to_pylist() for c in ("sigs", "entries", "low6")), strict=True):
            e = np.frombuffer(e, dtype=np.uint64)
            h.append(((e >> np.uint64(16)) << np.uint64(6)) | np.frombuffer(six, dtype=np.uint8))
            sig.append(np.frombuffer(s, dtype=np.int64)[(e & low).astype(np.int64)])
        h, sig = np.concatenate(h), np.concatenate(sig)
        # most shingles have one entry only: they go before the full sort
        order = np.argsort(h, kind="stable")
        h, sig = h[order], sig[order]
        same = h[1:] == h[:-1]
        keep = np.r_[same, False] | np.r_[False, same]
        h, sig = h[keep], sig[keep]
        order = np.lexsort((sig, h))
        h, sig = h[order], sig[order]
        new = np.ones(len(h), dtype=bool)  # the same record can come from two batches
        new[1:] = (h[1:] != h[:-1]) | (sig[1:] != sig[:-1])
        h, sig = h[new], sig[new]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, dtype=np.int64)
        df = np.diff(np.r_[first, len(h)])
        key = (np.repeat(_order_class(np.maximum(df, 1)), df) << _HASH_BITS) | h
        keep = np.repeat(df, df) >= 2
        return pa.table({"sig": sig[keep], "key": key[keep].view(np.int64)})

    packed = docs.select("text").mapInArrow(pack, "bucket long, sigs binary, entries binary, low6 binary")
    return packed.groupBy("bucket").applyInArrow(shared, "sig long, key long")


def linked(sizes: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """T-occurrence search within one block: a spanning forest of its links as index pairs.

    sizes are whole set sizes, sets the sorted keys that records share with others. With
    side given (0 or 1 per record), only links between the two sides are asked for.
    Records already known to be connected are not tested again.
    """
    order = np.argsort(sizes, kind="stable")
    rank_size = sizes[order]
    flat = np.concatenate([sets[i] for i in order]) if len(order) else np.empty(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(order)), [len(sets[i]) for i in order])
    by_key = np.argsort(flat, kind="stable")
    flat, owner = flat[by_key], owner[by_key]  # lists of ascending records
    part = None if side is None else side[order]
    parent = np.arange(len(order))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for q in range(1, len(order)):
        n, own = int(rank_size[q]), sets[order[q]]
        least = -(-4 * n // 5)  # overlap with the smallest record that can link
        low = int(np.searchsorted(rank_size, least))  # smaller records cannot link
        if low >= q or len(own) < least:
            continue
        begin, end = np.searchsorted(flat, own), np.searchsorted(flat, own, side="right")
        lists = [owner[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        lists = [x[np.searchsorted(x, low):np.searchsorted(x, q)] if len(x) > 1 else x[:0] for x in lists]
        lists = sorted((x for x in lists if len(x)), key=len, reverse=True)
        if len(lists) < least:
            continue
        n_long = min(least - 1, int(least / (PROBE_WEIGHT * np.log2(len(lists[0]) + 1) + 1)))
        count = np.bincount(np.concatenate(lists[n_long:]) - low, minlength=q - low)
        need = -(-4 * (n + rank_size[low:q]) // 9)
        near = np.flatnonzero(count >= np.maximum(1, need - n_long))
        if part is not None:
            near = near[part[near + low] != part[q]]
        if len(near) > 1:  # those connected with this record by an earlier link
            near = np.array([x for x in near.tolist() if root(x + low) != root(q)], dtype=np.int64)
        if not len(near):
            continue
        total = count[near]
        for x in lists[:n_long]:
            place = np.minimum(np.searchsorted(x, near + low), len(x) - 1)
            total = total + (x[place] == near + low)
        for y in (near[total >= need[near]] + low).tolist():
            a, b = root(y), root(q)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(order[y]), int(order[q])))
    return links


def _search_block(key: tuple, group: pa.Table) -> pa.Table:
    sig = group.column("sig").to_numpy()
    sets = [np.asarray(x.values.to_numpy(), dtype=np.int64) for x in group.column("keys").combine_chunks()]
    _, i, j = (x.as_py() for x in key)
    side = None if i == j else (group.column("chunk").to_numpy() == j).astype(np.int8)
    pairs = linked(group.column("n").to_numpy(), sets, side)
    return pa.table({"u": pa.array([sig[a] for a, _ in pairs], pa.int64()),
                     "v": pa.array([sig[b] for _, b in pairs], pa.int64())})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Input columns but text, n_shingles, component_id (the least doc_id of the component) and
    component (the same number for all of a component, null for empty sets)."""
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    names = [c for c in docs.columns if c not in ("text", "n_shingles", "sig", "hot", "component_id", "component")]
    hot, hot_keys = hot_shingles(docs)
    owners = saved(signatures(docs, hot, hot_keys), "jaccard-signatures")
    buckets = max(LEAST_BUCKETS, (owners.agg(F.sum("n_shingles")).first()[0] or 0) // SHINGLES_PER_BUCKET)
    records = (owners.where("n_shingles > 0").groupBy("sig")
               .agg(F.first("n_shingles").alias("n"), F.first("hot").alias("hot"), F.min("doc_id").alias("first_id")))
    shared = (shared_shingles(docs, hot, buckets).groupBy("sig")
              .agg(F.array_sort(F.collect_list("key")).alias("own")))
    # unshared shingles come first in the order, then the own list, then the hot ones
    keys = F.concat(F.coalesce("own", F.array().cast("array<long>")), "hot")
    nodes = saved(records.join(shared, "sig", "left").select(
        "sig", "n", keys.alias("keys"),
        (F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1 - (F.col("n") - F.size(keys))).cast("int").alias("reach"))
        .where("reach > 0"), "jaccard-records")

    prefix = nodes.select("sig", F.explode(F.slice("keys", F.lit(1), F.col("reach"))).alias("key"))
    stars = prefix.groupBy("key").agg(F.min("sig").alias("v"), F.count("*").alias("c")).where("c > 1").drop("c")
    blocks = components(prefix.join(stars, "key").select(F.col("sig").alias("u"), "v"))

    members = nodes.join(blocks.withColumnRenamed("node", "sig"), "sig")
    spread = blocks.join(nodes.select(F.col("sig").alias("node"), F.size("keys").alias("k")), "node") \
        .groupBy("root").agg(F.greatest(
            F.ceil(F.sum("k") / BLOCK_SHINGLES),
            F.least(F.ceil(F.count("*") / BLOCK_RECORDS), F.lit(RECORD_CHUNKS))).cast("int").alias("chunks"))
    dealt = (members.join(spread, "root")
             .withColumn("chunk", F.pmod(F.xxhash64("sig"), F.col("chunks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select("root", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
                     "chunk", "sig", "n", "keys"))
    # dealt anew: without this, the partitioning by root of the joins before would keep all chunks of a block together
    links = dealt.repartition("root", "i", "j").groupBy("root", "i", "j").applyInArrow(_search_block, "u long, v long")
    found = components(links)

    named = records.select("sig", "first_id").join(
        found.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = named.join(ids, "root").select("sig", "component_id", F.col("root").alias("component"))
    some = F.col("n_shingles") > 0
    return owners.join(labels, "sig", "left").select(
        *names, "n_shingles", F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(some, F.col("component")).alias("component"))
