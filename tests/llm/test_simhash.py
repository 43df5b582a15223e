import random
import re

import numpy as np
import pytest
import xxhash

from martlens.llm import simhash
from martlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bits_of(text):
    w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    """Sorted (doc_id, fingerprint, component) of (doc_id, fingerprint) rows."""
    prints = sorted({f for _, f in rows})
    f = np.array(prints, dtype=np.uint64)
    parent = list(range(len(f)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(f)):
        for b in np.flatnonzero(np.bitwise_count(f[a + 1:] ^ f[a]) <= 2) + a + 1:
            parent[find(a)] = find(int(b))
    at = {p: find(k) for k, p in enumerate(prints)}
    least = {}
    for i, p in rows:
        if i is not None:
            least[at[p]] = min(least.get(at[p], i), i)
    return sorted(((i, p, least.get(at[p])) for i, p in rows), key=str)


def test_query_equals_brute_force(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        docs = [(r.doc_id, bits_of(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in QUERIES["op12_simhash_dedup"](spark, sf).collect()]
        assert sorted(got, key=str) == brute(docs)


def test_fingerprints_and_defined_cases(spark, case_docs, cases):
    got = simhash.near_duplicates(case_docs.withColumnRenamed("n_tokens", "component_id")).collect()
    rows = sorted(((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in got), key=str)
    assert rows == brute([(i, bits_of(t)) for i, t in cases])
    assert all(r.score == 7 for r in got)
    assert bits_of(None) == simhash.fingerprint(b" \t\n") == 0
    long = " ".join(random.Random(5).choice("abcdefgh") for _ in range(100_000))
    assert simhash.fingerprint(long.encode()) == bits_of(long)


def test_empty_table(spark, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def prints(rng):
    """Fingerprints: spread ones, families around a few, chains, a dense family, and copies in one part."""
    out = [rng.getrandbits(64) for _ in range(1500)]
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(8):
            out.append(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    x = rng.getrandbits(64)
    for _ in range(60):  # a chain in steps of two bits
        x ^= sum(1 << b for b in rng.sample(range(64), 2))
        out.append(x)
    dense = rng.getrandbits(64)
    for _ in range(1200):  # more than the limit in every partition
        out.append(dense ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    part = rng.getrandbits(32)
    out += [part << 32 | rng.getrandbits(32) for _ in range(600)]  # one frequent value in half of the bits
    return [*out, 0, 0, *out[:50]]


@pytest.mark.parametrize("partitions", [None, 1, 2, 3, 5, 8])
def test_links_of_made_fingerprints(spark, rng, partitions, monkeypatch):
    rows = list(enumerate(prints(rng)))
    df = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in rows], "doc_id long, fingerprint long").repartition(4)
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: df)
    got = simhash.near_duplicates(df.withColumn("text", df.doc_id.cast("string")), partitions=partitions).collect()
    assert sorted(((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in got), key=str) == brute(rows)


def test_thresholds_sum_up_and_dense_families_meet_halfway(spark, rng):
    f = sorted({int(np.uint64(x).view(np.int64)) for x in prints(rng)})
    records = spark.createDataFrame([(x,) for x in f], "fingerprint long")
    plan = simhash.plan(records, len(f), partitions=3)
    assert sorted(b for g in plan.groups for b in g) == list(range(64))
    work, taken = plan.thresholds(np.array(f, dtype=np.int64).view(np.uint64))
    assert (taken.sum(axis=0) == simhash.DISTANCE + 1).all()
    assert (taken[:, work <= plan.most].std(axis=0) > 0).any()  # unequal thresholds where a value is frequent
    rows = simhash._rows_of(records, plan).groupBy("kind").count().collect()
    n = {r.kind: r["count"] for r in rows}
    dense = int((work > plan.most).sum())
    assert dense >= 100 and n[2] == 65 * dense
    assert n[1] <= plan.most * (len(f) - dense)


def test_more_partitions_for_fewer_records():
    numbers = [simhash.how_many_partitions(n) for n in (10 ** 3, 10 ** 5, 10 ** 7, 10 ** 10)]
    assert numbers == sorted(numbers, reverse=True) and numbers[-1] == 2
