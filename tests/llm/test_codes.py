import hashlib
import math

import numpy as np
import pytest

from martlens.llm import codes
from martlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error) and the books by plain integers; rows: (vec_id, vector)."""
    kept = [(i, [math.floor(4096 * x) for x in v]) for i, v in rows
            if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    books = [[v[p * size:(p + 1) * size] for _, v in first] for p in range(parts)]

    def nearest(book, x):
        d = [sum((a - b) ** 2 for a, b in zip(e, x, strict=True)) for e in book]
        return min(range(len(d)), key=lambda k: (d[k], k)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            mine = [[] for _ in books[p]]
            for _, v in kept:
                x = v[p * size:(p + 1) * size]
                mine[nearest(books[p], x)[0]].append(x)
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e
                        for e, m in zip(books[p], mine, strict=True)]
    out = []
    for i, v in kept:
        found = [nearest(books[p], v[p * size:(p + 1) * size]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found)))
    return out, books


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want, books = brute([(r.vec_id, r.embedding) for r in rows])
    label = {r.vec_id: r.label for r in rows}
    total = {}
    for i, _, e in want:
        total[label[i]] = total.get(label[i], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = sorted(tuple(r) for r in QUERIES["op11_vector_codes"](spark, SF).collect())
    assert got == sorted((i, c, e, total[label[i]], sha) for i, c, e in want)


def test_candidates_hold_all_entries_within_the_radius_and_the_nearest():
    rng = np.random.default_rng(3)
    for k in (1, 5, 16, 70, 130):  # one to three words of masks
        entries = rng.integers(-20, 20, (k, 5))
        entries[k // 2] = entries[0]  # equal entries: ties go to the lower index
        points = rng.integers(-25, 25, (200, 5))
        s = codes.Slices(entries)
        radius = rng.integers(0, 30, 200)
        masks = s.within(points, radius)
        for x in range(200):
            got = {e for e in range(k) if int(masks[e // 64][x]) >> (e % 64) & 1}
            assert got == {e for e in range(k) if np.abs(entries[e] - points[x]).max() <= radius[x]}
        d = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        index, best = s.nearest(points)
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


@pytest.fixture
def cases(spark):
    v = lambda *x: [float(a) for a in x] * 2
    rows = [(5, v(1, 2, 3, 4), 1), (3, v(1, 2, 3, 4), None), (3, v(0, 2, 3, 4), None), (None, v(9, 9, 9, 9), 1),
            (7, None, 1), (8, [1.0, None] * 4, 1), (9, [math.nan] * 8, 1), (10, [math.inf] * 8, 1), (11, [], 1),
            (12, [1.0] * 7, 1), (13, [1.0] * 16, 1), (14, [-0.0001] * 8, 2), (15, [3e38] * 8, 3), (5, v(1, 2, 3, 4), 1)]
    return spark.createDataFrame([(*r, "c", 4) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int")


def test_defined_cases(spark, cases):
    points = codes.integer_vectors(cases).cache()
    books = codes.fit(points, entries=4)
    got = codes.encode(points, books).collect()
    assert sorted(str((r.vec_id, r.label)) for r in got) == sorted(map(str, [
        (5, 1), (3, None), (3, None), (14, 2), (15, 3), (5, 1), (None, 1)]))
    assert all(r.error >= 0 and len(r.code) == 16 for r in got)
    small = [(r.vec_id, r.embedding) for r in cases.collect() if r.vec_id != 15 and r.embedding and len(r.embedding) == 8]
    rest = cases.where("vec_id <> 15 or vec_id is null")
    points = codes.integer_vectors(rest)
    books = codes.fit(points, entries=4)
    want, plain = brute(small, entries=4)
    assert books.entries.tolist() == plain
    assert sorted((str(r.vec_id), r.code, r.error) for r in codes.encode(points, books).collect()) == \
        sorted((str(i), c, e) for i, c, e in want)


def test_decoding_gives_the_entries(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label")
    points = codes.integer_vectors(df)
    books = codes.fit(points, rounds=1)
    back = {r.vec_id: r.vector for r in codes.decode(codes.encode(points, books), books).collect()}
    errors = {r.vec_id: r.error for r in codes.encode(points, books).collect()}
    for r in points.limit(20).collect():
        assert sum((a - 4096 * b) ** 2 for a, b in zip(r.point, back[r.vec_id], strict=True)) == errors[r.vec_id]


def test_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    points = codes.integer_vectors(none)
    assert codes.fit(points) is None and points.count() == 0
