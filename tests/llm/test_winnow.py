import hashlib
import re

import numpy as np

from martlens.llm import winnow

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows.setdefault(n, {}).setdefault(tuple(w[a:a + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for n, known in windows.items():
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in known:
                    ids |= known[tuple(w[a:a + n])]
                    hit |= set(range(a, a + n))
        out.append((i, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def spark_rows(docs, items):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in winnow.contamination(docs, items).collect()), key=str)


def test_random_texts_equal_brute_force(spark, rng):
    vocabulary = ["a", "b", "Ca", "d9", "é"]
    for few in (2, 3, 4):
        def text(sizes):
            return rng.choice([" ", ". ", "-"]).join(rng.choice(vocabulary[:few]) for _ in range(rng.choice(sizes)))
        docs = [(i, text([0, 1, 3, 9, 10, 11, 30, 200])) for i in range(60)] + [(1, None), (None, text([50]))]
        items = [(i, text([0, 2, 5, 8, 9, 10, 11, 12, 25])) for i in range(12)] + [(3, "a b a"), (50, None)]
        assert spark_rows(spark.createDataFrame(docs, "doc_id long, text string"),
                          spark.createDataFrame(items, "item_id long, text string")) == brute(docs, items)


def test_empty_sides(spark, no_docs, case_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r[2] == 0 for r in spark_rows(case_docs, none))
    assert winnow.contamination(no_docs, spark.createDataFrame([(1, "x")], "item_id long, text string")).count() == 0


def test_every_window_has_a_fingerprint():
    from martlens.llm.textkit import ALNUM, Words

    r = np.random.default_rng(2)
    text = " ".join(r.choice(["x", "y", "z"], 300)).encode()
    w = Words(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), ALNUM)
    chosen = winnow._chosen(w)
    for a in range(300 - winnow.WINDOW + 1):
        assert ((chosen >= a) & (chosen + winnow.K <= a + winnow.WINDOW)).any()


def test_query(spark):
    from martlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                  for r in QUERIES["op4_decontamination"](spark, sf).collect()), key=str)
    assert got == sorted(((i, n, h, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), h > 0)
                          for i, n, h, ids in brute(docs, items)), key=str)


def test_clashing_columns_are_replaced_and_long_texts_with_many_hits(spark):
    long = " ".join(f"w{i % 40}" for i in range(120_000))
    docs = [(1, "a b c d e f g h i j k", "x", 5, 6, 7), (2, long, "y", 5, 6, 7), (3, None, "z", 5, 6, 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, items string, n_words int, hits int, n_hit int") \
        .selectExpr("*", "1 as n_items", "'s' as spans", "3 as _row", "9 as other")
    items = spark.createDataFrame([(7, "b c d e f g h i j k"), (8, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")
    got = {r.doc_id: r for r in winnow.contamination(df, items).collect()}
    assert {i: (r.n_words, r.n_hit, r["items"], r.other) for i, r in got.items()} == {
        1: (11, 10, ["7"], 9), 2: (120_000, 36_000, ["8"], 9), 3: (0, 0, [], 9)}
