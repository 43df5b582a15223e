import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from martlens.llm import graph, jaccard
from martlens.llm.queries import QUERIES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall("[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[a:a + 5]) for a in range(len(w) - 4))


def brute(docs):
    """(doc_id, set size, least id of the component) by counting every shared shingle."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders, shared = defaultdict(list), Counter()
    for k, s in enumerate(sets):
        for g in s:
            holders[g].append(k)
    for ks in holders.values():
        for a in ks:
            for b in ks:
                if a < b:
                    shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(docs)), key=str)


def family(rng, n, words, edits):
    base = [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture
def docs(rng):
    texts = [None, "", " \n", "one", "ONE", "two words", "a b c d e", "a b c d e f"]
    for words, edits, n in ((40, 2, 30), (60, 4, 40), (120, 3, 30), (300, 10, 30), (25, 1, 20)):
        texts += family(rng, n, words, edits)
    passage = family(rng, 1, 60, 0)[0]
    texts += [f"{passage} {t}" for t in family(rng, 40, 60, 60)]  # a passage that many share
    texts += [texts[20]] * 30
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    return [*docs, (None, "a b c d e"), (None, "only without id"), (3, "one")]


def rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_components_equal_brute_force(spark, docs):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, sig string").repartition(5)
    assert rows(jaccard.near_duplicates(df)) == brute(docs)


@pytest.mark.parametrize("name, value", [("BLOCK_SHINGLES", 1500), ("BLOCK_RECORDS", 6), ("SHINGLES_PER_BUCKET", 300), ("HOT_SHINGLES", 1), ("HOT_IN_BATCH", 2),
                                         ("PACKED_TEXT", 4000)])
def test_parameters_change_the_work_only(spark, docs, monkeypatch, name, value):
    monkeypatch.setattr(jaccard, name, value)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(jaccard.near_duplicates(df)) == brute(docs)


def test_block_search_finds_every_link():
    r = np.random.default_rng(4)
    for _ in range(30):
        sets = [np.unique(r.choice(40, r.integers(1, 25))).astype(np.int64) for _ in range(25)]
        sizes = np.array([len(s) for s in sets])
        parent = list(range(25))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x
        for a in range(25):
            for b in range(a):
                n = len(np.intersect1d(sets[a], sets[b]))
                if 9 * n >= 4 * (sizes[a] + sizes[b]):
                    parent[find(a)] = find(b)
        got = list(range(25))

        def find2(x, got=got):
            while got[x] != x:
                x = got[x]
            return x
        for a, b in jaccard.linked(sizes, sets):
            got[find2(a)] = find2(b)
        assert {(a, b) for a in range(25) for b in range(25) if find(a) == find(b)} == \
            {(a, b) for a in range(25) for b in range(25) if find2(a) == find2(b)}


def test_graph_components(spark, rng):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (300, 200)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 300: 200}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_table_and_query(spark, no_docs):
    assert jaccard.near_duplicates(no_docs).count() == 0
    sf = "/root/testdata/sf0.001"
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(QUERIES["op8_jaccard_join"](spark, sf)) == brute(table)
