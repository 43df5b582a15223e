import itertools
import math
import re
import zlib
from collections import Counter
from datetime import date

import numpy as np
import pytest

from martlens.llm import hmm, urls
from martlens.llm.queries import QUERIES, SQL

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_url_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    want = con.sql(SQL["op9_url_filter"]).fetchall()
    names = [d[0] for d in con.sql(SQL["op9_url_filter"]).description]
    got = [tuple(r[n] for n in names) for r in QUERIES["op9_url_filter"](spark, sf).collect()]
    plain = lambda rows: sorted((tuple(str(x)[:40] for x in r) for r in rows))
    assert plain(got) == plain(want) and len({r[3] for r in got}) == 3


def test_url_list_in_time(spark, no_docs):
    entries = [("bad.org", "block", "add", date(2024, 1, 10)), ("bad.org", "block", "remove", date(2024, 2, 1)),
               ("bad.org", "block", "add", date(2024, 3, 1)), ("bad.org/ok", "allow", "add", date(2024, 1, 1)),
               ("x.bad.org", "allow", "add", date(2024, 3, 5)), ("same.net", "block", "add", date(2024, 1, 1)),
               ("same.net", "allow", "add", date(2024, 1, 1)), (None, "block", "add", date(2024, 1, 1)),
               ("nodate.org", "block", "add", None), ("bad.org", "block", "add", date(2024, 1, 10)),
               ("zero.org", "block", "add", date(2024, 1, 3)), ("zero.org", "block", "remove", date(2024, 1, 3))]
    listed = spark.createDataFrame(entries, "key string, verdict string, action string, at date")
    asked = [("http://bad.org/a", date(2024, 1, 9), "unlisted"), ("http://bad.org/a", date(2024, 1, 10), "block"),
             ("http://WWW.Bad.org.:80/a?q#f", date(2024, 1, 31), "block"), ("http://bad.org/a", date(2024, 2, 1), "unlisted"),
             ("//u:p@bad.org", date(2024, 3, 1), "block"), ("http://bad.org//ok/x", date(2024, 3, 2), "allow"),
             ("http://bad.org/okay", date(2024, 3, 2), "block"), ("http://a.x.bad.org/", date(2024, 3, 6), "allow"),
             ("http://notbad.org/", date(2024, 3, 6), "unlisted"), ("http://same.net", date(2024, 1, 2), "allow"),
             (None, date(2024, 1, 2), "unlisted"), ("", date(2024, 1, 2), "unlisted"), ("nonsense", None, "unlisted"),
             ("http://bad.org/a", None, "unlisted"), ("http://nodate.org", date(2024, 1, 2), "unlisted"),
             ("http://zero.org", date(2024, 1, 3), "block"), ("http://bad.org/a", date(2024, 1, 10), "block")]
    df = spark.createDataFrame([(i, u, t, "z") for i, (u, t, _) in enumerate(asked)],
                               "page_id long, url string, fetched_at date, verdict string")
    got = urls.judge(df, listed)
    assert [r.verdict for r in got.orderBy("page_id").collect()] == [v for _, _, v in asked]
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    empty = listed.limit(0)
    assert {r.verdict for r in urls.judge(df, empty).collect()} == {"unlisted"}
    assert urls.judge(df.limit(0), listed).count() == 0


def test_one_label_hosts_and_top_level_labels(spark, tmp_path):
    import duckdb

    day = date(2024, 1, 2)
    listed = spark.createDataFrame([(k, "block", "add", day) for k in ("localhost", "zip")]
                                   + [("intranet/wiki", "allow", "add", day), ("good.zip", "allow", "add", day)],
                                   "key string, verdict string, action string, at date")
    asked = [("http://localhost:80/a", "block"), ("http://x.localhost", "block"), ("http://notlocalhost/", "unlisted"),
             ("http://a.b.ZIP/x", "block"), ("http://zip.org/", "unlisted"), ("http://zip", "block"),
             ("http://intranet/wiki/x", "allow"), ("http://intranet/", "unlisted"), ("http://www.good.zip", "allow")]
    df = spark.createDataFrame([(i, u, day) for i, (u, _) in enumerate(asked)], "page_id long, url string, fetched_at date")
    assert [r.verdict for r in urls.judge(df, listed).orderBy("page_id").collect()] == [v for _, v in asked]
    # one-label hosts of the derived list, as its SQL has them
    pages = [(7 * k + j, u) for k in range(40) for j, u in enumerate((
        f"http://host{k}/a/b", f"http://www.host{k}/", f"http://site.tld{k}/x", f"http://tld{k}"))]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(SQL["op9_url_filter"])
    names, want = [d[0] for d in want.description], want.fetchall()
    got = [tuple(r[n] for n in names) for r in QUERIES["op9_url_filter"](spark, str(tmp_path)).collect()]
    plain = lambda rows: sorted((tuple(str(x)[:40] for x in r) for r in rows))
    assert plain(got) == plain(want) and "block" in {r[3] for r in got}


def test_paths_keep_their_case_and_addresses_are_one_level(spark, tmp_path):
    import duckdb

    day = date(2024, 1, 2)
    listed = spark.createDataFrame([("Bad.org/AbC1", "block", "add", day), ("BAD.net", "block", "add", day), ("0.1", "block", "add", day),
                                    ("10.0.0.1", "block", "add", day), ("10.0.0.1/ok", "allow", "add", day)],
                                   "key string, verdict string, action string, at date")
    asked = [("http://bad.org/AbC1/x", "block"), ("http://BAD.ORG/AbC1", "block"), ("http://bad.org/abc1", "unlisted"),
             ("http://x.bad.net/", "block"), ("http://10.0.0.1/", "block"), ("http://10.0.0.1/ok/z", "allow"),
             ("http://9.9.0.1/", "unlisted"), ("http://a.0.1/", "block"), ("http://x/" + "a/" * 3000, "unlisted")]
    df = spark.createDataFrame([(i, u, day, "p", 1) for i, (u, _) in enumerate(asked)],
                               "page_id long, url string, fetched_at date, _path string, _at int")
    assert [r.verdict for r in urls.judge(df, listed).orderBy("page_id").collect()] == [v for _, v in asked]
    # the derived list over paths that differ in case, as its SQL has them
    pages = [(13 * k + j, f"http://Host{k % 9}.org/{p}/x") for k in range(100) for j, p in enumerate((f"AbC{k}", f"abc{k}", f"ABC{k}"))]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(SQL["op9_url_filter"])
    names, want = [d[0] for d in want.description], want.fetchall()
    got = [tuple(r[n] for n in names) for r in QUERIES["op9_url_filter"](spark, str(tmp_path)).collect()]
    plain = lambda rows: sorted((tuple(str(x)[:40] for x in r) for r in rows))
    assert plain(got) == plain(want)


def test_many_dated_entries_of_one_key(spark, rng):
    days = [date.fromordinal(738_000 + d) for d in range(400)]
    entries = [(k, v, rng.choice(["add", "remove"]), rng.choice(days)) for k in ("a.org", "a.org/p", "org") for v in ("block", "allow")
               for _ in range(150)]
    asked = [(i, rng.choice(["http://a.org/p/q", "http://a.org/", "http://b.org"]), rng.choice(days)) for i in range(500)]
    got = urls.judge(spark.createDataFrame(asked, "page_id long, url string, fetched_at date"),
                     spark.createDataFrame(entries, "key string, verdict string, action string, at date")).collect()
    last = {}
    for k, v, a, d in sorted(set(entries), key=lambda e: (e[3], e[2] == "add")):
        last.setdefault((k, v), []).append((d, a))
    for r in got:
        keys = {"http://a.org/p/q": ["org", "a.org", "a.org/p"], "http://a.org/": ["org", "a.org"], "http://b.org": ["org"]}[r.url]
        active = []
        for depth, k in enumerate(keys):
            for v in ("block", "allow"):
                before = [(d, a) for d, a in last[k, v] if d <= r.fetched_at]
                if before and before[-1][1] == "add":
                    active.append((depth, v == "allow", before[-1][0], k, v))
        want = max(active, default=(None, None, None, None, "unlisted"))
        assert (r.verdict, r.listed_key, r.listed_from, r.n_active) == (want[4], want[3], want[2], len(active))


def tokens(t):
    return [*re.findall("[^\x20\x09-\x0D]+", (t or "").translate(LOW)), None]


def base_rows(docs):
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    count = Counter(w for i, t in docs if fold(i) for w in tokens(t))
    n = sum(count.values())
    whole = math.log10(n + 0.1 * (len(count) + 1))
    return [(i, fold(i) == 0, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n,
             sum(math.log10(count[w] + 0.1) - whole for w in tokens(t))) for i, t in docs]


@pytest.mark.parametrize("hot", [1 << 18, 50])
def test_base_scores_and_gain(spark, monkeypatch, hot):
    monkeypatch.setattr(hmm, "HOT_WORDS", hot)
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = sorted(QUERIES["op10_hmm_scoring"](spark, sf).collect())
    for r, want in zip(rows, sorted(base_rows(docs)), strict=True):
        assert tuple(r)[:5] == want[:5] and math.isclose(r.base_score, want[5], rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_hmm_cases(spark, case_docs, cases, no_docs):
    rows = sorted(hmm.language_model(case_docs).collect(), key=str)
    for r, want in zip(rows, sorted(base_rows(cases), key=str), strict=True):
        assert tuple(r)[:5] == want[:5] and math.isclose(r.base_score, want[5], rel_tol=1e-9)
        assert r.score < 0
    assert hmm.language_model(no_docs).count() == 0
    untrained = hmm.language_model(case_docs.where("doc_id is null")).collect()  # all in the held-out fold
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in untrained)


N_CLASSES = 8192


def _small_model():
    r = np.random.default_rng(3)
    emit = r.uniform(0.1, 1, (2, N_CLASSES + 1))
    move, start = r.uniform(0.1, 1, (2, 2)), r.uniform(0.1, 1, 2)
    return hmm.Model(start / start.sum(), np.array([0.5, 0.5]), move / move.sum(axis=1, keepdims=True),
                     emit / emit.sum(axis=1, keepdims=True))


def _paths(model, seq):
    for path in itertools.product(range(2), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[path[0], seq[0]]
        for a, b, x in zip(path, path[1:], seq[1:], strict=False):
            p *= model.move[a, b] * model.emit[b, x]
        yield path, p


def test_forward_is_exact():
    model = _small_model()
    seqs = [[1, 2, 3, 2], [5], [7, 7, 8192], [0, 4095, 4096, 8191, 1]]
    got = hmm.log_likelihoods(model, [np.array(s, dtype="<u4").tobytes() for s in seqs])
    assert np.allclose(got, [math.log10(sum(p for _, p in _paths(model, s))) for s in seqs])


def test_forward_backward_counts_equal_enumeration():
    model, seqs = _small_model(), [[1, 2, 1, 3], [2, 2], [9]]
    (classes, length, begins), = hmm._segments([np.array(s, dtype="<u4").tobytes() for s in seqs])
    log, first, moves, emits = hmm.expected_counts(model, classes, length, begins)
    want_first, want_moves, want_emits, want_log = np.zeros(2), np.zeros((2, 2)), np.zeros((N_CLASSES + 1, 2)), 0.0
    for s in seqs:
        total = sum(p for _, p in _paths(model, s))
        want_log += math.log10(total)
        for path, p in _paths(model, s):
            want_first[path[0]] += p / total
            for a, b in zip(path, path[1:], strict=False):
                want_moves[a, b] += p / total
            for a, x in zip(path, s, strict=True):
                want_emits[x, a] += p / total
    assert math.isclose(log, want_log) and np.allclose(first, want_first)
    assert np.allclose(moves, want_moves) and np.allclose(emits, want_emits)


def test_long_texts_are_cut_for_training_only():
    seq = np.arange(1000, dtype="<u4").tobytes()
    parts = list(hmm._segments([seq, seq[:40]]))
    assert sum(int(x[1].sum()) for x in parts) == 1010 and sum(int(x[2].sum()) for x in parts) == 2
