import hashlib
import math
import re
import zlib

import numpy as np

from martlens.llm import resample
from martlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall((text or "").translate(LOW))
    return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, items):
    """Sorted (doc_id, n_features, weight, score, rank)."""
    s, t = np.zeros(10000, dtype=np.int64), np.zeros(10000, dtype=np.int64)
    found = [(i, *features(x)) for i, x in docs]
    for _, _, f in found:
        np.add.at(s, f, 1)
    for x in items:
        np.add.at(t, features(x)[1], 1)
    total_s, total_t = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((int(b) + 1) * (total_s + 10000) / ((int(a) + 1) * (total_t + 10000))))
            for a, b in zip(s, t, strict=True)]
    out = []
    for i, n, f in found:
        w = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_importance_resampling"](spark, SF).collect()), key=str)
    assert got == brute(docs, items)
    assert sum(r[4] is not None for r in got) > 20


def test_runs_across_newlines_and_defined_cases(spark, cases):
    odd = ["a\nb\nc", "\n\na b\n\n\nc\nd e f\n", "a b c\r\nd", "one line\none line\none line\nan other", "x\n" * 40,
           "Ünder É中文\nword", "--\n..\nword", "a b\n" * 3000, "w " * 60 + "\n" + "w " * 60]
    rows = [*cases, *((100 + i, t) for i, t in enumerate(odd)), *((200 + i, "the same line of words here\nand more " + str(i % 7))
                                                                 for i in range(60)), (201, None)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, weight string, rank int").repartition(3)
    items = ["the same line of words", None, "", "one line"]
    target = spark.createDataFrame([(t,) for t in items], "text string")
    got = resample.resample(df, target).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=str) == brute(rows, items)
    lines = resample.distinct_lines(df)
    assert lines.count() == lines.select("key").distinct().count()
    assert lines.agg({"n": "max"}).first()[0] == 3000


def test_ties_draw_the_smaller_id_and_many_lines_are_broadcast(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text)] * 45 + [(None, text)] * 5
    got = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"),
                            spark.createDataFrame([], "text string")).collect()
    drawn = [r for r in got if r["rank"] is not None]
    assert sorted(r["rank"] for r in drawn) == [1, 2] and len(got) == 50
    assert all(r.score == max(x.score for x in got) for r in drawn)


def test_empty_tables(spark, no_docs):
    assert resample.resample(no_docs, spark.createDataFrame([], "text string")).count() == 0
