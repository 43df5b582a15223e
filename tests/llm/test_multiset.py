import hashlib

from pyspark.sql import functions as F

from martlens.llm import multiset
from martlens.llm.queries import QUERIES


def _prints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    rows = multiset.fingerprints(df, ["k"]).orderBy("k")
    return rows


def test_order_independent_and_homomorphic(spark):
    a, b, c = "the first paragraph here", "and a second one", "a third one with words"
    rows = _prints(spark, [f"{a}\n{b}\n{c}", f"{c}\n{a}\n{b}", f"{a}\n{b}", c, f"{a}\n{b}\nother words here", ""])
    one = rows.groupBy().pivot("k", list(range(6))).agg(F.first("fingerprint"))
    f = [F.col(str(i)) for i in range(6)]
    got = one.select((f[0] == f[1]).alias("order"), (multiset.insert(f[2], f[3]) == f[0]).alias("insert"),
                     (multiset.delete(f[0], f[3]) == f[2]).alias("delete"), (f[0] == f[4]).alias("other"),
                     (multiset.delete(f[0], f[0]) == f[5]).alias("empty"),
                     multiset.likeness(f[5], f[5]).alias("same"), multiset.likeness(f[0], f[5]).alias("none")).first()
    assert got.asDict() == {"order": True, "insert": True, "delete": True, "other": False, "empty": True,
                            "same": 1.0, "none": 0.0}


def _expected(docs):
    out = []
    for k, (i, x) in enumerate(docs):
        x, y = x or "", docs[(k + 1) % len(docs)][1] or ""
        m = len(x) // 4
        out.append((i, len(x), hashlib.sha256((x[:len(x) - m] + y[:m]).encode()).hexdigest()))
    return out


def test_query_edits_and_likeness(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    rows = sorted(QUERIES["op5_fingerprints"](spark, sf).collect())
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in rows] == _expected(docs)
    prints = {}
    for r, (_, t) in zip(rows, docs, strict=True):
        prints.setdefault(t or "", set()).add(r.fingerprint)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert all(len(x) == 1 for x in prints.values()) and len(set.union(*prints.values())) == len(prints)
    long = [r for r in rows if r.n_chars > 500]
    assert sum(r.near_edited for r in long) / len(long) > 0.65 > 0.3 > sum(r.near_next for r in long) / len(long)


def test_words_repeated_many_times(spark):
    texts = [t for n in (4_000, 40_000, 65_536, 87_000) for t in ("0 " * n, "0 " * (n * 3 // 4) + "1 " * (n // 4))]
    rows = _prints(spark, texts)
    a, b = (rows.where(f"k % 2 = {x}").select(F.expr("k div 2").alias("at"), F.col("fingerprint").alias(f"f{x}")) for x in (0, 1))
    got = a.join(b, "at").select("at", multiset.likeness(F.col("f0"), F.col("f1")).alias("near"), (multiset.insert(
        multiset.delete(F.col("f0"), F.col("f1")), F.col("f1")) == F.col("f0")).alias("back")).orderBy("at").collect()
    assert got[0].near > 0.8 and all(abs(r.near - got[0].near) < 0.01 and r.back for r in got), got


def test_cases(spark, case_docs, cases, no_docs):
    rows = multiset.edit_report(case_docs).select("doc_id", "n_chars", "edited_sha256").collect()
    assert len(rows) == len(cases)
    twice = [tuple(r) for r in rows if r.doc_id == 4]
    assert len(twice) == 2 and twice[0] == twice[1]
    lone = spark.createDataFrame([(5, "12345678")], "doc_id long, text string")
    assert multiset.edit_report(lone).first().edited_sha256 == hashlib.sha256(b"12345612").hexdigest()
    assert multiset.edit_report(no_docs).count() == 0


def test_plan_is_native(case_docs):
    plan = multiset.fingerprints(case_docs, ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
