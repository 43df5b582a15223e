import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from martlens.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                  "card": 12 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


HARD = [
    "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.1", "4111 1111-1111 1111 +1 (234) 555-0000. x",
    "é€😀 a.b@c.d 😀 +49 30 1234567", "a" * 30000 + "@" + "b." * 9000 + "c", "1" * 30000, "1-" * 20000 + "1",
    " ".join(["a@b.cd"] * 2000), "@@..++", "x@y.z@w.v", "+1 +2 +3 456 789 012", None, "",
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(HARD)], "doc_id long, text string, pii string")
    return pii.find_pii(df)


def test_base_spans_equal_plain_patterns(found):
    for r in found.withColumn("spans", pii.joined(pii.of_kinds(F.col("pii"), *pii.BASE_KINDS))).collect():
        assert r.spans == base_spans(HARD[r.doc_id]), r.doc_id


def test_random_strings(spark, rng):
    texts = ["".join(rng.choice("ab1 2.3@-+()4_%é\n5") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(df).select("doc_id", pii.joined(pii.of_kinds(F.col("pii"), *pii.BASE_KINDS)).alias("s")).collect():
        assert r.s == base_spans(texts[r.doc_id]), texts[r.doc_id]


def test_checksums_and_context(spark):
    texts = ["DE89 3704 0044 0532 0130 00 AND", "DE89 3704 0044 0532 0130 01 AND", 'token = "04dbebab91ab85687d33eeaaf9"',
             "hash 04dbebab91ab85687d33eeaaf9", "tel 555-123-4567", "sum 555-123-4567", "SSN: 123-45-6789", "123-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = [[s.kind for s in r.pii if s.kind not in pii.BASE_KINDS] for r in pii.find_pii(df).orderBy("doc_id").collect()]
    assert kinds == [["iban"], [], ["secret"], [], ["national"], [], ["ssn"], []]


def test_account_numbers_before_words_and_long_secrets(spark):
    es, de, no = "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"
    key = "04dbebab91ab85687d33eeaaf9" * 200
    texts = [("IBAN ES9121000418450200051332 BIC: CAIXESBB", ["ES9121000418450200051332"]), (f"{es} EUR 500", [es]),
             (f"{es} {de} {no} ABCD", [es, de, no]), (f"É AB12 {es} REF1 XY, {no}", [es, no]), (f"{es}0 {de}x", []),
             (f"{es[:-1]}3 EUR 500", []), (f"{es} 1332 AND MORE WORDS", [es]),
             *((f"token={key[:n]} x", [key[:n]]) for n in (128, 129, 200, 5000)), (f"hash {key[:200]}", [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        text, want = texts[r.doc_id]
        spans = [s for s in r.pii if s.kind in ("iban", "secret")]
        assert [s.value for s in spans] == want and [text[s.start:s.end] for s in spans] == want, text
    clean = [r.text for r in pii.redact(pii.find_pii(df)).orderBy("doc_id").collect()]
    assert clean[1] == "[IBAN] EUR 500" and clean[2] == "[IBAN] [IBAN] [IBAN] ABCD" and clean[8] == "token=[SECRET] x"


def test_redaction(spark, found):
    texts = [r.text for r in pii.redact(found).orderBy("doc_id").collect()]
    assert texts[0] == "[EMAIL][EMAIL] x@y" and texts[3] == "é€😀 [EMAIL] 😀 [PHONE]"
    assert texts[7] == " ".join(["[EMAIL]"] * 2000) and texts[-2:] == [None, ""]


def test_query_and_empty_table(spark, no_docs):
    from martlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op3_pii"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(f"{k}:") for k in PATTERNS]
    assert pii.find_pii(no_docs).count() == 0 and pii.redact(pii.find_pii(no_docs)).count() == 0


def test_plan_is_native(found):
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def redacted(text, spans):
    """Overlapping spans joined under the first kind, each replaced by it."""
    out, at, cut = [], 0, []
    for s, e, k in spans:  # by start, then kind as listed
        if cut and cut[-1][1] > s:
            cut[-1][1] = max(cut[-1][1], e)
        else:
            cut.append([s, e, k])
    for s, e, k in cut:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def test_long_texts_with_many_matches_of_each_kind(spark):
    each = {"email": "a{0}@b.cd", "ip": "10.0.{0}.7", "card": "4111 1111 1111 1111", "phone": "+49 30 123456{0}",
            "secret": "token=abcdEFGH0123456789{0}", "national": "call 555-123-{0:04d}", "ssn": "ssn 123-45-{0:04d}", "none": "12 34"}
    took = {}
    for n in (4_000, 40_000):
        texts = [" é ".join(p.format(i % 250 + 1) for i in range(n)) for p in each.values()]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
        began = time.time()
        rows = pii.find_pii(df).select("doc_id", pii.joined(pii.of_kinds(F.col("pii"), *pii.BASE_KINDS)).alias("s"), F.size("pii").alias("n")).collect()
        clean = pii.redact(pii.find_pii(df)).collect()
        took[n] = time.time() - began
        for r in rows:
            assert r.s == base_spans(texts[r.doc_id]), list(each)[r.doc_id]
            assert r.n >= (n if r.doc_id < 7 else 0), list(each)[r.doc_id]
        assert [c for c in clean if base_spans(c.text)] == []
    assert took[40_000] < 20 * took[4_000] + 5  # work in proportion to the text; per pair of matches it would be a hundredfold


def test_redaction_equals_plain_cutting(spark, rng):
    texts = ["".join(rng.choice(["4111111111111111", "+1 234 567 890", "a@b.cd", "1.2.3.4", " ", "é😀", "x ", "-", "+", "."])
                     for _ in range(rng.choice([0, 3, 30, 400]))) for _ in range(300)]
    found = pii.find_pii(spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "doc_id long, text string, plain string")).cache()
    spans = {r.doc_id: [(x.start, x.end, x.kind) for x in r.pii] for r in found.collect()}
    assert max(map(len, spans.values())) > 50
    for r in pii.redact(found).collect():
        assert r.text == redacted(r.plain, spans[r.doc_id])


def test_context_far_into_a_text(spark):
    texts = ["x" * n + " call 555-123-4567 " + "y" * 10 for n in (0, 900, 1000, 1017, 1018, 1019, 1023, 1024, 1030, 5000)]
    texts += ["call " + "z" * 50 + " 555-123-4567", " call" + " " * 34 + "555-123-4567", " call" + " " * 40 + "555-123-4567"]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [len(r.pii) for r in rows] == [1] * 10 + [0, 1, 0]
