"""The prefix dictionary and span claiming against brute force."""
import random
import time

from pyspark.sql import functions as F

from martlens.functions.arrays import let
from martlens.plans import entities as E


def test_dictionary_joins_to_the_contained_needles_only(spark, monkeypatch):
    monkeypatch.setattr(E, "POSTINGS", 3)
    r = random.Random(3)
    words = ["nation", "national", "park", "parkway", "burger", "burgers", "veg", "non", "a", "north"]
    values = sorted({" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(80)} | {"x\tpark  north", "Nat"})
    cat = spark.createDataFrame([("d", "t.c", v, False) for v in values] + [("i", "t.i", "ST007", True)],
                                "dimension string, column string, value string, is_identifier boolean")
    texts = [(i, " ".join(r.choice([*words, "par", "nationa", "natio", "ST7", "?"]) for _ in range(12))) for i in range(40)]
    ph = E.phrases(spark.createDataFrame(texts, "text_id long, text string"))
    kt = E.key_table(cat, ())
    assert all(len(x.entries) <= 3 * 3 for x in kt.collect())  # dealt by hash, about POSTINGS in a row
    joined = E.phrase_keys(ph).join(kt, "key").where("tier = 4").select("text_id", "start", "end", "phrase", F.inline("entries"))
    got = sorted((x.text_id, x.start, x.end, x.value) for x in joined.collect())

    def contains(value, needle):
        low = value.lower()
        starts = [0, *(i + 1 for i, c in enumerate(low) if c.isspace())]
        return len(needle) >= 4 and any(low[s:].startswith(needle) and len(low[s:]) >= 4 for s in starts)

    def needle(p):
        p = p.lower()
        return p[:-1] if len(p) > 4 and p.endswith("s") else p

    want = sorted((x.text_id, x.start, x.end, v) for x in ph.collect() for v in values if contains(v, needle(x.phrase)))
    assert len(want) > 300 and got == want  # as many rows as matches, and the same


def greedy(spans):
    out = []
    for n, s, e in sorted({(-n, s, e) for n, s, e in spans}):
        if not any(a <= e and s <= b for _, a, b in out):
            out.append((-n, s, e))
    return sorted((s, e, n) for n, s, e in out)


def claim(spark, rows):
    df = spark.createDataFrame([(i, [(n, s, e, "p", []) for n, s, e in sorted(x, key=lambda y: y[1:])]) for i, x in rows],
                               f"i int, s {E._SPAN}")
    return {r.i: [(x.start, x.end, x.n_tokens) for x in r.k]
            for r in df.select("i", let(F.col("s"), E.claimed).alias("k")).collect()}


def test_claimed_spans_equal_the_greedy_rule(spark):
    r = random.Random(9)
    rows = [(0, [])]
    for i in range(1, 120):
        n = r.choice([3, 12, 60, 400])
        spans = {(k, s, s + k - 1) for _ in range(r.randint(1, n)) for k in [r.randint(1, 4)] for s in [r.randint(0, n)]}
        rows.append((i, sorted(spans)))
    assert claim(spark, rows) == {i: greedy(x) for i, x in rows}


def test_claiming_is_linear_in_a_long_text(spark):
    took = {}
    for tokens in (15_000, 150_000):
        r = random.Random(1)
        spans = sorted({(k, s, s + k - 1) for s in range(tokens) for k in [r.randint(1, 4)] if r.random() < 0.4})
        began = time.time()
        got = claim(spark, [(0, spans)])[0]
        took[tokens] = time.time() - began
        assert len(got) > tokens / 8 and all(a[1] < b[0] for a, b in zip(got, got[1:]))  # disjoint, in order
    assert took[150_000] < 20 * took[15_000] + 5


def _shop(spark, n=300):
    cat = spark.createDataFrame(
        [("sku_id", "t.i", f"SKU{i}", True) for i in range(n)] + [("d", "t.c", v, False) for v in ("North Park", "Burger", "Weekend")],
        "dimension string, column string, value string, is_identifier boolean")
    texts = spark.createDataFrame([(i, f"Compare sku{i} with the burgr in north park, {i} odd words and more") for i in range(200)]
                                  + [(None, None), (7, "SKU7 SKU7")], "text_id long, text string")
    return cat, texts


def test_a_large_dictionary_meets_only_the_phrases_it_may_hold(spark, monkeypatch):
    cat, texts = _shop(spark)
    kt = E.key_table(cat, ()).localCheckpoint()
    keys = E.phrase_keys(E.phrases(texts)).localCheckpoint()
    passed = E.may_be_held(keys, kt).localCheckpoint()
    held = keys.join(kt.select("key").distinct(), "key", "left_semi").select(*keys.columns)
    assert held.count() > 500 and held.exceptAll(passed).count() == 0 and passed.exceptAll(keys).count() == 0
    assert passed.count() - held.count() < 0.1 * keys.count()  # 1 in 32 of the others by chance
    whole = E.resolve(texts, cat, (), fuzzy=True, kt=kt)
    monkeypatch.setattr(E, "BROADCAST_KEYS", 10)
    cut = E.resolve(texts, cat, (), fuzzy=True, kt=kt)
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect())) and whole.where("method = 'fuzzy'").count() > 0


def test_similarity_works_on_distinct_tokens(spark):
    cat, texts = _shop(spark)
    found = E._fuzzy_candidates(E.phrases(texts), cat)
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.tok, r.vl) for r in found.collect()] == [("burgr", "burger")]


def test_phrases_are_compiled(spark):
    _, texts = _shop(spark)
    plan = E.phrase_keys(E.phrases(texts))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_texts_are_cut_once_and_claims_work_on_what_was_found(spark):
    cat, texts = _shop(spark)
    for fuzzy in (False, True):
        found = E.resolve(texts, cat, (), fuzzy=fuzzy, kt=E.key_table(cat, ()))
        assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_phrases_to_look_up_are_all_that_the_dictionary_holds(spark):
    values = ["North Park", "Glass's", "glasss", "Blu\u212ax Y", "abc\u0130def ghi", "abc s", "x0 y", "a & b", "St010s Lane", "\u039f\u03a3 one"]
    cat = spark.createDataFrame([("d", "t.c", v, False) for v in values] + [("i", "t.i", v, True) for v in ("ST007", "st000", "SKU1234567", "AB-1")],
                                "dimension string, column string, value string, is_identifier boolean")
    lines = [*values, *(v.lower() for v in values), *(v.upper() for v in values), "ST7 st0007 ST0 sku1234567 ab-1 st010s st010", "Northe parks, north par north parks",
             "the glass of glas; lane lanes", "", "...", "blu\u212ax y blukx y", "many odd words that name nothing at all here"]
    texts = spark.createDataFrame([*enumerate(lines), (None, "north park"), (3, None)], "text_id long, text string")
    kt = E.key_table(cat, ()).localCheckpoint()
    held = E.phrase_keys(E.phrases(texts)).join(kt.select("key"), "key", "left_semi").select("text_id", "start", "n_tokens", "phrase").distinct()
    looked = E.phrases_to_look_up(texts, kt, fuzzy=False).localCheckpoint()
    assert held.count() > 60 and held.exceptAll(looked).count() == 0
    assert looked.count() < held.count() + 0.2 * E.phrases(texts).count()
    words = E.phrases(texts).where("n_tokens = 1 and length(phrase) >= 5").select("text_id", "start", "n_tokens", "phrase")
    assert words.exceptAll(E.phrases_to_look_up(texts, kt, fuzzy=True)).count() == 0


def test_texts_that_share_an_id_are_resolved_as_one(spark, monkeypatch):
    cat, _ = _shop(spark)
    rows = [(1, "north park burgr"), (1, "north park burgr"), (2, "burgr SKU5"), (2, "sku005 SKU6"), (None, "weekend"), (None, "x North Park"), (3, "zzz")]
    texts = spark.createDataFrame(rows, "text_id long, text string")
    for keys in (100_000, 1):
        monkeypatch.setattr(E, "BROADCAST_KEYS", keys)
        got = E.resolve(texts, cat, (), fuzzy=True).collect()
        assert sorted((r.match_rank, r.value, r.method) for r in got if r.text_id == 1) == [(1, "North Park", "exact"), (2, "Burger", "fuzzy")]
        # token 0 of id 2 is an identifier in one text and a typo in the other: the first tier wins
        assert sorted((r.match_rank, r.value, r.method) for r in got if r.text_id == 2) == [
            (1, "SKU5", "exact"), (2, "SKU6", "exact"), (3, "SKU5", "identifier")]
        assert sorted((r.value, r.method, r.match_rank) for r in got if r.text_id is None) == [("North Park", "exact", 1), ("Weekend", "exact", 2)]


def test_claims_by_bits_equal_the_greedy_rule(spark):
    r = random.Random(5)
    rows = []
    for i in range(200):
        n = r.choice([1, 3, 12, 56])
        rows.append((i, sorted({(k, s, s + k - 1) for _ in range(r.randint(1, n)) for k in [r.randint(1, 4)] for s in [r.randint(0, n)]})))
    df = spark.createDataFrame([(i, [(n, s, e, "p", []) for n, s, e in sorted(x, key=lambda y: (-y[0], y[1]))]) for i, x in rows],
                               f"i int, s {E._SPAN}")
    got = {x.i: sorted((y.start, y.end, y.n_tokens) for y in x.k) for x in df.select("i", E.claimed_by_bits(F.col("s")).alias("k")).collect()}
    assert max(e for _, x in rows for _, _, e in x) < E.MASKED_TOKENS and got == {i: greedy(x) for i, x in rows}
