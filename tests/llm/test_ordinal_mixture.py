import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from martlens.llm import mixture, ordinal
from martlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_grades(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    grades = spark.read.parquet(f"{SF}/labels.parquet").select(
        "doc_id", ordinal.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    fitted = ordinal.fit(ordinal.sample(docs, grades.where("doc_id % 4 <> 1")))
    assert fitted.usable and (np.diff(fitted.thresholds) > 0).all()
    scored = ordinal.grade_texts(docs.select("doc_id", "text"), fitted).drop("grade").join(
        grades.where("doc_id % 4 = 1"), "doc_id").toPandas()
    kept = scored.groupby("grade").keep.mean()
    assert kept[0] < 0.05 and kept[1] < 0.3 and kept[2] > 0.97
    means = scored.groupby("grade").expected_grade.mean()
    assert means[0] < means[1] < means[2]
    assert (scored.p_1 >= scored.p_2).all() and np.allclose(scored.expected_grade, scored.p_1 + scored.p_2)


def test_ordinal_gradient_recovers_thresholds(spark):
    texts = [(i, " ".join(["bad"] * (i % 3 == 0) + ["good"] * (i % 3 == 2) + ["word"])) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    fitted = ordinal.fit(ordinal.sample(docs, spark.createDataFrame([(i, i % 3) for i in range(300)], "doc_id long, grade int")))
    assert [r.grade for r in ordinal.grade_texts(docs, fitted).orderBy("doc_id").limit(6).collect()] == [0, 1, 2] * 2


def test_long_texts_are_graded_like_their_parts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    grades = spark.read.parquet(f"{SF}/labels.parquet").select(
        "doc_id", ordinal.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    fitted = ordinal.fit(ordinal.sample(docs, grades.where("doc_id % 4 <> 1")))
    held = docs.join(grades.where("doc_id % 4 = 1"), "doc_id").orderBy("doc_id").select("grade", "text").toPandas()
    rows = []
    for size in (100_000, 400_000, 1_000_000, 5_000_000):
        for grade in range(3):
            pool, text, n = held.text[held.grade == grade].tolist(), [], 0
            while n < size:
                text.append(pool[len(text) % len(pool)])
                n += len(text[-1])
            rows.append((grade, size, "\n".join(text)))
    long = spark.createDataFrame(rows, "want int, size int, text string")
    got = ordinal.grade_texts(long, fitted).select("want", "size", "keep").collect()
    assert len(got) == 12 and all(r.keep == (r.want == 2) for r in got), got


def test_ordinal_cases(spark, case_docs, cases, no_docs):
    none = ordinal.fit(ordinal.sample(case_docs, spark.createDataFrame([], "doc_id long, grade int")))
    out = ordinal.grade_texts(case_docs, none)
    assert out.count() == len(cases) and all(r.keep for r in out.collect())
    one = spark.createDataFrame([(4, 2), (5, 2), (None, 1), (3, None)], "doc_id long, grade int")
    assert not ordinal.fit(ordinal.sample(case_docs, one)).usable
    assert ordinal.grade_texts(no_docs, none).count() == 0
    assert ordinal.sample(case_docs, one, bound=1).count() <= 2  # a repeated row of one labelled id


def test_ordinal_query_columns(spark):
    rows = QUERIES["op6_quality_classifier"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert set(rows[0].asDict()) == {"doc_id", "expected_grade", "p_1", "p_2", "grade", "keep"}


def test_gradient_equals_differences_and_spark_sums_it(spark, rng):
    r = np.random.default_rng(4)
    n, k = 40, 6
    grade = r.integers(0, 3, n)
    row = np.repeat(np.arange(n), 3)
    col, value = r.integers(0, k, 3 * n), r.uniform(0.1, 2, 3 * n).astype(np.float32)
    at = np.r_[-0.3, 0.2, r.normal(size=k)]
    loss = lambda x: ordinal.partial_loss(grade, row, col, value, x[2:], x[:2])
    for i in range(len(at)):
        step = 1e-6 * np.eye(len(at))[i]
        assert abs((loss(at + step)[0] - loss(at - step)[0]) / 2e-6 - loss(at)[1 + i]) < 1e-4
    rows = [(int(g), col[3 * i:3 * i + 3].astype("<i4").tobytes(), value[3 * i:3 * i + 3].tobytes()) for i, g in enumerate(grade)]
    matrix = spark.createDataFrame(rows, "grade int, columns binary, vals binary").repartition(3)
    value_, slope = ordinal._loss(matrix, n, at)
    want = loss(at) / n
    want[3:] += ordinal.DECAY * at[2:]
    assert abs(value_ - want[0] - ordinal.DECAY / 2 * at[2:] @ at[2:]) < 1e-6 and np.allclose(slope, want[1:], atol=1e-6)
    best = ordinal._minimum(lambda x: ordinal._loss(matrix, n, x), at)
    _, left = ordinal._loss(matrix, n, best)
    assert np.abs(left).max() < 0.02  # a stationary point


def test_query_equals_a_plain_fit_and_plain_scores(spark):
    """op6 against its own definition: screened words, a plain fit to convergence, plain scores."""
    texts = [(i, " ".join(["bad", "awful"] * (i % 3 == 0) + ["fine"] * (i % 3 == 2) + ["word"] * (1 + i % 4))) for i in range(240)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    fitted = ordinal.fit(ordinal.sample(docs, spark.createDataFrame([(i, i % 3) for i in range(240)], "doc_id long, grade int")))
    for r in ordinal.grade_texts(docs, fitted).collect():
        batch = pa.RecordBatch.from_arrays([pa.array([r.text])], names=["text"])
        (_, _, _, feature, value), = ordinal._features(batch, "text")
        weight = dict(zip(fitted.features.tolist(), fitted.weights.tolist(), strict=True))
        level = sum(v * weight.get(f, 0.0) for f, v in zip(feature.tolist(), value.tolist(), strict=True))
        tails = [1 / (1 + np.exp(t - level)) for t in fitted.thresholds]
        assert np.allclose([r.p_1, r.p_2, r.expected_grade], [*tails, sum(tails)], atol=1e-5)
        assert r.grade == r.doc_id % 3 and r.keep == (tails[1] >= ordinal.KEEP_TOP)


def test_held_out_languages(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op7_language_mixture"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and 0.3 < len(held) / len(rows) < 0.37
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.995
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixture_of_two_languages_and_cases(spark, no_docs):
    train = [("the cat and the dog are here with them", "en"), ("der hund und die katze sind nicht hier", "de"),
             ("le chien et la chatte ne sont pas avec nous", "fr"), ("nobody", None), (None, "en")] * 20
    names, table = mixture.train(spark.createDataFrame(train, "text string, lang string"))
    assert names == ["de", "en", "fr"]
    texts = ["the dog and the cat", "die katze und der hund", " ".join(["the dog and the cat are here"] * 9
             + ["der hund und die katze sind nicht"] * 5), None, "", "123 !!", "the dog", "the dog"]
    df = spark.createDataFrame([(i, t, "zz") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    rows = mixture.identify(df, names, table).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows] == ["en", "de", "en", "und", "und", "und", "en", "en"]
    assert rows[2].languages == ["en", "de"] and 0.5 < rows[2].score < 0.8 and rows[0].languages == ["en"]
    assert rows[3].score == 0 and rows[3].languages == []
    none = mixture.identify(df, *mixture.train(no_docs)).collect()
    assert all(r.lang_pred == "und" for r in none)
    assert mixture.identify(no_docs, names, table).count() == 0


def test_mixture_of_many_languages(spark):
    said = {"de": "der hund und die katze sind nicht hier", "en": "the cat and the dog are here with them",
            "es": "el perro y los gatos pequeños están muy lejos", "fr": "le chien et la chatte ne sont pas avec nous",
            "pl": "pies oraz kotka bardzo chcą wyjść przed dom"}
    names, table = mixture.train(spark.createDataFrame([(t, x) for x, t in said.items()] * 20, "text string, lang string"))
    texts = [" ".join(" ".join([said[x]] * 12) for x in names[:m]) for m in range(1, 6)]
    rows = mixture.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), names, table)
    for r in rows.orderBy("doc_id").collect():
        m = r.doc_id + 1
        assert sorted(r.languages) == names[:m] and abs(r.score - 1 / m) < 0.1, r


def test_word_likelihoods_equal_a_plain_sum():
    r = np.random.default_rng(1)
    table = r.normal(size=(mixture.BUCKETS * len(mixture.GRAM_SIZES), 2)).astype(np.float32)
    texts = [b"ab c", b"", b"9 xyz9", b"q"]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    owner, got = mixture._word_likelihoods(data, offsets, table)
    assert owner.tolist() == [0, 0, 2, 3]
    for word, have in zip(["ab", "c", "xyz", "q"], got, strict=True):
        want, padded = np.zeros(2), f" {word} ".encode()
        for g, k in enumerate(mixture.GRAM_SIZES):
            for a in range(max(1, len(padded) - k + 1)):
                piece = (padded + b"  ")[a:a + k]
                h = np.array([k], dtype=np.uint64)
                for c in piece:
                    h = h * np.uint64(257) + np.uint64(c)
                want += table[g * mixture.BUCKETS + int(mixture.mix(h)[0] % np.uint64(mixture.BUCKETS))]
        assert np.allclose(have, want * mixture._SHARPNESS / len(mixture.GRAM_SIZES), atol=1e-4), word
