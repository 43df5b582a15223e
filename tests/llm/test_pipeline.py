import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from martlens.llm import bpe
from tests.llm.test_jaccard import brute as duplicates
from tests.llm.test_pii import base_spans
from tests.llm.test_winnow import brute as hits

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, []
    for _, stage in pipeline.STAGES:
        docs = pipeline.saved(stage(spark, docs, SF), "test-stage")
        tables.append(docs)
    assert all(t.columns == columns for t in tables[:-1])
    rows = [{r.doc_id: r for r in t.collect()} for t in tables]
    graded = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, ok in graded.items() if ok]
    assert sum(i in rows[0] for i in good) / len(good) > 0.95
    pairs = lambda t: [(i, r.text) for i, r in t.items()]
    assert set(rows[1]) == {i for i, _, c in duplicates(pairs(rows[0])) if i == c}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(rows[2]) == {i for i, _, n, _ in hits(pairs(rows[1]), items) if n == 0}
    assert set(rows[3]) == set(rows[2])
    for i, r in rows[3].items():
        assert base_spans(r.text) == "" and r.n_chars == len(r.text)
        assert (r.text == rows[2][i].text) or base_spans(rows[2][i].text) or "[SECRET]" in r.text
    enc = bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for i, r in rows[4].items():
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == enc.encode_ordinary(rows[3][i].text)
    assert sorted(rows[4]) == sorted(r.doc_id for r in pipeline.run(spark, SF).collect())


def test_dedup_stage_cases(spark):
    text = "one two three four five six seven"
    rows = [(2, text), (1, text), (1, text), (1, "another text altogether it is"), (None, text), (None, "alone it is here now"),
            (3, None), (4, ""), (5, " ")]
    docs = pipeline.saved(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows],
                                                "doc_id long, text string, lang string, source string, n_chars long"), "t")
    got = sorted(((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, text), (1, "another text altogether it is"), (None, "alone it is here now"),
                          (3, None), (4, ""), (5, " ")], key=str)


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
