"""Entity resolution cases (padding, aliases, typos, partial names, never-invents, ambiguity)."""
import difflib

import pytest

from martlens.plans import entities as E

CATALOGUE = (
    [("store_id", "dim_store.store_id", f"ST{i:03d}", True) for i in range(1, 51)]
    + [("store_name", "dim_store.store_name", n, False) for n in ("Gurugram Cyber Hub", "Kolkata Park Street")]
    + [("city", "dim_store.city", c, False) for c in ("Bengaluru", "Gurugram", "Kolkata", "Mumbai", "Delhi")]
    + [("channel", "fact_orders.channel", c, False) for c in ("Dine-in", "Takeaway", "Swiggy", "Zomato")]
    + [("sku_name", "dim_product.sku_name", n, False) for n in
       ("Veg Burger 1", "Veg Burger 2", "Veg Burger 5", "Non-Veg Burger 2", "Margherita Pizza", "Farmhouse Pizza")]
    + [("category", "dim_product.category", c, False) for c in ("Pizza", "Burgers")]
)


@pytest.fixture(scope="module")
def cat(spark):
    return spark.createDataFrame(CATALOGUE, "dimension string, column string, value string, is_identifier boolean")


def resolve(spark, cat, text):
    texts = spark.createDataFrame([(1, text)], "text_id long, text string")
    return [(r.text, r.dimension, r.value, r.confidence, r.method)
            for r in E.resolve(texts, cat, ("Swiggy", "Zomato")).orderBy("match_rank").collect()]


def test_identifier_padding(spark, cat):
    for t in ("ST7", "st07", "ST007"):
        m = resolve(spark, cat, f"How is {t} doing?")
        assert [(x[2], x[4]) for x in m if x[1] == "store_id"] == [("ST007", "identifier" if t != "ST007" else "exact")]


def test_aliases(spark, cat):
    assert {x[2] for x in resolve(spark, cat, "revenue in bangalore")} == {"Bengaluru"}
    got = resolve(spark, cat, "share of delivery")
    assert {x[2] for x in got} == {"Swiggy", "Zomato"} and all(x[3] == 0.95 for x in got)


def test_typo_and_limits(spark, cat):
    m = resolve(spark, cat, "sales in Bengalru")
    assert [(x[2], x[4]) for x in m] == [("Bengaluru", "fuzzy")]
    assert m[0][3] == round(0.7 * difflib.SequenceMatcher(None, "bengalru", "bengaluru").ratio(), 3)
    assert resolve(spark, cat, "sales in Deli") == []


def test_partial_product_names_respect_word_boundary(spark, cat):
    vals = {x[2] for x in resolve(spark, cat, "how did veg burgers do")}
    assert vals == {"Veg Burger 1", "Veg Burger 2", "Veg Burger 5"}


def test_never_invents(spark, cat):
    assert resolve(spark, cat, "How is ST999 doing against McDonalds in Paris?") == []


def test_longer_phrase_claims_tokens(spark, cat):
    m = resolve(spark, cat, "Veg Burger 5 sales")
    assert [x[2] for x in m] == ["Veg Burger 5"]


def test_ambiguity_across_dimensions(spark, cat):
    texts = spark.createDataFrame([(1, "pizzas last month")], "text_id long, text string")
    m = E.resolve(texts, cat, ("Swiggy", "Zomato"))
    amb = E.ambiguous(m).collect()
    assert amb and amb[0].n_dimensions == 2


def test_unresolved_identifiers(spark, cat):
    texts = spark.createDataFrame([(1, "compare ST007 with ST999")], "text_id long, text string")
    m = E.resolve(texts, cat, ())
    assert [r.token for r in E.unresolved_identifiers(texts, m).collect()] == ["ST999"]


def test_topic_first_rule_wins(spark):
    texts = spark.createDataFrame([(1, "Does rain hurt our competitor?"), (2, "revenue by city")],
                                  "text_id long, text string")
    got = {r.text_id: r.topic for r in E.topic_tag(texts).collect()}
    assert got == {1: "competitors", 2: "answerable"}


def test_fuzzy_length_band_blocking_loses_nothing(spark, star):
    """Every (token, value) pair at or above the threshold by brute force is found by the blocked join."""
    from pyspark.sql import functions as F

    from .conftest import SF

    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    cat, _kt = E.lookup_tables(star)
    typos = (cat.filter(~F.col("is_identifier") & (F.length("value") >= 6))
             .select(F.concat(F.substring("value", 1, 3), F.expr("substring(value, 5)")).alias("text"))
             .withColumn("text_id", F.monotonically_increasing_id() + 10**9))
    texts = conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), "text").unionByName(typos)
    ph = E.phrases(texts)
    got = {(r.tok, r.vl) for r in E._fuzzy_candidates(ph, cat).collect()}
    toks = {r.tok for r in ph.filter((F.col("n_tokens") == 1) & (F.length("phrase") >= E.MIN_FUZZY_LENGTH))
            .select(F.lower("phrase").alias("tok")).distinct().collect()}
    vals = {r.vl for r in cat.filter(~F.col("is_identifier")).select(F.lower("value").alias("vl")).distinct().collect()}
    want = {(t, v) for t in toks for v in vals
            if difflib.SequenceMatcher(None, t, v).ratio() >= E.FUZZY_THRESHOLD}
    assert want and got == want
