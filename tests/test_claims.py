"""Claim audit cases: fabricated, rounded/scaled, skipped tokens, differences, identifiers."""
from martlens.plans import claims as C
from martlens.profile import RESTAURANT as P


def audit(spark, text, cells):
    answers = spark.createDataFrame([(1, text, 0.8, False)],
                                    "answer_id long, text string, confidence double, verification_failed boolean")
    cdf = spark.createDataFrame([(1, r, c, n, s) for r, c, n, s in cells],
                                "answer_id long, result_id string, column string, num double, str string")
    figs = sorted(r.token for r in C.unsupported_figures(answers, cdf, P).collect())
    ids = sorted(r.token for r in C.unsupported_identifiers(answers, cdf).collect())
    conf = C.adjusted_confidence(answers, C.unsupported_figures(answers, cdf, P)).first().adjusted_confidence
    return figs, ids, conf


CELLS = [("r1", "revenue", 3197076.5, None), ("r1", "orders", 4930.0, None), ("r1", "aov", 648.49, None),
         ("r2", "revenue", 120000.0, None), ("r2", "revenue", 114795.0, None), ("r2", "orders", 300.0, None),
         ("r2", "store_id", None, "ST007"), ("r2", "store_name", None, "ST012 Kolkata")]


def test_fabricated_headline_figure(spark):
    figs, _, conf = audit(spark, "Revenue was 4,100,000 INR.", CELLS)
    assert figs == ["4,100,000"] and conf == 0.56


def test_rounded_and_scaled(spark):
    figs, _, conf = audit(spark, "Revenue reached 3,197,076 INR, about 3,197 thousand, AOV 648.", CELLS)
    assert figs == [] and conf == 0.8


def test_skipped_tokens(spark):
    figs, _, _ = audit(spark, "Up 12.5% on 2026-05-01, in 2026, with 42 stores.", CELLS)
    assert figs == []


def test_difference_within_column_but_not_across(spark):
    assert audit(spark, "Revenue fell by 5,205 INR.", CELLS)[0] == []
    assert audit(spark, "It moved by 4,281 INR.", CELLS)[0] == ["4,281"]


def test_identifiers(spark):
    _, ids, _ = audit(spark, "ST007 led, ST07 lagged, ST012 appears inside a name, Q3 is prose.", CELLS)
    assert ids == ["ST07"]


def test_sides_that_grow_with_the_answers_are_not_broadcast(spark):
    answers = spark.createDataFrame([(1, "Revenue was 4,100,000 INR.", 0.8, False)],
                                    "answer_id long, text string, confidence double, verification_failed boolean")
    cells = spark.createDataFrame([(1, r, c, n, s) for r, c, n, s in CELLS],
                                  "answer_id long, result_id string, column string, num double, str string")
    bad = C.unsupported_figures(answers, cells, P)
    plan = C.adjusted_confidence(answers, bad)._jdf.queryExecution().sparkPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert sum("SortMergeJoin" in x for x in joins) >= 6, joins  # the rest look up the few keys that are spread
    assert "SortMergeJoin" in C.unsupported_identifiers(answers, cells)._jdf.queryExecution().sparkPlan().toString()
