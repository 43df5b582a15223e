"""The batch verification equals the verification of each answer on its own."""
import random
from datetime import date

from pyspark.sql import functions as F

from martlens.plans import verify as V
from martlens.plans import verify_batch as B
from martlens.profile import RESTAURANT as P
from martlens.profile import TimeWindow

CHANNELS = ["Dine-in", "Takeaway", "Swiggy", "Zomato"]
W = TimeWindow(date(2026, 5, 1), date(2026, 7, 31), "w")


def results_of(r):
    """Random small results with faults."""
    rev = r.choice([1000.0, 1000.0, None, -5.0, 2e7])
    out = {"total": ("revenue double, orders long, aov double", [(rev, 10, r.choice([100.0, 101.0, None]))])}
    rows = [(c, r.choice([250.0, 250.0, 250.0, None]), r.choice([2, 0, 3]), r.choice([25.0, 25.4, 20.0])) for c in CHANNELS[:r.choice([4, 4, 3, 0])]]
    out["mix"] = ("channel string, revenue double, orders long, revenue_share_pct double", rows)
    days = [(date(2026, r.choice([4, 5, 6, 7]), 3), float(i)) for i in range(r.randint(0, 3))] + [(date(1990, 1, 1), 1.0)] * (r.random() < 0.2)
    out["days"] = ("order_date date, revenue_change double", days)
    out["months"] = ("month_key string, units long, city string", [(r.choice(["2026-05", "2026-06", "x", None]), r.choice([1, -1, 5]), c)
                                                                     for c in ["Delhi", None, "Pune"][:r.randint(1, 3)]])
    keep = r.sample(sorted(out), r.randint(1, 4))
    return {k: out[k] for k in out if k in keep}


def test_every_answer_has_the_report_of_its_own_verification(spark):
    r = random.Random(12)
    questions = ["Top 2 channels?", "How are we doing?", "the best 3 months"]
    answers, results, cells, want = [], [], None, {}
    for a in range(5):
        q, metrics, made = r.choice(questions), r.sample(["revenue", "aov", "margin_pct", "zeal"], 2), results_of(r)
        answers.append((a, q, metrics))
        given = []
        for idx, (rid, (schema, rows)) in enumerate(made.items()):
            df = spark.createDataFrame(rows, schema)
            given.append((rid, df))
            kinds = [(f.name, "num" if V.is_numeric_type(f.dataType) else "date" if f.dataType.simpleString() == "date" else "str")
                     for f in df.schema.fields]
            results.append((a, idx, rid, False, kinds))
            part = B.long_form(F.lit(a).cast("long"), idx, df, kinds, F.monotonically_increasing_id())
            cells = part if cells is None else cells.unionByName(part)
        if a % 4 == 0:
            given.append(("lost", ValueError("no")))
            results.append((a, len(made), "lost", True, []))
        for x in V.verify(given, V.Plan(q, W, tuple(metrics)), P).collect():
            want[a, x.name] = (x.severity, x.passed, x.n_offenders, sorted(x.result_ids))
    rep = B.verify_batch(
        spark.createDataFrame(answers, "answer_id long, question string, metrics array<string>"),
        spark.createDataFrame(results, "answer_id long, idx int, result_id string, failed boolean, "
                                       "columns array<struct<name:string,kind:string>>"), cells, W, P)
    got = {(x.answer_id, x.name): (x.severity, x.passed, x.n_offenders, sorted(x.result_ids)) for x in rep.collect()}
    assert got == want and len({k for k, v in got.items() if not v[1]}) > 8
    for x in B.verdicts(rep).collect():
        bad = {k: v for k, v in got.items() if k[0] == x.answer_id and not v[1]}
        assert x.errors == sum(v[0] == "error" for v in bad.values())
        assert x.blamed == sorted({i for v in bad.values() if v[0] == "error" for i in v[3]})


def test_roles_from_the_table_equal_the_rules_of_one_question(spark):
    names = ["revenue", "revenue_change", "revenue_share_pct", "aov", "avg_order_value_vs_last", "order_count", "orders_pct_of",
             "qty", "Units", "net_before_tax", "growth", "mix_pct", "city", "sales_trend", "transactions", "x"]
    df = spark.createDataFrame([(n,) for n in names], "c string").select("c", *(c.alias(k) for k, c in B.roles_of(F.col("c")).items()))
    for r in df.collect():
        assert (r.delta, r.share, r.aov, r.revenue, r.orders, r.quantity) == (
            V.is_delta(r.c), V.is_share(r.c), V.is_aov(r.c), V.is_revenue(r.c), V.is_order_count(r.c), V.is_quantity(r.c))
