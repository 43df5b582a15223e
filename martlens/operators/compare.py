"""Comparison operators (D-01 ... D-04): reconcile two computations of one result.

These are how an independent second implementation is checked against the
first: a full outer join on the keys with null-safe, tolerance-aware
comparison, figure presence, ordered-run containment and partition identities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.operators.numbering import numbered


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], tolerances: dict[str, float]) -> DataFrame:
    """Per compared column: rows missing left, missing right, out of tolerance, worst gap (D-01, J-09)."""
    l_ = left.select(*keys, *[F.col(c).cast("double").alias(f"l__{c}") for c in tolerances], F.lit(True).alias("_l"))
    r_ = right.select(*keys, *[F.col(c).cast("double").alias(f"r__{c}") for c in tolerances], F.lit(True).alias("_r"))
    j = l_.join(r_, keys, "full_outer")
    rows = []
    for c, tol in tolerances.items():
        both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
        gap = F.abs(F.col(f"l__{c}") - F.col(f"r__{c}"))
        bad = both & (~F.col(f"l__{c}").eqNullSafe(F.col(f"r__{c}"))) & (gap.isNull() | (gap > tol))
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(tol).alias("tolerance"),
                             F.col("_l").isNull().alias("missing_left"), F.col("_r").isNull().alias("missing_right"),
                             bad.alias("out_of_tolerance"), F.when(both, gap).alias("gap")))
    long = j.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return long.groupBy("column", "tolerance").agg(
        F.count(F.when(F.col("missing_left"), 1)).alias("missing_left"),
        F.count(F.when(F.col("missing_right"), 1)).alias("missing_right"),
        F.count(F.when(F.col("out_of_tolerance"), 1)).alias("out_of_tolerance"),
        F.coalesce(F.max("gap"), F.lit(0.0)).alias("max_gap"))


def figure_presence(targets: DataFrame, cells: DataFrame, tol: float = 1.0) -> DataFrame:
    """Each target value: is it within ``tol`` of some numeric cell (D-02)?

    Exact blocking on buckets of width ``2*tol``: a match lies in the target's
    bucket or a neighbour.
    """
    w = 2.0 * tol
    t = targets.select("target_id", "target", F.explode(F.sequence(
        F.floor(F.col("target") / w).cast("long") - 1, F.floor(F.col("target") / w).cast("long") + 1)).alias("_b"))
    v = cells.filter(F.col("num").isNotNull()).select(F.col("num"), F.floor(F.col("num") / w).cast("long").alias("_b"))
    hits = t.join(v, "_b").filter(F.abs(F.col("num") - F.col("target")) <= tol).select("target_id").distinct()
    return targets.join(hits.withColumn("present", F.lit(True)), "target_id", "left").select(
        "target_id", "target", F.coalesce("present", F.lit(False)).alias("present"))


def contains_runs(placed: DataFrame, label: str, place: str, runs: DataFrame) -> DataFrame:
    """Per run: does the ranking contain its labels as consecutive places, forwards or reversed (D-03)?

    ``placed`` is a ranking with its places (``numbering.numbered``), ``runs`` has (run_id, at, label) with
    ``at`` from 0. Places less places in the run are the same for all labels of a contained run (their sum,
    for a reversed one), so a contained run is a group of as many places: one equi-join and one
    aggregation for any number of runs.
    """
    wanted = runs.select("run_id", F.col("at").cast("long").alias("__at"), F.col("label").cast("string").alias("__label"))
    sizes = wanted.groupBy("run_id").agg(F.countDistinct("__at").alias("__k"))
    both = placed.select(F.col(label).cast("string").alias("__label"), F.col(place).alias("__place")) \
        .join(wanted, "__label").select("run_id", "__at", F.explode(F.array(
            F.struct(F.lit(True).alias("ahead"), (F.col("__place") - F.col("__at")).alias("offset")),
            F.struct(F.lit(False).alias("ahead"), (F.col("__place") + F.col("__at")).alias("offset")))).alias("__d"))
    groups = both.groupBy("run_id", "__d").agg(F.countDistinct("__at").alias("__n"))
    best = groups.groupBy("run_id").agg(*(F.max(F.when(F.col("__d.ahead") == way, F.col("__n"))).alias(name)
                                          for name, way in (("__f", True), ("__r", False))))
    found = sizes.join(best, "run_id", "left").select(
        "run_id", *(F.coalesce(F.col(c) == F.col("__k"), F.lit(False)).alias(n) for c, n in (("__f", "forward"), ("__r", "reversed"))))
    return found.select("run_id", (F.col("forward") | F.col("reversed")).alias("contains_run"), "forward", "reversed")


def contains_run(ranking: DataFrame, label: str, order: str, expected: list[str]) -> DataFrame:
    """``contains_runs`` for one literal run, over a ranking that is numbered here by range partitions."""
    spark = ranking.sparkSession
    runs = spark.createDataFrame([(0, k, x) for k, x in enumerate(expected)], "run_id int, at int, label string")
    placed = numbered(ranking.select(F.col(label), F.col(order)), [F.col(order), F.col(label)], "__place")
    return contains_runs(placed, label, "__place", runs).drop("run_id")


def identity(name: str, lhs: Column, rhs: Column, tol: float) -> Column:
    """One partition identity as a struct (D-04)."""
    return F.struct(F.lit(name).alias("identity"), lhs.cast("double").alias("lhs"), rhs.cast("double").alias("rhs"),
                    (lhs.cast("double") - rhs.cast("double")).alias("delta"),
                    (F.abs(lhs.cast("double") - rhs.cast("double")) <= tol).alias("holds"))
