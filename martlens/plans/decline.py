"""Trend, decline and decline diagnosis (A-23 ... A-27, A-30 ... A-36, A-48, W-04).

"Declining" means strictly falling in every consecutive month of the window
(``v[i] > v[i+1]``); missing months count as 0 and ties disqualify. The
baseline is a column, never a filter.

The Q8 diagnosis is one set-based plan keyed by store instead of a loop over
declining stores: the window and prior slices of the order fact are aggregated
once to (store, channel, month) grain, and every diagnostic (monthly spine,
channel attribution, prior window, decomposition, market context) is derived
from that small frame plus one distinct-customer aggregate. Nothing is
collected to the driver; the fact rows are scanned twice at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.functions import scalars as S
from martlens.operators.joins import broadcast_literal
from martlens.operators.metrics import in_window
from martlens.profile import TimeWindow
from martlens.sources.star import Star


def month_col(m: str) -> str:
    return "rev_" + m.replace("-", "_")


def _money(c) -> "F.Column":
    col = F.col(c) if isinstance(c, str) else c
    return S.as_double(F.coalesce(col, S.dec("0.00")))


def strictly(cols: list, falling: bool = True) -> "F.Column":
    """All consecutive pairs strictly falling (or rising); true for one month."""
    pairs = [(a > b) if falling else (a < b) for a, b in zip(cols, cols[1:])]
    return reduce(lambda x, y: x & y, pairs, F.lit(True))


# --- A-23: monthly pivot --------------------------------------------------------
def monthly_pivot(df: DataFrame, index: list[str], months: list[str], value: str = "net_before_tax") -> DataFrame:
    """One exact-sum column per month in the given order, missing -> 0 (A-23).

    Passing the month list explicitly fixes the output columns and saves the
    extra job Spark would run to discover the distinct pivot values.
    """
    piv = df.groupBy(*index).pivot("month_key", months).agg(F.sum(value))
    return piv.select(*index, *[F.coalesce(F.col(f"`{m}`"), S.dec("0.00")).alias(month_col(m)) for m in months])


# --- A-24 / A-25: trend flags by any dimension ------------------------------------
def trend_table(star: Star, index: list[str], w: TimeWindow | None = None) -> DataFrame:
    """Per member: monthly revenue, first/last, change, change %, flags (A-24, A-25)."""
    w = w or star.profile.window()
    months = w.months()
    piv = monthly_pivot(in_window(star.wide_orders, w.start, w.end), index, months)
    vals = [F.col(month_col(m)) for m in months]
    first, last = vals[0], vals[-1]
    return piv.select(
        *index, *[_money(v).alias(month_col(m)) for v, m in zip(vals, months)],
        _money(first).alias("first_month_revenue"), _money(last).alias("last_month_revenue"),
        _money(last - first).alias("change"),
        S.safe_pct_change(first, last).alias("change_pct"),
        strictly(vals, True).cast("int").alias("strictly_declining"),
        strictly(vals, False).cast("int").alias("strictly_rising"),
        (last < first).cast("int").alias("last_below_first"),
    )


# --- A-26 / A-27: baseline comparison, in the same pass as the trend ---------------
def decline_vs_baseline(star: Star, index: list[str], w: TimeWindow | None = None,
                        baseline: TimeWindow | None = None) -> DataFrame:
    """Strict-decline flag and baseline comparison on one row per entity (A-26, A-27, P-10).

    One scan over [baseline start, window end] with conditional sums; members
    are the entities with an order in the window (as for the trend table).
    """
    p = star.profile
    w = w or p.window()
    baseline = baseline or p.prior()
    months = w.months()
    lo, hi = min(w.start, baseline.start), max(w.end, baseline.end)
    df = in_window(star.wide_orders, lo, hi)
    in_w = F.col("order_date").between(S.lit_date(w.start), S.lit_date(w.end))
    in_b = F.col("order_date").between(S.lit_date(baseline.start), S.lit_date(baseline.end))
    net = F.col("net_before_tax")
    aggs = [F.sum(F.when(in_w & (F.col("month_key") == m), net)).alias(month_col(m)) for m in months]
    aggs += [F.sum(F.when(in_w, net)).alias("_win"), F.sum(F.when(in_b, net)).alias("_base"),
             F.count(F.when(in_w, F.lit(1))).alias("_n_win")]
    g = df.groupBy(*index).agg(*aggs).filter(F.col("_n_win") > 0)
    vals = [F.coalesce(F.col(month_col(m)), S.dec("0.00")) for m in months]
    win, base = F.coalesce("_win", S.dec("0.00")), F.coalesce("_base", S.dec("0.00"))
    return g.select(
        *index, *[_money(v).alias(month_col(m)) for v, m in zip(vals, months)],
        strictly(vals, True).cast("int").alias("strictly_declining"),
        _money(win).alias("window_revenue"), _money(base).alias("baseline_revenue"),
        _money(win - base).alias("delta_abs"),
        S.safe_pct_change(base, win).alias("delta_pct"),
        (win > base).cast("int").alias("is_above_baseline"),
    )


def consecutive_decline_by_window(star: Star, dim: str, w: TimeWindow | None = None) -> DataFrame:
    """The same strict-decline test written with LAG over a month spine (W-04, J-06); must agree with A-24.

    Runs over a member x month spine (cross join of members and the window's
    months), so a missing month is a 0 and breaks or continues the run exactly
    as in the pivot formulation.
    """
    from pyspark.sql import Window
    w = w or star.profile.window()
    months = w.months()
    spark = star.fact_orders.sparkSession
    wo = in_window(star.wide_orders, w.start, w.end)
    g = wo.groupBy(dim, "month_key").agg(F.sum("net_before_tax").alias("_rev"))
    members = g.select(dim).distinct()
    spine = members.crossJoin(broadcast_literal(spark.createDataFrame([(m,) for m in months], "month_key string")))
    s = spine.join(g, [dim, "month_key"], "left").withColumn("_rev", F.coalesce("_rev", S.dec("0.00")))
    lw = Window.partitionBy(dim).orderBy("month_key")
    s = s.withColumn("_prev", F.lag("_rev").over(lw))
    return s.groupBy(dim).agg(
        F.min(F.when(F.col("_prev").isNotNull(), (F.col("_rev") < F.col("_prev")).cast("int"))).alias("_ok"),
        F.count(F.lit(1)).alias("_n")).select(
        dim, F.coalesce(F.col("_ok"), F.lit(1)).alias("strictly_declining"))


# --- A-30 ... A-36: Q8 -----------------------------------------------------------------
STORE_KEYS = ["store_id", "store_name", "city", "region"]


def store_decline(star: Star, w: TimeWindow | None = None) -> DataFrame:
    """Per store: monthly revenue, window revenue, change, change %, declined flag (A-30)."""
    t = trend_table(star, STORE_KEYS, w)
    months = (w or star.profile.window()).months()
    win = reduce(lambda a, b: a + b, [F.col(month_col(m)) for m in months])
    return t.select(*STORE_KEYS, *[month_col(m) for m in months], win.alias("window_revenue"), "change",
                    "change_pct", F.col("strictly_declining").alias("declined_every_month"))


def diagnostics_monthly(star: Star, w: TimeWindow | None = None, only_declining: bool = True) -> DataFrame:
    """Store x month spine of revenue, orders, units, AOV, units/order, identified customers (A-31).

    Missing months are 0 rows of the spine. NULL customers are not counted.
    """
    p = star.profile
    w = w or p.window()
    months = w.months()
    spark = star.fact_orders.sparkSession
    stores = store_decline(star, w)
    if only_declining:
        stores = stores.filter(F.col("declined_every_month") == 1)
    spine = stores.select(*STORE_KEYS).crossJoin(
        broadcast_literal(spark.createDataFrame([(i, m) for i, m in enumerate(months)], "month_idx int, month_key string")))
    wo = in_window(star.wide_orders, w.start, w.end)
    sm = wo.groupBy("store_id", "month_key").agg(
        F.sum("net_before_tax").alias("_rev"), F.count("order_id").alias("orders"),
        F.sum("total_qty").alias("_units"),
        F.countDistinct("customer_id").alias("distinct_identified_customers"))
    out = spine.join(sm, ["store_id", "month_key"], "left")
    return out.select(
        *STORE_KEYS, "month_idx", "month_key",
        _money("_rev").alias("revenue"),
        F.coalesce("orders", F.lit(0)).alias("orders"),
        F.coalesce("_units", F.lit(0)).cast("long").alias("units"),
        F.coalesce("distinct_identified_customers", F.lit(0)).alias("distinct_identified_customers"),
    ).withColumn("aov", S.safe_ratio("revenue", "orders")).withColumn(
        "units_per_order", S.safe_ratio("units", "orders"))


def channel_attribution(star: Star, w: TimeWindow | None = None) -> DataFrame:
    """Per (store, channel): monthly revenue, change, change %, strict decline (A-34)."""
    w = w or star.profile.window()
    months = w.months()
    t = monthly_pivot(in_window(star.wide_orders, w.start, w.end), ["store_id", "channel"], months)
    vals = [F.col(month_col(m)) for m in months]
    return t.select("store_id", "channel", *[_money(v).alias(month_col(m)) for v, m in zip(vals, months)],
                    _money(vals[-1] - vals[0]).alias("change_inr"),
                    S.safe_pct_change(vals[0], vals[-1]).alias("change_pct"),
                    strictly(vals, True).cast("int").alias("strictly_declining"))


def store_diagnosis(star: Star, w: TimeWindow | None = None) -> DataFrame:
    """One row per declining store with the four diagnostic readings (A-31 ... A-36).

    * fewer orders or smaller baskets: first->last change of orders, AOV,
      units/order, identified customers; volume/basket decomposition
      ``orders_effect = aov0*(n1-n0)``, ``aov_effect = n0*(aov1-aov0)`` (the
      interaction term is not attributed); driver = larger absolute effect,
      ties to order volume;
    * concentrated in one channel: worst channel = smallest change (ties by
      name); concentrated iff the store fell and worst/total >= 0.5;
    * break in trend: window revenue vs the prior window;
    * market-wide iff the store's city strictly declined, else store-specific.
    """
    p = star.profile
    w = w or p.window()
    prior = p.prior() if w == p.window() else TimeWindow(*_prior_of(w))
    months = w.months()
    first_m, last_m = months[0], months[-1]
    decl = store_decline(star, w).filter(F.col("declined_every_month") == 1)
    monthly = diagnostics_monthly(star, w, only_declining=True)

    def at(month, col):
        return F.max(F.when(F.col("month_key") == month, F.col(col)))
    fl = monthly.groupBy("store_id").agg(
        at(first_m, "orders").alias("n0"), at(last_m, "orders").alias("n1"),
        at(first_m, "aov").alias("aov0"), at(last_m, "aov").alias("aov1"),
        at(first_m, "units_per_order").alias("upo0"), at(last_m, "units_per_order").alias("upo1"),
        at(first_m, "distinct_identified_customers").alias("c0"),
        at(last_m, "distinct_identified_customers").alias("c1"))
    ch = channel_attribution(star, w)
    worst = ch.groupBy("store_id").agg(
        F.min_by(F.struct("channel", "change_inr"), F.struct("change_inr", "channel")).alias("_w"))
    prior_rev = (in_window(star.wide_orders, prior.start, prior.end).groupBy("store_id")
                 .agg(F.sum("net_before_tax").alias("_prior")))
    city = trend_table(star, ["city"], w).select(
        "city", F.col("change_pct").alias("city_change_pct"),
        F.col("strictly_declining").alias("city_strictly_declining"))
    out = (decl.join(fl, "store_id", "left").join(worst, "store_id", "left")
           .join(prior_rev, "store_id", "left").join(city, "city", "left"))
    orders_effect = F.col("aov0") * (F.col("n1") - F.col("n0")).cast("double")
    aov_effect = F.col("n0").cast("double") * (F.col("aov1") - F.col("aov0"))
    prior_d = _money("_prior")
    return out.select(
        *STORE_KEYS, "window_revenue", F.col("change").alias("revenue_change"), "change_pct",
        S.safe_pct_change("n0", "n1").alias("orders_change_pct"),
        S.safe_pct_change("aov0", "aov1").alias("aov_change_pct"),
        S.safe_pct_change("upo0", "upo1").alias("units_per_order_change_pct"),
        S.safe_pct_change("c0", "c1").alias("identified_customers_change_pct"),
        orders_effect.alias("orders_effect"), aov_effect.alias("aov_effect"),
        F.when(F.abs(orders_effect) >= F.abs(aov_effect), F.lit("order volume"))
        .otherwise(F.lit("basket size")).alias("primary_driver"),
        F.col("_w.channel").alias("worst_channel"), F.col("_w.change_inr").alias("worst_channel_change"),
        (F.col("_w.channel").isNotNull() & (F.col("change") < 0)
         & (S.safe_ratio(F.col("_w.change_inr"), F.col("change")) >= 0.5)).cast("int")
        .alias("decline_concentrated_in_one_channel"),
        prior_d.alias("prior_revenue"),
        (F.col("window_revenue") - prior_d).alias("vs_prior_change"),
        S.safe_pct_change(prior_d, "window_revenue").alias("vs_prior_change_pct"),
        (F.col("window_revenue") < prior_d).cast("int").alias("is_break_in_trend"),
        "city_change_pct", "city_strictly_declining",
        F.when(F.col("city_strictly_declining") == 1, F.lit("market-wide"))
        .otherwise(F.lit("store-specific")).alias("market_context"),
    ).orderBy(F.col("change_pct").asc_nulls_last(), "store_id")


def _prior_of(w: TimeWindow):
    from datetime import timedelta

    from martlens.profile import shift_months
    return shift_months(w.start, -3), w.start - timedelta(days=1)


# --- A-48: flag membership lists -----------------------------------------------------
def flag_membership(df: DataFrame, label: str, flags: list[str], cap: int = 50) -> DataFrame:
    """Per flag column, the labels with 1 and with 0 (both groups always present), and those
    without a flag under NULL (A-48).

    Labels are sorted for determinism and capped at ``cap`` per group; the full
    count is kept alongside. The aggregation is per (flag, value) group and
    ``slice`` keeps only ``cap`` labels per group in the output.
    """
    from martlens.operators.topk import top_k_per_group

    spark = df.sparkSession
    long = df.select(label, F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).cast("int").alias("value"))
                                               for f in flags])).alias("_fv")).select(
        F.col(label).cast("string").alias("_label"), "_fv.flag", "_fv.value")
    counts = long.groupBy("flag", "value").agg(F.count(F.lit(1)).alias("n_members"))
    keyed = long.distinct().withColumn("_v", F.coalesce("value", F.lit(-1)))
    firsts = top_k_per_group(keyed, ["flag", "_v"], [F.col("_label")], cap, salt_on=["_label"])
    lists = firsts.groupBy("flag", "value").agg(
        F.array_join(F.array_sort(F.collect_list("_label")), ",").alias("labels"))
    grouped = counts.join(lists.withColumnsRenamed({"flag": "_f", "value": "_val"}),
                          (F.col("flag") == F.col("_f")) & F.col("value").eqNullSafe(F.col("_val")), "left")
    empty = spark.createDataFrame([(f, v, 0, "") for f in flags for v in (1, 0)],
                                  "flag string, value int, n_members long, labels string")
    return (grouped.select("flag", "value", "n_members", F.coalesce("labels", F.lit("")).alias("labels"))
            .unionByName(empty).groupBy("flag", "value")
            .agg(F.sum("n_members").alias("n_members"), F.max("labels").alias("labels")))
