"""Evaluation analyses on the star (A-12 ... A-19, A-28, A-29, A-37 ... A-47).

Each function returns one lazy DataFrame. Conventions shared by all of them:

* money is summed as DECIMAL and converted to double once (``_money``);
* ratios go through the zero-safe helpers (0.0 on a zero denominator);
* global windows (rank, percent of total) only ever run on aggregated frames
  whose size is the number of entities, never on fact rows; totals are a
  one-row aggregate cross-joined (broadcast) to the groups;
* per-day rates divide by calendar days from the calendar table, not by days
  that happened to have orders.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlens.functions import scalars as S
from martlens.operators.joins import broadcast_if_small, broadcast_literal
from martlens.operators.metrics import calendar_days, in_window
from martlens.profile import TimeWindow
from martlens.sources.star import Star

TOP_N = 5


def _money(c) -> "F.Column":
    col = F.col(c) if isinstance(c, str) else c
    return S.as_double(F.coalesce(col, S.dec("0.00")))


def _order_aggs() -> list:
    return [F.sum("net_before_tax").alias("_rev"), F.count("order_id").alias("orders"),
            F.sum("total_qty").alias("_units")]


_MEASURES = ("revenue", "orders", "units", "aov", "units_per_order")


def _finish_order_aggs(df: DataFrame) -> DataFrame:
    """revenue, orders, units, aov, units_per_order in that order, after the keys."""
    out = (df.withColumn("revenue", _money("_rev"))
           .withColumn("units", F.coalesce("_units", F.lit(0)).cast("long"))
           .withColumn("aov", S.safe_ratio("revenue", "orders"))
           .withColumn("units_per_order", S.safe_ratio("units", "orders"))
           .drop("_rev", "_units"))
    rest = [c for c in out.columns if c not in _MEASURES]
    first = df.columns.index("_rev") if "_rev" in df.columns else len(rest)
    keys = [c for c in df.columns[:first] if c in rest]
    return out.select(*keys, *_MEASURES, *[c for c in rest if c not in keys])


def window_orders(star: Star, w: TimeWindow | None = None) -> DataFrame:
    w = w or star.profile.window()
    return in_window(star.wide_orders, w.start, w.end)


# --- A-12 / A-15: headline ------------------------------------------------
def headline(star: Star, w: TimeWindow | None = None) -> DataFrame:
    """Revenue, orders, AOV, units, units/order, with-tax, gross, discount (A-12)."""
    df = window_orders(star, w).agg(
        *_order_aggs(), F.sum("net_revenue").alias("_rt"), F.sum("gross_bill_value").alias("_gr"),
        F.sum("discount_amount").alias("_d"))
    return (_finish_order_aggs(df)
            .withColumn("revenue_with_tax", _money("_rt"))
            .withColumn("gross_revenue", _money("_gr"))
            .withColumn("discount", _money("_d"))
            .select("revenue", "orders", "aov", "units", "units_per_order", "revenue_with_tax",
                    "gross_revenue", "discount"))


def monthly(star: Star, w: TimeWindow | None = None) -> DataFrame:
    """Monthly series with AOV and units per order (A-13)."""
    df = window_orders(star, w).groupBy("month_key").agg(*_order_aggs(), F.sum("net_revenue").alias("_rt"))
    return (_finish_order_aggs(df).withColumn("revenue_with_tax", _money("_rt")).drop("_rt")
            .select("month_key", "revenue", "orders", "revenue_with_tax", "units", "aov", "units_per_order")
            .orderBy("month_key"))


# --- A-14: seasonality context ----------------------------------------------
def seasonality_monthly(star: Star) -> DataFrame:
    """Full-range monthly series with the festive periods each month contains."""
    p = star.profile
    series = monthly(star, p.full_range()).select("month_key", "revenue", "orders", "units", "aov")
    cal = calendar_days(star.dim_calendar, p.data_start, p.last_day)
    fest = (cal.filter(F.col("festive_period") != p.non_festive_label)
            .groupBy("month_key")
            .agg(F.array_join(F.array_sort(F.collect_set("festive_period")), ",").alias("festive_periods")))
    fest = broadcast_if_small(fest, 100_000, key=f"{star.source}/festive_months")
    return (series.join(fest, "month_key", "left")
            .withColumn("festive_periods", F.coalesce("festive_periods", F.lit("")))
            .orderBy("month_key"))


def seasonality_summary(star: Star) -> DataFrame:
    """Peak month, trough month and their ratio; ties go to the earlier month."""
    s = monthly(star, star.profile.full_range()).select("month_key", "revenue")
    month = F.unix_date(F.to_date(F.concat("month_key", F.lit("-01"))))
    row = F.struct("month_key", "revenue")
    return (s.agg(F.max_by(row, F.struct(F.col("revenue"), F.lit(0) - month)).alias("p"),
                  F.min_by(row, F.struct(F.col("revenue"), month)).alias("t"))
            .where("p is not null")
            .select(F.col("p.month_key").alias("peak_month"), F.col("p.revenue").alias("peak_revenue"),
                    F.col("t.month_key").alias("trough_month"), F.col("t.revenue").alias("trough_revenue"))
            .withColumn("peak_to_trough_ratio", S.safe_ratio("peak_revenue", "trough_revenue")))


# --- A-16: Q2 store ranking -------------------------------------------------
def _with_share(groups: DataFrame, value: str, out: str, total_df: DataFrame, total_col: str) -> DataFrame:
    return groups.crossJoin(F.broadcast(total_df)).withColumn(
        out, S.pct_of(value, total_col)).drop(total_col)


def store_ranking(star: Star, w: TimeWindow | None = None) -> DataFrame:
    wo = window_orders(star, w)
    grouped = _finish_order_aggs(wo.groupBy("store_id", "store_name", "city", "region").agg(*_order_aggs()))
    total = wo.agg(_money(F.sum("net_before_tax")).alias("_total"))
    ranked = _with_share(grouped, "revenue", "revenue_share_pct", total, "_total")
    # global rank on the aggregated frame (one row per store)
    rank_w = Window.orderBy(F.col("revenue").desc(), F.col("store_id").asc())
    return ranked.withColumn("rank", F.row_number().over(rank_w).cast("long"))


def top_stores(star: Star, n: int = TOP_N, w: TimeWindow | None = None) -> DataFrame:
    """Top-k by revenue (L-01)."""
    return store_ranking(star, w).orderBy(F.col("revenue").desc(), "store_id").limit(n)


def bottom_stores(star: Star, n: int = TOP_N, w: TimeWindow | None = None) -> DataFrame:
    """Bottom-k, worst first (L-02)."""
    return store_ranking(star, w).orderBy(F.col("revenue").asc(), F.col("store_id").desc()).limit(n)


# --- A-17: Q3 channel mix ----------------------------------------------------
def channel_mix(star: Star, w: TimeWindow | None = None) -> DataFrame:
    wo = window_orders(star, w)
    grouped = _finish_order_aggs(wo.groupBy("channel").agg(*_order_aggs()))
    totals = wo.agg(_money(F.sum("net_before_tax")).alias("_tr"), F.count("order_id").alias("_to"))
    return (grouped.crossJoin(F.broadcast(totals))
            .withColumn("revenue_share_pct", S.pct_of("revenue", "_tr"))
            .withColumn("order_share_pct", S.pct_of("orders", "_to"))
            .drop("_tr", "_to")
            .orderBy(F.col("revenue").desc(), "channel"))


# --- A-18 / A-19: Q4 product ranking (line grain) -------------------------------
def product_ranking(star: Star, w: TimeWindow | None = None) -> DataFrame:
    w = w or star.profile.window()
    lines = in_window(star.wide_lines, w.start, w.end)
    g = lines.groupBy("sku_id", "sku_name", "category").agg(
        F.sum("quantity").cast("long").alias("quantity"),
        F.sum("line_net_value").alias("_lr"),
        F.countDistinct("order_id").alias("orders"),
        F.sum("est_cogs").alias("_cogs"))
    return (g.withColumn("line_revenue", _money("_lr"))
            .withColumn("est_cogs", _money("_cogs"))
            .withColumn("gross_margin", _money(F.col("_lr") - F.col("_cogs")))
            .withColumn("margin_pct", S.pct_of("gross_margin", "line_revenue"))
            .drop("_lr", "_cogs"))


def top_products_by_quantity(star: Star, n: int = TOP_N, w: TimeWindow | None = None) -> DataFrame:
    return product_ranking(star, w).orderBy(F.col("quantity").desc(), "sku_id").limit(n)


def top_products_by_revenue(star: Star, n: int = TOP_N, w: TimeWindow | None = None) -> DataFrame:
    return product_ranking(star, w).orderBy(F.col("line_revenue").desc(), "sku_id").limit(n)


def grain_variance(star: Star, w: TimeWindow | None = None) -> DataFrame:
    """Line total minus order total, absolute and % of the order total (A-19)."""
    w = w or star.profile.window()
    lt = in_window(star.wide_lines, w.start, w.end).agg(F.sum("line_net_value").alias("_l"))
    ot = window_orders(star, w).agg(F.sum("net_before_tax").alias("_o"))
    return (lt.crossJoin(ot)
            .select(_money("_l").alias("line_total"), _money("_o").alias("order_total"),
                    _money(F.coalesce("_l", S.dec("0")) - F.coalesce("_o", S.dec("0"))).alias("variance"))
            .withColumn("variance_pct", S.safe_pct_change("order_total", "line_total")))


# --- A-28: Q6 day-type comparison ------------------------------------------------
def day_type_breakdown(star: Star, start: date, end: date, scope: str) -> DataFrame:
    """Per day type over a window; calendar days per type joined as a small lookup (A-28, J-07)."""
    wo = in_window(star.wide_orders, start, end)
    days = (calendar_days(star.dim_calendar, start, end).groupBy("day_type")
            .agg(F.countDistinct("date").alias("distinct_days")))
    grouped = _finish_order_aggs(wo.groupBy("day_type").agg(*_order_aggs()))
    return (grouped.join(broadcast_literal(days), "day_type", "left")
            .withColumn("distinct_days", F.coalesce("distinct_days", F.lit(0)).cast("long"))
            .withColumn("avg_revenue_per_day", S.safe_ratio("revenue", "distinct_days"))
            .withColumn("avg_orders_per_day", S.safe_ratio("orders", "distinct_days"))
            .withColumn("scope", F.lit(scope)))


def day_type_comparison(star: Star) -> DataFrame:
    p = star.profile
    return (day_type_breakdown(star, p.data_start, p.last_day, "full_range")
            .unionByName(day_type_breakdown(star, p.window_start, p.window_end, "window")))


def day_type_ratios(star: Star) -> DataFrame:
    """Weekend:weekday ratios of daily revenue, daily orders and AOV per scope."""
    b = day_type_comparison(star)

    def pick(col, dt):
        return F.coalesce(F.max(F.when(F.col("day_type") == dt, F.col(col))), F.lit(0.0))
    agg = b.groupBy("scope").agg(
        *[pick(c, dt).alias(f"_{c}_{dt}") for c in ("avg_revenue_per_day", "avg_orders_per_day", "aov")
          for dt in ("Weekend", "Weekday")])
    return agg.select(
        "scope",
        S.safe_ratio("_avg_revenue_per_day_Weekend", "_avg_revenue_per_day_Weekday").alias(
            "weekend_to_weekday_daily_revenue_ratio"),
        S.safe_ratio("_avg_orders_per_day_Weekend", "_avg_orders_per_day_Weekday").alias(
            "weekend_to_weekday_daily_orders_ratio"),
        S.safe_ratio("_aov_Weekend", "_aov_Weekday").alias("weekend_to_weekday_aov_ratio"))


# --- A-29: Q7 festive uplift -------------------------------------------------------
ALL_FESTIVE = "All festive"


def festive_uplift(star: Star) -> DataFrame:
    """Per festive period, all festive combined, and normal, per calendar day.

    Rows are driven by the vocabulary, so a period without orders still appears
    with zeros. The combined row is a roll-up of the period rows computed in the
    same pass (one aggregation over the orders, grouped by period).
    """
    p = star.profile
    spark = star.fact_orders.sparkSession
    names = [fp.name for fp in p.festive_periods]
    vocab = broadcast_literal(spark.createDataFrame(
        [(p.non_festive_label, 0)] + [(n, i + 1) for i, n in enumerate(names)] + [(ALL_FESTIVE, len(names) + 1)],
        "period string, period_order int"))
    orders = in_window(star.wide_orders, p.data_start, p.last_day)
    per_period = orders.groupBy(F.col("festive_period").alias("period")).agg(*_order_aggs())
    cal = calendar_days(star.dim_calendar, p.data_start, p.last_day)
    days = cal.groupBy(F.col("festive_period").alias("period")).agg(F.countDistinct("date").alias("_days"))
    blocks = per_period.join(days, "period", "full_outer")
    combined = (blocks.filter(F.col("period").isin(names))
                .agg(F.lit(ALL_FESTIVE).alias("period"), F.sum("_rev").alias("_rev"),
                     F.sum("orders").alias("orders"), F.sum("_units").alias("_units"),
                     F.sum("_days").alias("_days")))
    allb = blocks.unionByName(combined)
    out = (vocab.join(allb, "period", "left")
           .withColumn("orders", F.coalesce("orders", F.lit(0)).cast("long"))
           .withColumn("distinct_days", F.coalesce("_days", F.lit(0)).cast("long")))
    out = _finish_order_aggs(out).drop("_days")
    out = (out.withColumn("avg_revenue_per_day", S.safe_ratio("revenue", "distinct_days"))
           .withColumn("avg_orders_per_day", S.safe_ratio("orders", "distinct_days")))
    normal = out.filter(F.col("period") == p.non_festive_label).select(
        F.col("avg_revenue_per_day").alias("_nr"), F.col("avg_orders_per_day").alias("_no"),
        F.col("aov").alias("_na"))
    is_normal = F.col("period") == p.non_festive_label
    return (out.crossJoin(F.broadcast(normal))
            .withColumn("revenue_uplift_vs_normal_x",
                        F.when(~is_normal, S.safe_ratio("avg_revenue_per_day", "_nr")))
            .withColumn("orders_uplift_vs_normal_x",
                        F.when(~is_normal, S.safe_ratio("avg_orders_per_day", "_no")))
            .withColumn("aov_uplift_vs_normal_x", F.when(~is_normal, S.safe_ratio("aov", "_na")))
            .drop("_nr", "_no", "_na")
            .orderBy("period_order"))


# --- A-37 / A-38 / A-39: distribution facts ---------------------------------------
def dimension_cardinalities(star: Star) -> DataFrame:
    """Exact distinct counts of the dimensions as (name, value) rows (A-37)."""
    fo = star.fact_orders
    parts = [
        ("stores", star.dim_store.agg(F.countDistinct("store_id"))),
        ("cities", star.dim_store.agg(F.countDistinct("city"))),
        ("regions", star.dim_store.agg(F.countDistinct("region"))),
        ("products", star.dim_product.agg(F.countDistinct("sku_id"))),
        ("categories", star.dim_product.agg(F.countDistinct("category"))),
        ("customers", star.dim_customer.agg(F.countDistinct("customer_id"))),
        ("promotions", star.dim_promotion.agg(F.countDistinct("promo_id"))),
        ("calendar_days", star.dim_calendar.agg(F.countDistinct("date"))),
        ("channels", fo.agg(F.countDistinct("channel"))),
        ("months", fo.agg(F.countDistinct("month_key"))),
    ]
    out = None
    for name, df in parts:
        row = df.toDF("value").select(F.lit(name).alias("name"), F.col("value").cast("long"))
        out = row if out is None else out.unionByName(row)
    return out


def headline_averages(star: Star) -> DataFrame:
    """AOV and units per order over the whole order fact (A-38)."""
    df = star.fact_orders.agg(*_order_aggs())
    return _finish_order_aggs(df).select("aov", "units_per_order")


def group_shares(star: Star) -> DataFrame:
    """Anonymous-order and promoted-order shares with their counts (A-39)."""
    return star.fact_orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count(F.when(F.col("customer_id").isNull(), 1)).alias("anonymous_orders"),
        F.count(F.when(F.col("promo_id").isNotNull(), 1)).alias("promoted_orders"),
    ).select("total_orders", "anonymous_orders", "promoted_orders",
             S.percentage("anonymous_orders", "total_orders").alias("anonymous_share_pct"),
             S.percentage("promoted_orders", "total_orders").alias("promoted_share_pct"))


# --- A-42 ... A-47: reusable analysis shapes ----------------------------------------
def segment_breakdown(star: Star, w: TimeWindow | None = None) -> DataFrame:
    """Customer segments with anonymous orders as their own group (A-42)."""
    wo = window_orders(star, w).withColumn("segment", F.coalesce("customer_segment", F.lit("Anonymous")))
    return _finish_order_aggs(wo.groupBy("segment").agg(*_order_aggs()))


def promotion_effectiveness(star: Star, w: TimeWindow | None = None) -> DataFrame:
    """Promoted vs non-promoted orders, and per promotion (A-43)."""
    wo = window_orders(star, w)
    promo = broadcast_if_small(star.dim_promotion.select("promo_id", "promo_name"),
                               key=f"{star.source}/dim_promotion")
    wo = wo.join(promo, "promo_id", "left").withColumn(
        "is_promo", F.col("promo_id").isNotNull().cast("int")).withColumn(
        "promo_name", F.coalesce("promo_name", F.lit("No promotion")))
    g = _finish_order_aggs(wo.groupBy("is_promo", "promo_name").agg(
        *_order_aggs(), F.sum("discount_amount").alias("_d")))
    return g.withColumn("discount", _money("_d")).drop("_d")


def delivery_share(star: Star, w: TimeWindow | None = None) -> DataFrame:
    """Aggregator channels grouped as one 'Delivery' bucket, with % of total (A-45, W-05)."""
    p = star.profile
    wo = window_orders(star, w).withColumn(
        "channel_group", F.when(F.col("channel").isin(list(p.delivery_channels)), F.lit("Delivery"))
        .otherwise(F.col("channel")))
    g = wo.groupBy("channel_group").agg(F.sum("net_before_tax").alias("_p"))
    total = wo.agg(F.sum("net_before_tax").alias("_w"))
    return (g.crossJoin(F.broadcast(total))
            .select("channel_group", _money("_p").alias("part_revenue"), _money("_w").alias("whole_revenue"))
            .withColumn("pct_of_total", S.pct_of("part_revenue", "whole_revenue")))


def percent_of_total(df: DataFrame, part_col: str, out: str = "pct_of_total") -> DataFrame:
    """W-05 over an aggregated frame: SUM(x) / SUM(SUM(x)) OVER () * 100."""
    total = F.sum(part_col).over(Window.partitionBy())
    return df.withColumn("whole", total).withColumn(out, S.pct_of(part_col, "whole"))


def entity_profile(star: Star, entity: str = "store_id", w: TimeWindow | None = None) -> DataFrame:
    """Entity value, peer average (mean of entity totals) and the difference (A-46, W-06)."""
    g = _finish_order_aggs(window_orders(star, w).groupBy(entity).agg(*_order_aggs()))
    peers = g.agg(F.avg("revenue").alias("peer_avg_revenue"))
    return (g.crossJoin(F.broadcast(peers)).select(entity, "revenue", "peer_avg_revenue")
            .withColumn("diff_vs_peer", F.col("revenue") - F.col("peer_avg_revenue")))


def two_entity_comparison(star: Star, a: str, b: str, entity: str = "store_id",
                          w: TimeWindow | None = None) -> DataFrame:
    """Monthly revenue of two entities side by side with the difference (A-47)."""
    wo = window_orders(star, w).filter(F.col(entity).isin(a, b))
    piv = wo.groupBy("month_key").pivot(entity, [a, b]).agg(F.sum("net_before_tax"))
    return piv.select("month_key", _money(a).alias("revenue_a"), _money(b).alias("revenue_b")).withColumn(
        "difference", F.col("revenue_a") - F.col("revenue_b")).orderBy("month_key")


def top_k_per_month(star: Star, entity: str = "store_id", k: int = 3, w: TimeWindow | None = None) -> DataFrame:
    """Top-k entities inside every month (L-05)."""
    g = window_orders(star, w).groupBy("month_key", entity).agg(_money(F.sum("net_before_tax")).alias("revenue"))
    rk = Window.partitionBy("month_key").orderBy(F.col("revenue").desc(), F.col(entity))
    return g.withColumn("rank_in_month", F.row_number().over(rk).cast("long")).filter(F.col("rank_in_month") <= k)


def month_over_month(star: Star, dim: str = "city") -> DataFrame:
    """Lag and month-over-month % on a monthly mart (W-02, W-03).

    The first month has no previous value (NULL); a zero previous value gives
    NULL as SQL division would, unlike the 0.0 convention of safe_pct_change.
    """
    from martlens.operators.marts import build_marts
    mart = build_marts(star)[{"city": "mart_city_month", "channel": "mart_channel_month",
                              "store_id": "mart_store_month"}[dim]]
    w = Window.partitionBy(dim).orderBy("month_key")
    rev = _money("revenue_net")
    prev = F.lag(rev).over(w)
    return (mart.select(dim, "month_key", rev.alias("revenue"), prev.alias("prev_revenue"))
            .withColumn("mom_pct", F.when(F.col("prev_revenue") != 0,
                                          (F.col("revenue") - F.col("prev_revenue")) * 100.0
                                          / F.col("prev_revenue"))))
