"""Metric registry and the metric query (A-01 ... A-11, P-01 ... P-03, P-08).

Every metric is a ratio of sums or a sum: averages are never averages of
pre-aggregated rows. Money is summed as DECIMAL (exact, independent of the
order Spark combines partial sums in) and converted to double only at the end,
where ratios are taken.

Two grains exist. Order grain (``wide_orders``) is canonical for revenue,
orders and AOV; line grain (``wide_lines``) is used for product attributes and
for margin. A metric query picks the grain from its dimensions and metrics and
refuses combinations that would mix the two.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from typing import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.functions import scalars as S
from martlens.operators.joins import broadcast_if_small
from martlens.profile import TimeWindow, month_key
from martlens.sources.star import Star


# --- P-01 ... P-03: windows -------------------------------------------------
def in_window(df: DataFrame, start: date, end: date, date_col: str = "order_date") -> DataFrame:
    """Inclusive date window (P-01).

    When the frame carries ``month_key`` (the partition column of a written
    star) the equivalent month range is added, so whole partitions are pruned;
    the date predicate itself is a bare comparison on a stored column and is
    pushed to the Parquet scan.
    """
    cond = F.col(date_col).between(S.lit_date(start), S.lit_date(end))
    if "month_key" in df.columns and date_col != "date":
        cond = cond & F.col("month_key").between(month_key(start), month_key(end))
    return df.filter(cond)


def calendar_days(cal: DataFrame, start: date, end: date) -> DataFrame:
    """Calendar rows of a window (P-02)."""
    return cal.filter(F.col("date").between(S.lit_date(start), S.lit_date(end)))


def in_months(df: DataFrame, first_month: str, last_month: str) -> DataFrame:
    """Month-key range on 'YYYY-MM' literals only (P-03); dates are refused."""
    for m in (first_month, last_month):
        if len(m) != 7 or m[4] != "-":
            raise ValueError(f"month range takes 'YYYY-MM' keys, got {m!r}")
    return df.filter(F.col("month_key").between(first_month, last_month))


def apply_filters(df: DataFrame, filters: dict[str, object] | None) -> DataFrame:
    """Equality / multi-value filters (P-08): a conjunction of == and IN (P-06), NULL tests (P-05)."""
    for col, val in (filters or {}).items():
        if isinstance(val, (list, tuple, set, frozenset)):
            df = df.filter(F.col(col).isin(list(val)))
        elif val is None:
            df = df.filter(F.col(col).isNull())
        else:
            df = df.filter(F.col(col) == F.lit(val))
    return df


# --- A-01 ... A-10: metrics ------------------------------------------------
ORDER_BASES: dict[str, Callable[[], Column]] = {
    "revenue": lambda: F.sum("net_before_tax"),
    "revenue_with_tax": lambda: F.sum("net_revenue"),
    "gross_revenue": lambda: F.sum("gross_bill_value"),
    "discount": lambda: F.sum("discount_amount"),
    # order_id is the order fact's primary key (checked by the quality gate),
    # so COUNT(DISTINCT order_id) == COUNT(order_id) there and the cheaper
    # count is used: it needs no extra shuffle on order_id.
    "orders": lambda: F.count("order_id"),
    "units": lambda: F.sum("total_qty"),
}
LINE_BASES: dict[str, Callable[[], Column]] = {
    "revenue": lambda: F.sum("line_net_value"),
    "orders": lambda: F.countDistinct("order_id"),
    "units": lambda: F.sum("quantity"),
    "gross_margin": lambda: F.sum("line_margin"),
    "cogs": lambda: F.sum("est_cogs"),
}


@dataclass(frozen=True)
class Metric:
    name: str
    unit: str
    grains: tuple[str, ...]
    description: str
    finish: Callable[[Callable[[str], Column]], Column]


def _sum_money(b):
    return lambda base: S.as_double(F.coalesce(base(b), S.dec("0.00")))


METRICS: dict[str, Metric] = {m.name: m for m in [
    Metric("revenue", "INR", ("order", "line"), "net revenue before tax", _sum_money("revenue")),
    Metric("revenue_with_tax", "INR", ("order",), "net revenue including tax", _sum_money("revenue_with_tax")),
    Metric("gross_revenue", "INR", ("order",), "gross bill value", _sum_money("gross_revenue")),
    Metric("discount", "INR", ("order",), "discount given", _sum_money("discount")),
    Metric("orders", "count", ("order", "line"), "distinct orders", lambda base: base("orders")),
    Metric("units", "count", ("order", "line"), "units sold",
           lambda base: F.coalesce(base("units"), F.lit(0)).cast("long")),
    Metric("aov", "INR", ("order", "line"), "average order value (ratio of sums)",
           lambda base: S.safe_ratio(F.coalesce(base("revenue"), S.dec("0.00")), base("orders"))),
    Metric("units_per_order", "ratio", ("order", "line"), "units per order (float)",
           lambda base: S.safe_ratio(F.coalesce(base("units"), F.lit(0)), base("orders"))),
    Metric("gross_margin", "INR", ("line",), "line net value less estimated cogs", _sum_money("gross_margin")),
    Metric("margin_pct", "pct", ("line",), "100 * margin / line revenue",
           lambda base: S.pct_of(F.coalesce(base("gross_margin"), S.dec("0.00")),
                                 F.coalesce(base("revenue"), S.dec("0.00")))),
]}

ORDER_DIMENSIONS = ("store_id", "store_name", "city", "region", "store_format", "channel", "month_key",
                    "order_date", "order_hour", "day_name", "day_type", "is_weekend", "festive_period",
                    "is_festive", "customer_segment", "promo_id")
LINE_ONLY_DIMENSIONS = ("sku_id", "sku_name", "category", "veg_nonveg")
PROMO_DIMENSIONS = ("promo_name", "promo_type")


def metric_columns(metrics: Iterable[str], grain: str) -> list[Column]:
    """Aggregate columns for the given metrics at one grain, aliased by name."""
    bases = ORDER_BASES if grain == "order" else LINE_BASES
    cache: dict[str, Column] = {}

    def base(name: str) -> Column:
        if name not in bases:
            raise ValueError(f"metric base {name!r} has no {grain}-grain form")
        if name not in cache:
            cache[name] = bases[name]()
        return cache[name]

    out = []
    for m in metrics:
        if m not in METRICS:
            raise ValueError(f"unknown metric {m!r}; known: {sorted(METRICS)}")
        if grain not in METRICS[m].grains:
            raise ValueError(f"metric {m!r} is not defined at {grain} grain")
        out.append(METRICS[m].finish(base).alias(m))
    return out


def choose_grain(metrics: Iterable[str], dimensions: Iterable[str]) -> str:
    metrics, dimensions = list(metrics), list(dimensions)
    needs_line = any(d in LINE_ONLY_DIMENSIONS for d in dimensions) or any(
        METRICS[m].grains == ("line",) for m in metrics if m in METRICS)
    if not needs_line:
        return "order"
    order_only = [m for m in metrics if m in METRICS and METRICS[m].grains == ("order",)]
    if order_only:
        raise ValueError(f"metrics {order_only} exist only at order grain and cannot be mixed "
                         "with line-grain dimensions or metrics")
    return "line"


def attach_dimensions(star: Star, fact: DataFrame, dimensions: Iterable[str]) -> DataFrame:
    """LEFT-join the dimension tables a query needs and the fact lacks.

    Dimension sides are broadcast only behind a row-count check.
    """
    need = [d for d in dimensions if d not in fact.columns]
    if any(d in PROMO_DIMENSIONS for d in need):
        promo = broadcast_if_small(star.dim_promotion.select("promo_id", *PROMO_DIMENSIONS),
                                   key=f"{star.source}/dim_promotion")
        fact = fact.join(promo, "promo_id", "left")
    store_cols = [d for d in need if d in ("store_name", "city", "region", "store_format")]
    if store_cols:
        store = broadcast_if_small(star.dim_store.select("store_id", *store_cols),
                                   key=f"{star.source}/dim_store")
        fact = fact.join(store, "store_id", "left")
    cal_cols = [d for d in need if d in ("day_name", "day_type", "is_weekend", "festive_period", "is_festive")]
    if cal_cols:
        cal = broadcast_if_small(star.dim_calendar.select(F.col("date").alias("order_date"), *cal_cols),
                                 key=f"{star.source}/dim_calendar")
        fact = fact.join(cal, "order_date", "left")
    if "customer_segment" in need:
        cust = star.dim_customer.select("customer_id", "customer_segment")
        fact = fact.join(cust, "customer_id", "left")
    missing = [d for d in dimensions if d not in fact.columns]
    if missing:
        raise ValueError(f"cannot resolve dimensions {missing}")
    return fact


MART_METRICS = {"revenue": "revenue_net", "gross_revenue": "revenue_gross", "orders": "orders", "units": "units"}
MART_FOR_DIMENSIONS = (
    ("mart_channel_month", ("channel", "month_key")),
    ("mart_city_month", ("city", "month_key")),
    ("mart_store_month", ("store_id", "store_name", "city", "region", "month_key")),
)


def _mart_route(metrics, dimensions, window, filters) -> str | None:
    """The mart a query can be answered from, or None (the rule of SURVEY section 4).

    Allowed when every metric is additive over the mart (or a ratio of such
    sums), every dimension and filter column is a mart key, and the window is
    whole months. Mart ``orders`` is COUNT(*) per group and is additive only
    because an order has exactly one store, city, channel and month.
    """
    from martlens.profile import month_end
    ok_metrics = set(MART_METRICS) | {"aov", "units_per_order"}
    if not set(metrics) <= ok_metrics:
        return None
    if window is not None and (window.start.day != 1 or window.end != month_end(window.end)):
        return None
    cols = set(dimensions) | set((filters or {}).keys())
    for name, keys in MART_FOR_DIMENSIONS:
        if cols <= set(keys):
            return name
    return None


def _from_mart(star: Star, mart_name: str, metrics, dimensions, window, filters) -> DataFrame:
    from martlens.operators.marts import build_marts
    m = build_marts(star)[mart_name]
    if window is not None:
        m = in_months(m, window.start_month, window.end_month)
    m = apply_filters(m, filters)
    sums = {k: F.sum(v) for k, v in MART_METRICS.items()}
    out = []
    for name in metrics:
        if name in ("revenue", "gross_revenue"):
            out.append(S.as_double(F.coalesce(sums[name], S.dec("0.00"))).alias(name))
        elif name == "orders":
            out.append(F.coalesce(sums["orders"], F.lit(0)).cast("long").alias(name))
        elif name == "units":
            out.append(F.coalesce(sums["units"], F.lit(0)).cast("long").alias(name))
        elif name == "aov":
            out.append(S.safe_ratio(F.coalesce(sums["revenue"], S.dec("0.00")), sums["orders"]).alias(name))
        else:
            out.append(S.safe_ratio(F.coalesce(sums["units"], F.lit(0)), sums["orders"]).alias(name))
    return m.groupBy(*dimensions).agg(*out) if dimensions else m.agg(*out)


def metric_query(star: Star, metrics: list[str], dimensions: list[str] | None = None,
                 window: TimeWindow | None = None, filters: dict[str, object] | None = None,
                 limit: int | None = None, order_by_metric: bool = True, use_marts: bool = False) -> DataFrame:
    """Metrics x dimensions x window x filters, ordered by the first metric (A-11); filtering
    before ranking (P-09); dimension attributes by LEFT joins (J-01).

    With ``use_marts`` the query is answered from a monthly mart when the
    routing rule allows it (a plain Python rule, not an optimizer rule).
    """
    dimensions = list(dimensions or [])
    if window is not None:  # a window outside the data is refused (P-13)
        star.profile.check_coverage(window, star.profile.data_start, star.profile.last_day)
    route = _mart_route(metrics, dimensions, window, filters) if use_marts else None
    if route is not None:
        out = _from_mart(star, route, metrics, dimensions, window, filters)
        if order_by_metric and metrics:
            out = out.orderBy(F.col(metrics[0]).desc(), *[F.col(d).asc_nulls_last() for d in dimensions])
        return out.limit(limit) if limit is not None else out
    grain = choose_grain(metrics, dimensions)
    fact = star.wide_orders if grain == "order" else star.wide_lines
    if window is not None:
        fact = in_window(fact, window.start, window.end)
    fact = attach_dimensions(star, fact, dimensions + list((filters or {}).keys()))
    fact = apply_filters(fact, filters)
    aggs = metric_columns(metrics, grain)
    out = fact.groupBy(*dimensions).agg(*aggs) if dimensions else fact.agg(*aggs)
    if order_by_metric and metrics:
        out = out.orderBy(F.col(metrics[0]).desc(), *[F.col(d).asc_nulls_last() for d in dimensions])
    if limit is not None:
        out = out.limit(limit)
    return out
