"""Monthly marts (A-20 ... A-22, S-11), built over an INNER order-store join (J-02).

One group-by per mart over the order fact joined (inner) to the store
dimension. ``orders`` is COUNT(*) per group as in the source system; it sums
across groups only because an order has exactly one store, city, channel and
month. Marts are small (entities x months) and are stored with the star.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.functions import scalars as S
from martlens.operators.joins import broadcast_if_small
from martlens.sources.star import Star

MART_KEYS = {
    "mart_store_month": ["store_id", "store_name", "city", "region", "month_key"],
    "mart_city_month": ["city", "month_key"],
    "mart_channel_month": ["channel", "month_key"],
}


def _orders_with_store(star: Star) -> DataFrame:
    store = broadcast_if_small(star.dim_store.select("store_id", "store_name", "city", "region"),
                               key=f"{star.source}/dim_store")
    return star.fact_orders.join(store, "store_id", "inner")


def _mart(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("net_before_tax").alias("revenue_net"),
        F.sum("gross_bill_value").alias("revenue_gross"),
        F.sum("total_qty").cast("long").alias("units"),
    ).withColumn("aov", S.safe_ratio("revenue_net", "orders"))


def mart_store_month(star: Star) -> DataFrame:
    return _mart(_orders_with_store(star), MART_KEYS["mart_store_month"])


def mart_city_month(star: Star) -> DataFrame:
    return _mart(_orders_with_store(star), MART_KEYS["mart_city_month"])


def mart_channel_month(star: Star) -> DataFrame:
    # INNER join to the store dimension as in the source system: orders of
    # an unknown store are not counted in any mart.
    return _mart(_orders_with_store(star), MART_KEYS["mart_channel_month"])


def mart_builders() -> dict:
    return {"mart_store_month": mart_store_month, "mart_city_month": mart_city_month,
            "mart_channel_month": mart_channel_month}


def build_marts(star: Star) -> dict[str, DataFrame]:
    """The stored marts of a written star; built from the facts where there are none."""
    return star.marts or {name: build(star) for name, build in mart_builders().items()}
