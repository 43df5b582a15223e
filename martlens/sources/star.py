"""The star schema as a record of DataFrames, plus its writer and reader.

``Star`` holds lazy plans. ``write_star`` materialises it once as Parquet (facts
partitioned by ``month_key`` so window filters prune whole directories) into a
folder under the session's shared checkpoint directory; ``read_star`` reads it
back. Writing is the lineage cut: queries over a written star never replay the
source joins.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.profile import Profile
from martlens.session import ensure_checkpoint_dir

DIMENSIONS = ("dim_store", "dim_product", "dim_customer", "dim_promotion", "dim_calendar")
FACTS = ("fact_orders", "fact_order_lines")

# Columns of each role, in declared order (storage types in FIXTURES.md §1).
COLUMNS = {
    "dim_store": ["store_id", "store_name", "city", "state", "region", "store_format", "opening_date",
                  "city_price_index", "performance_factor", "status"],
    "dim_product": ["sku_id", "sku_name", "category", "veg_nonveg", "base_price_inr", "est_cogs_pct", "status"],
    "dim_customer": ["customer_id", "home_city", "customer_segment", "join_date"],
    "dim_promotion": ["promo_id", "promo_name", "promo_type", "start_date", "end_date", "applicable_days",
                      "applicability", "discount_pct", "min_bill_value", "max_discount_inr"],
    "dim_calendar": ["date", "year", "month", "month_no", "day_name", "day_type", "festive_period",
                     "month_key", "is_weekend", "is_festive"],
    "fact_orders": ["order_id", "order_datetime", "order_date", "order_hour", "store_id", "customer_id",
                    "channel", "promo_id", "total_qty", "gross_bill_value", "discount_amount",
                    "net_before_tax", "tax_amount", "net_revenue", "month_key", "day_name", "day_type",
                    "is_weekend", "festive_period", "is_festive"],
    "fact_order_lines": ["order_id", "sku_id", "quantity", "unit_price", "line_gross_value", "line_discount",
                         "line_net_value", "est_cogs", "line_margin"],
}
PRIMARY_KEYS = {
    "dim_store": ["store_id"], "dim_product": ["sku_id"], "dim_customer": ["customer_id"],
    "dim_promotion": ["promo_id"], "dim_calendar": ["date"], "fact_orders": ["order_id"],
    "mart_store_month": ["store_id", "month_key"], "mart_city_month": ["city", "month_key"],
    "mart_channel_month": ["channel", "month_key"],
}
# Order attributes denormalised onto the line fact (the "wide lines" frame).
LINE_ORDER_ATTRS = ["order_date", "month_key", "store_id", "channel"]
LINE_PRODUCT_ATTRS = ["sku_name", "category", "veg_nonveg"]
STORE_ATTRS = ["store_name", "city", "region", "store_format"]


@dataclass(frozen=True)
class Star:
    profile: Profile
    dim_store: DataFrame
    dim_product: DataFrame
    dim_customer: DataFrame
    dim_promotion: DataFrame
    dim_calendar: DataFrame
    fact_orders: DataFrame
    fact_order_lines: DataFrame
    # order fact with store attributes and customer segment attached (LEFT)
    wide_orders: DataFrame
    # line fact with order date/month/store/channel and product attributes (LEFT)
    wide_lines: DataFrame
    source: str = "lazy"
    # the wide order fact in two steps: the source columns it is derived from with their month_key, and the
    # derivation, row by row (lets the writer shuffle source columns only)
    orders_base: DataFrame | None = None
    widen_orders: Callable[[DataFrame], DataFrame] | None = None
    # the same for lines; the first step takes the order attributes of the *written* order
    # fact, which is not derived again
    lines_base: Callable[[DataFrame], DataFrame] | None = None
    widen_lines: Callable[[DataFrame], DataFrame] | None = None
    # stored monthly marts of a written star
    marts: dict[str, DataFrame] | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in DIMENSIONS + FACTS}

    def with_tables(self, **frames: DataFrame) -> "Star":
        # a replaced fact is written as given
        steps = {"wide_orders": ("orders_base", "widen_orders"), "wide_lines": ("lines_base", "widen_lines")}
        cut = {step: None for name in frames for step in steps.get(name, ())}
        return replace(self, **frames, **cut)

    def register_views(self, prefix: str = "") -> None:
        """Ad hoc SQL over the star (U-05): one temp view per role."""
        from martlens.operators.marts import build_marts

        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)
        for name, df in build_marts(self).items():
            df.createOrReplaceTempView(prefix + name)


#: Months that a task writes side by side; a task with more of them sorts the rest.
OPEN_MONTHS = 32


@contextmanager
def _open_months(spark: SparkSession) -> Iterator[None]:
    """Tasks write their months side by side instead of sorting (and spilling) their rows by month first."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, OPEN_MONTHS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _write_months(df: DataFrame, path: str, widen: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write a fact by month. Rows are shuffled as they come, columns derived from them are added after."""
    dealt = df.hint("rebalance", "month_key")
    with _open_months(df.sparkSession):
        (widen(dealt) if widen else dealt).write.mode("overwrite").partitionBy("month_key").parquet(path)


def write_star(star: Star, path: str | None = None) -> str:
    """Materialise the star once (S-05/S-06) and return its folder.

    Only the dimensions and the two *wide* facts are written; the narrow facts
    are projections of the wide ones (column pruning makes them free on read).
    The three monthly marts are then built from the written facts and stored too.
    Facts are written partitioned by ``month_key`` behind a REBALANCE hint: AQE
    hash-distributes rows by month and splits oversized months into
    advisory-sized partitions, so files stay evenly sized however skewed the
    months are. The folder lives under the shared checkpoint directory unless
    ``path`` is given. A rebuild goes to a new folder; ``build_star`` switches
    readers to it once the quality gate has passed.
    """
    from martlens.operators.marts import mart_builders

    spark = star.fact_orders.sparkSession
    root = path or os.path.join(ensure_checkpoint_dir(spark), f"star-{uuid.uuid4().hex[:12]}")
    for name in DIMENSIONS:
        getattr(star, name).write.mode("overwrite").parquet(os.path.join(root, name))
    if star.orders_base is not None:
        _write_months(star.orders_base, os.path.join(root, "wide_orders"), star.widen_orders)
    else:
        _write_months(star.wide_orders, os.path.join(root, "wide_orders"))
    if star.lines_base is not None:
        # attach order attributes from the order fact just written: the
        # order-customer join is not evaluated a second time
        written = spark.read.parquet(os.path.join(root, "wide_orders")).select(
            F.col("order_id").alias("__oid"), *LINE_ORDER_ATTRS)
        _write_months(star.lines_base(written), os.path.join(root, "wide_lines"), star.widen_lines)
    else:
        _write_months(star.wide_lines, os.path.join(root, "wide_lines"))
    written_star = read_star(spark, root, star.profile)
    for name, build in mart_builders().items():
        build(written_star).write.mode("overwrite").parquet(os.path.join(root, name))
    return root


def build_star(star: Star, expected: DataFrame, path: str | None = None) -> str:
    """Full build (S-12, S-06, Q-22): write the star to a staging folder, run the gate on what was
    written, store its report beside the tables, and raise unless every error check passes (but
    those the profile knows to fail). Returns the folder; readers are pointed to it only then, so
    a failed build leaves them on the last good one."""
    from martlens.plans import quality

    spark = star.fact_orders.sparkSession
    root = write_star(star, path)
    report = os.path.join(root, "quality_report")
    quality.full_report(read_star(spark, root, star.profile), expected).write.mode("overwrite").parquet(report)
    quality.enforce(spark.read.parquet(report), star.profile.known_failures)
    return root


def read_star(spark: SparkSession, root: str, profile: Profile) -> Star:
    frames = {n: spark.read.parquet(os.path.join(root, n)) for n in DIMENSIONS}
    frames |= {n: _facts(spark, root, n) for n in ("wide_orders", "wide_lines")}
    frames["fact_orders"] = frames["wide_orders"].select(*COLUMNS["fact_orders"])
    frames["fact_order_lines"] = frames["wide_lines"].select(*COLUMNS["fact_order_lines"], "month_key")
    marts = {n: os.path.join(root, n) for n in PRIMARY_KEYS if n.startswith("mart_")}
    if _has(spark, marts["mart_store_month"]):
        return Star(profile=profile, source=root, marts={n: spark.read.parquet(p) for n, p in marts.items()}, **frames)
    return Star(profile=profile, source=root, **frames)


def _facts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A fact of a written star. A refreshed one holds its changed months, the others stay where they were
    written: reading takes them from there, by month folder."""
    refreshed = os.path.join(root, "refreshed_months")
    if not _has(spark, refreshed):
        return spark.read.parquet(os.path.join(root, name))
    rows = spark.read.parquet(refreshed).collect()  # one row per changed month
    base, months = rows[0].base, [r.month_key for r in rows]
    old = _facts(spark, base, name)
    new = spark.read.schema(old.schema).parquet(os.path.join(root, name))
    return old.where(~_in_months(months)).select(*new.columns).unionByName(new)


def _in_months(months: list) -> Column:
    """Whether a row's month is one of them; None stands for rows without a month."""
    known = [m for m in months if m is not None]
    hit = F.col("month_key").isin(known) if known else F.lit(False)
    return F.coalesce(hit, F.lit(None in months))


def month_digests(star: Star) -> DataFrame:
    """(fact, month_key, rows, digest): a digest of every month's rows, whatever their order; one aggregation per fact."""
    parts = []
    for name in ("wide_orders", "wide_lines"):
        df = getattr(star, name)
        h = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns))).cast("decimal(20,0)")
        parts.append(df.groupBy("month_key").agg(F.count(F.lit(1)).alias("rows"), F.sum(h).alias("digest"))
                     .select(F.lit(name).alias("fact"), "month_key", "rows", "digest"))
    return parts[0].unionByName(parts[1])


def refresh_star(star: Star, root: str, expected: DataFrame) -> tuple[str, list]:
    """Incremental rebuild (S-06, S-11, S-12): a star that differs from the written one in ``root`` in some months.

    Months whose digests differ are written to a new folder with the dimensions; marts take their rows
    anew and keep the others. The other months stay in the files of ``root``, which is never
    touched. The gate runs on the whole refreshed star; (new folder, months) is returned, to which readers
    switch by one path, or the gate's error is raised and they stay on the last good star.
    """
    from martlens.operators.marts import mart_builders
    from martlens.plans import quality

    spark = star.fact_orders.sparkSession
    before = month_digests(read_star(spark, root, star.profile)).withColumnsRenamed({"rows": "_r", "digest": "_d"})
    after, old = month_digests(star).alias("a"), before.alias("b")
    differs = after.join(old, (F.col("a.fact") == F.col("b.fact")) & F.col("a.month_key").eqNullSafe(F.col("b.month_key")), "full_outer") \
        .where(~(F.col("a.rows").eqNullSafe(F.col("b._r")) & F.col("a.digest").eqNullSafe(F.col("b._d"))))
    months = sorted({r.m for r in differs.select(F.coalesce("a.month_key", "b.month_key").alias("m")).collect()},
                    key=lambda m: (m is not None, m))
    if not months:
        return root, []
    new = os.path.join(ensure_checkpoint_dir(spark), f"star-{uuid.uuid4().hex[:12]}")
    for name in DIMENSIONS:
        getattr(star, name).write.parquet(os.path.join(new, name))
    for name in ("wide_orders", "wide_lines"):
        _write_months(getattr(star, name).where(_in_months(months)), os.path.join(new, name))
    spark.createDataFrame([(root, m) for m in months], "base string, month_key string").coalesce(1).write.parquet(
        os.path.join(new, "refreshed_months"))
    whole = read_star(spark, new, star.profile)
    part = whole.with_tables(fact_orders=whole.fact_orders.where(_in_months(months)))
    for name, build in mart_builders().items():
        kept = spark.read.parquet(os.path.join(root, name)).where(~_in_months(months))
        build(part).unionByName(kept).write.parquet(os.path.join(new, name))
    report = os.path.join(new, "quality_report")
    quality.full_report(read_star(spark, new, star.profile), expected).write.parquet(report)
    quality.enforce(spark.read.parquet(report), star.profile.known_failures)
    return new, months


def _has(spark: SparkSession, path: str) -> bool:
    """Whether a table exists (it does not yet while the marts themselves are built)."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


def row_counts(star: Star) -> DataFrame:
    """Row count per table as one frame (S-12 report), one job for all tables."""
    spark = star.fact_orders.sparkSession
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows")
             for n, df in star.tables().items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def table_names() -> list[str]:
    return [f.name for f in fields(Star) if f.name in DIMENSIONS + FACTS]
