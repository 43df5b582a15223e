"""Join helpers (J-*): size-checked broadcast, anti/orphan joins, tolerance join.

Broadcast is a promise that a side stays small. ``broadcast_if_small`` makes
that promise checked: it counts at most ``max_rows + 1`` rows of the side (a
cheap early-stopping job) and only then adds the hint; beyond the bound the
join is left to the planner (sort-merge, or AQE's runtime conversion).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_ROWS = 1_000_000

_size_memo: dict[tuple[int, str], bool] = {}


def is_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, key: str | None = None) -> bool:
    memo_key = (id(df.sparkSession), key) if key else None
    if memo_key and memo_key in _size_memo:
        return _size_memo[memo_key]
    small = df.limit(max_rows + 1).count() <= max_rows
    if memo_key:
        _size_memo[memo_key] = small
    return small


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                       key: str | None = None) -> DataFrame:
    """Broadcast hint behind a row-count check; unhinted when over the bound."""
    return F.broadcast(df) if is_small(df, max_rows, key) else df


def broadcast_literal(df: DataFrame) -> DataFrame:
    """Broadcast for frames built from literals (vocabularies, rule tables).

    Their size is fixed by the code that builds them, which is the bound.
    """
    return F.broadcast(df)


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str,
            allow_null: bool = False) -> DataFrame:
    """Child rows whose key has no parent row (J-05).

    A left-anti join keeps NULL child keys (NULL never matches), which is the
    ``allow_null=False`` behaviour; when NULL is allowed they are removed first.
    """
    c = child.filter(F.col(child_key).isNotNull()) if allow_null else child
    p = parent.select(F.col(parent_key).alias("__pk")).distinct()
    return c.join(p, F.col(child_key) == F.col("__pk"), "left_anti")


def without_match(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """NOT EXISTS (J-04)."""
    return left.join(right, on, "left_anti")


#: Rows of one key in one task of ``spread_join``; a fuller key is dealt to more.
HOT_BUCKET = 20_000


def spread_join(many: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``many`` and ``few`` where single keys may hold a large share of ``many``: a key with more than
    HOT_BUCKET rows is dealt to parts of about as many, and the rows of ``few`` visit each part. Both sides grow with
    the input, so they meet by shuffle: one that compresses to less than the broadcast bound may still fill a driver."""
    full = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT_BUCKET) \
        .select(*keys, F.ceil(F.col("__n") / HOT_BUCKET).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = many.join(full, keys, "left").withColumn(
        "__p", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("__parts")
    visits = few.join(full, keys, "left").withColumn("__p", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.hint("merge").join(visits, [*keys, "__p"]).drop("__p")


def tolerance_bucket(v: Column, rel_tol: float, abs_floor: float) -> Column:
    """A never falling function of v to whole numbers, whose steps are about as wide as the tolerance at v: steps
    of 2 * abs_floor up to where rel_tol * v reaches it, then steps of the ratio 1 + rel_tol."""
    edge, wide = abs_floor / rel_tol, 2 * abs_floor
    x = F.abs(v)
    step = F.when(x <= edge, F.floor(x / wide)).otherwise(
        F.lit(math.floor(edge / wide) + 1) + F.floor(F.log(F.greatest(x, F.lit(edge)) / edge) / math.log1p(rel_tol)))
    return F.when(v >= 0, step).otherwise(-1 - step).cast("long")


def tolerance_join(figures: DataFrame, values: DataFrame, key: str | list[str], x: str, v: str,
                   scales=(1.0,), rel_tol: float = 0.01, abs_floor: float = 0.5) -> DataFrame:
    """Range join (J-08): the figures' columns and ``scale`` with the values' other columns, where
    ``abs(x*scale - v) <= max(rel_tol*abs(v), abs_floor)`` within the same key.

    An equi-join on (key, bucket of v): a figure visits the three or four buckets that its tolerance reaches, a
    value lies in one, so no key is a group of all pairs, and a full (key, bucket) is spread
    (``spread_join``). Null figures and values match nothing.
    """
    keys = [key] if isinstance(key, str) else list(key)
    s = figures.where(F.col(x).isNotNull()).withColumn("scale", F.explode(F.array(*[F.lit(float(c)) for c in scales])))
    at, slack = F.col(x).cast("double") * F.col("scale"), 1e-9
    # v lies between these: x*scale -+ the floor, or divided by 1 +- rel_tol, whichever is further
    low = F.least(at - abs_floor, F.when(at > 0, at / (1 + rel_tol)).otherwise(at / (1 - rel_tol)))
    high = F.greatest(at + abs_floor, F.when(at > 0, at / (1 - rel_tol)).otherwise(at / (1 + rel_tol)))
    low, high = low - F.abs(low) * slack, high + F.abs(high) * slack
    visits = s.withColumn("__b", F.explode(F.sequence(tolerance_bucket(low, rel_tol, abs_floor),
                                                      tolerance_bucket(high, rel_tol, abs_floor))))
    held = values.where(F.col(v).isNotNull()).withColumn("__b", tolerance_bucket(F.col(v).cast("double"), rel_tol, abs_floor))
    near = F.abs(F.col(x).cast("double") * F.col("scale") - F.col(v)) <= F.greatest(F.abs(F.col(v)) * rel_tol, F.lit(abs_floor))
    return spread_join(held, visits, [*keys, "__b"]).where(near).drop("__b")


def first_non_null(*cols: Column) -> Column:
    return F.coalesce(*cols)
