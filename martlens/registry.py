"""Registered queries: name -> (Spark builder over (spark, sf_dir), DuckDB oracle SQL or None).

Every Spark builder reads the testdata tables through the star binding (or a
star written from them), so its work grows with the data. Result columns are
normalised at the edge: DECIMAL -> DOUBLE (exact sums, converted once).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from martlens.sources.bind_tpch import star_for

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def to_output(df: DataFrame) -> DataFrame:
    """Decimal columns become double; everything else passes through."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            cols.append(df[f.name].cast("double").alias(f.name))
        else:
            cols.append(df[f.name])
    return df.select(*cols)


class _LazyStar:
    """The star of a folder, bound (and written) only when a query first touches it;
    event-log and raw-text queries never pay for the build."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._args, self._star = (spark, sf_dir), None

    def __getattr__(self, item):
        if self._star is None:
            self._star = star_for(*self._args)
        return getattr(self._star, item)


def register(name: str, sql: str | None):
    def deco(fn: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return to_output(fn(_LazyStar(spark, sf_dir), spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = (run, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[QueryFn, str | None]]:
    # importing the query modules fills REGISTRY
    from martlens.queries import core, decline, quality, verify, text, logs, extra  # noqa: F401
    return REGISTRY
