"""Sinks and bounded reads (S-13, S-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def preview(df: DataFrame, cap: int, order: list[Column]) -> DataFrame:
    """At most ``cap`` rows plus a ``truncated`` flag (S-15, L-04).

    ``cap + 1`` rows are taken (TakeOrderedAndProject keeps only that many per
    partition), the flag is whether the extra row exists.
    """
    top = df.orderBy(*order).limit(cap + 1)
    n = top.agg(F.count(F.lit(1)).alias("_n"))
    return (top.withColumn("_pos", F.row_number().over(Window.orderBy(*order)))
            .crossJoin(F.broadcast(n)).filter(F.col("_pos") <= cap)
            .withColumn("truncated", F.col("_n") > cap).drop("_pos", "_n"))


def round_floats(df: DataFrame, digits: int = 2) -> DataFrame:
    """Golden-answer normalisation (S-13, F-17): doubles rounded, NaN as NULL, dates ISO."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.when(F.isnan(c), F.lit(None)).otherwise(F.round(c, digits)).alias(f.name))
        elif isinstance(f.dataType, T.DecimalType):
            cols.append(F.round(c, digits).cast("double").alias(f.name))
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            cols.append(F.date_format(c, "yyyy-MM-dd" if isinstance(f.dataType, T.DateType)
                                      else "yyyy-MM-dd'T'HH:mm:ss").alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def golden_payload(question: str, results: dict[str, DataFrame]) -> DataFrame:
    """One JSON document per question: each result as an array of row objects (S-13).

    Results here are small (aggregated answers), so each is folded into one
    array column; the writer then emits one line per question.
    """
    parts = []
    for name, df in results.items():
        r = round_floats(df)
        parts.append(r.agg(F.collect_list(F.struct(*r.columns)).alias(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out.select(F.lit(question).alias("question"), F.to_json(F.struct(*results.keys())).alias("payload"))


def write_golden(payloads: DataFrame, path: str) -> None:
    payloads.coalesce(1).write.mode("overwrite").json(path)
