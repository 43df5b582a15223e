"""Source scans and edge normalisation (S-01 ... S-04).

Sources are read with Spark's own readers so that projection and filters reach
the file scan. Normalisation happens once at the edge: header names are
trimmed and lower-cased, text blanks and floating NaN become real NULLs, and
dates/timestamps are parsed with ``try_`` functions (ANSI mode would raise on a
malformed value; the quality gate counts such NULLs instead).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_source(spark: SparkSession, path: str, fmt: str = "parquet",
                schema: T.StructType | None = None, **options) -> DataFrame:
    """Read one flat source and normalise its header (S-01).

    ``schema`` is applied by the reader for text formats (no inference at
    scale); Parquet carries its own.
    """
    reader = spark.read.format(fmt)
    if schema is not None and fmt != "parquet":
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
    for k, v in options.items():
        reader = reader.option(k, v)
    return normalise_header(reader.load(path))


def normalise_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def to_iso_date(c: Column | str, fmt: str | None = None) -> Column:
    """Date normalisation (S-02): NULL stays NULL, garbage becomes NULL."""
    col = F.col(c) if isinstance(c, str) else c
    if fmt:
        return F.try_to_date(col.cast("string"), fmt)
    return F.to_date(col) if not isinstance(c, str) else F.try_to_date(col.cast("string"))


def to_iso_datetime(c: Column | str, fmt: str | None = None) -> Column:
    """Timestamp normalisation (S-03)."""
    col = F.col(c) if isinstance(c, str) else c
    if fmt:
        return F.try_to_timestamp(col.cast("string"), F.lit(fmt))
    return F.try_to_timestamp(col.cast("string"))


def nulls_to_none(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """NaN / blank text -> NULL (S-04) so nullable keys hold real NULLs."""
    col = F.col(c) if isinstance(c, str) else c
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(col), F.lit(None)).otherwise(col)
    if isinstance(dtype, T.StringType) or dtype is None:
        return F.nullif(F.trim(col.cast("string")), F.lit(""))
    return col


def normalise_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: nulls_to_none(c, types[c]) for c in columns})
