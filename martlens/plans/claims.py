"""Claim audit: trace figures and identifiers in written answers back to result cells (N-01 ... N-07).

Inputs are two frames: ``answers(answer_id, text)`` and the long form of the
result cells each answer was written from, ``cells(answer_id, result_id,
column, num, str)``.

* Figures are pulled out of the text with built-in regex functions: dates and
  month keys are masked first; a figure directly followed by '%' is a rate and
  is skipped, as are the data's own years and anything below 100.
* A figure is supported by a value when, at some writer's scale (1, thousand,
  lakh, million, crore), ``|x*s - v| <= max(1% |v|, 0.5)``: the tolerance join
  of ``operators.joins``, an equi-join on (answer, bucket as wide as the
  tolerance) whatever the number of cells.
* Or by a difference of two values of one column: a join of v1 + x with v2 on
  steps as wide as the figure's tolerance.
* Identifiers (two to five capitals, two to six digits) are supported when
  contained in some string cell of the answer; containment is an equi-join on
  every identifier-shaped substring of the cells (suffixes of the capital run x
  prefixes of the digit run), so no per-pair string scan is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.operators.joins import spread_join, tolerance_join
from martlens.profile import Profile

# Fixed values of the figure audit (must equal the source system's).
NUMBER_RE = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
DATE_LIKE_RE = r"\d{4}-\d{2}(?:-\d{2})?"
IDENTIFIER_RE = r"\b[A-Z]{2,5}\d{2,6}\b"
UNSUPPORTED_PENALTY = 0.7
UNVERIFIED_CEILING = 0.4
ABS_FLOOR = 0.5


# --- N-01 -------------------------------------------------------------------------------------------
def long_cells(answer_id: Column | int, result_id: str, df: DataFrame) -> DataFrame:
    """Numeric and string cells of one result in long form (N-01); booleans excluded."""
    parts = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.BooleanType):
            continue
        if isinstance(f.dataType, T.NumericType):
            num, s = F.col(f"`{f.name}`").cast("double"), F.lit(None).cast("string")
        elif isinstance(f.dataType, T.StringType):
            num, s = F.lit(None).cast("double"), F.col(f"`{f.name}`")
        else:
            continue
        aid = answer_id if isinstance(answer_id, Column) else F.lit(answer_id)
        parts.append(F.struct(aid.cast("long").alias("answer_id"), F.lit(result_id).alias("result_id"),
                              F.lit(f.name).alias("column"), num.alias("num"), s.alias("str")))
    return df.select(F.explode(F.array(*parts)).alias("c")).select("c.*")


# --- N-02 -------------------------------------------------------------------------------------------
def figures(answers: DataFrame, profile: Profile) -> DataFrame:
    """Figure candidates: (answer_id, token, value) after masking, rate and year rules (N-02, F-13)."""
    masked = F.regexp_replace("text", DATE_LIKE_RE, " ")
    toks = F.regexp_extract_all(masked, F.lit(f"({NUMBER_RE})"), 1)
    seps = F.split(masked, NUMBER_RE, -1)
    df = answers.select("answer_id", toks.alias("_t"), seps.alias("_s"))
    df = df.select("answer_id", F.posexplode("_t").alias("_i", "token"), "_s")
    trailing = F.substring(F.element_at("_s", F.col("_i") + 2), 1, 1)
    value = F.regexp_replace("token", ",", "").cast("double")
    return (df.select("answer_id", "_i", "token", trailing.alias("_trail"), value.alias("value"))
            .filter((F.col("_trail") != "%") & ~F.col("token").isin(list(profile.data_years()))
                    & (F.col("value") >= profile.min_checked_magnitude))
            .select("answer_id", F.col("_i").cast("long").alias("position"), "token", "value"))


# --- N-03 -------------------------------------------------------------------------------------------
def supported_by_value(figs: DataFrame, cells: DataFrame, profile: Profile) -> DataFrame:
    """(answer_id, position) of figures some cell value supports at some scale (N-03, J-08)."""
    values = cells.filter(F.col("num").isNotNull()).select("answer_id", F.col("num").alias("v")).distinct()
    found = tolerance_join(figs.select("answer_id", "position", "value"), values, "answer_id", "value", "v",
                           profile.scale_factors, profile.number_match_tolerance, ABS_FLOOR)
    return found.select("answer_id", "position").distinct()


# --- N-04 -------------------------------------------------------------------------------------------
def supported_by_difference(figs: DataFrame, cells: DataFrame, profile: Profile) -> DataFrame:
    """(answer_id, position) of figures x with v2 - v1 within t of x for two values of one column (N-04).

    A difference join: with steps w of a power of two above 2t, v1 + x lies within t of v2 only if
    v2's step floor(v2 / w) is one of the two that v1 + x - t and v1 + x + t fall into. Values of a column are made
    distinct and enter once per step width that the answer's figures need; the join is an equi-join on
    (answer, result, column, width, step), so a long column is spread by its steps, and no window or
    list holds its values.
    """
    tol, own = profile.number_match_tolerance, ["answer_id", "result_id", "column"]
    col_vals = cells.filter(F.col("num").isNotNull()).select(*own, F.col("num").alias("v"))
    several = col_vals.groupBy(*own).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.count(F.lit(1)).alias("_n")) \
        .where("_n > 1")
    x = F.col("value")
    fig = figs.select("answer_id", "position", x.alias("x"), F.greatest(F.abs(x) * tol, F.lit(ABS_FLOOR)).alias("t")) \
        .withColumn("w", F.pow(F.lit(2.0), F.ceil(F.log2(2 * F.col("t")) + 0.01)))
    # a figure beyond the column's spread is no difference of it
    asked = fig.hint("merge").join(several, "answer_id").where(F.col("x") - F.col("t") <= (F.col("_hi") - F.col("_lo")) * (1 + 1e-9) + 1e-9)
    values = col_vals.distinct()
    step = lambda c: F.floor(c / F.col("w")).cast("long")
    near = F.col("x") + F.col("v")
    targets = spread_join(values, asked.select(*own, "position", "x", "t", "w"), own).select(
        *own, "position", "w", (near - F.col("t")).alias("lo"), (near + F.col("t")).alias("hi")) \
        .withColumn("s", F.explode(F.array_distinct(F.array(step(F.col("lo")), step(F.col("hi"))))))
    widths = asked.select(*own, "w").distinct()
    held = spread_join(values, widths, own).select(*own, "w", step(F.col("v")).alias("s"), "v")
    found = spread_join(held, targets, [*own, "w", "s"]).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    return found.select("answer_id", "position").distinct()


# --- N-05 / N-06 ---------------------------------------------------------------------------------
def unsupported_figures(answers: DataFrame, cells: DataFrame, profile: Profile) -> DataFrame:
    """Distinct unsupported figures per answer, as written (N-05)."""
    figs = figures(answers, profile)
    ok = supported_by_value(figs, cells, profile).unionByName(supported_by_difference(figs, cells, profile)).distinct()
    bad = figs.join(ok.hint("merge"), ["answer_id", "position"], "left_anti")
    return bad.groupBy("answer_id", "token").agg(F.min("position").alias("first_position"))


def _identifier_keys(cells: DataFrame) -> DataFrame:
    """Every identifier-shaped substring of the string cells, per answer."""
    runs = cells.filter(F.col("str").isNotNull()).select(
        "answer_id", F.explode(F.regexp_extract_all("str", F.lit("([A-Z]+)([0-9]+)"), 0)).alias("run")).distinct()
    runs = runs.select("answer_id", F.regexp_extract("run", "^([A-Z]+)", 1).alias("L"),
                       F.regexp_extract("run", "([0-9]+)$", 1).alias("D"))
    ls = F.sequence(F.lit(2), F.least(F.lit(5), F.length("L")))
    ds = F.sequence(F.lit(2), F.least(F.lit(6), F.length("D")))
    runs = runs.filter((F.length("L") >= 2) & (F.length("D") >= 2))
    keys = runs.select("answer_id", "L", "D", F.explode(ls).alias("nl")).select(
        "answer_id", "L", "D", "nl", F.explode(ds).alias("nd"))
    key = F.concat(F.col("L").substr(F.length("L") - F.col("nl") + 1, F.col("nl")), F.col("D").substr(F.lit(1), F.col("nd")))
    return keys.select("answer_id", key.alias("token")).distinct()


def identifiers(answers: DataFrame) -> DataFrame:
    return (answers.select("answer_id", F.explode(F.regexp_extract_all("text", F.lit(f"({IDENTIFIER_RE})"), 1))
                           .alias("token")).distinct())


def unsupported_identifiers(answers: DataFrame, cells: DataFrame) -> DataFrame:
    """Identifier tokens contained in no string cell of the answer's results (N-06)."""
    return identifiers(answers).join(_identifier_keys(cells).hint("merge"), ["answer_id", "token"], "left_anti")


# --- N-07 -------------------------------------------------------------------------------------------
def adjusted_confidence(answers: DataFrame, unsupported: DataFrame, base_col: str = "confidence",
                        failed_col: str = "verification_failed") -> DataFrame:
    """x0.7 (rounded to 2) when any figure is unsupported; capped at 0.4 when verification failed (N-07).

    Confidence is carried as DECIMAL so the rounding is exact.
    """
    flagged = unsupported.select("answer_id").distinct().withColumn("_flag", F.lit(True))
    a = answers.join(flagged.hint("merge"), "answer_id", "left")
    conf = F.col(base_col).cast("decimal(6,4)")
    pen = F.when(F.col("_flag"), F.round(conf * F.lit(0.7).cast("decimal(2,1)"), 2)).otherwise(conf)
    capped = F.when(F.col(failed_col), F.least(pen, F.lit(UNVERIFIED_CEILING).cast("decimal(6,4)"))).otherwise(pen)
    return a.select("answer_id", F.coalesce("_flag", F.lit(False)).alias("has_unsupported_figure"),
                    capped.cast("double").alias("adjusted_confidence"))
