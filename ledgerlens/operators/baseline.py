"""A monitoring baseline that is kept, grows by batches and yields constraints
(survey §2.6, G20, G24; used by the intake, ST1).

The state of a batch is one small table.  A number falls into a signed
logarithmic bin (neighbouring bins 2 % apart) and a bin keeps count, mean, sum of
squared deviations, smallest and largest value; a text column keeps a count per
value.  Both merge without the rows: bins of any number of batches add up to
the bins of their union, so statistics, quantiles, constraints and violations
never read old data again.  A column has at most some 75,000 bins, whatever the
number of rows (the range of doubles); in practice a few hundred.

A batch is stored under its own name and replaced as a whole, so a retried or
corrected batch never counts twice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions.stats import safe_div
from ledgerlens.operators.profile import melt

BIN_RATIO = 1.02
#: moves the bin numbers of positive values above 0 (the smallest double has bin -37,594)
_SHIFT = 40_000

STATE = ("kind string, column string, bin int, category string, n long, mean double, m2 double, "
         "min double, max double")


def log_bin(x: Column) -> Column:
    """Number of the bin of ``x``: 0 for zero, growing with the value, NULL for NULL."""
    k = (F.floor(F.log(F.abs(x)) / math.log(BIN_RATIO)) + _SHIFT).cast("int")
    return F.when(x == 0, 0).when(x > 0, k).when(x < 0, -k)


def batch_state(df: DataFrame, numbers: Sequence[str], categories: Sequence[str] = ()) -> DataFrame:
    """The state of one batch.  Missing numbers (NULL, NaN, infinite) are counted
    under bin NULL, missing texts under category NULL.  One map-side aggregate for
    all numbers and one for all texts; columns that the batch lacks are left out
    (``violations`` reports them), an empty batch has no rows."""
    parts = []
    if have := [c for c in numbers if c in df.columns]:
        long = melt(df, have)
        parts.append(long.groupBy("column", log_bin(F.col("value")).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
            (F.var_pop("value") * F.count("value")).alias("m2"), F.min("value").alias("min"), F.max("value").alias("max"))
            .selectExpr("'number' AS kind", "column", "bin", "CAST(NULL AS STRING) AS category", "n", "mean", "m2", "min", "max"))
    if have := [c for c in categories if c in df.columns]:
        long = df.select(*[F.col(c).cast("string").alias(c) for c in have]).unpivot([], have, "column", "category")
        parts.append(long.groupBy("column", "category").agg(F.count(F.lit(1)).alias("n")).selectExpr(
            "'text' AS kind", "column", "CAST(NULL AS INT) AS bin", "category", "n", "CAST(NULL AS DOUBLE) AS mean",
            "CAST(NULL AS DOUBLE) AS m2", "CAST(NULL AS DOUBLE) AS min", "CAST(NULL AS DOUBLE) AS max"))
    if not parts:
        return df.sparkSession.createDataFrame([], STATE)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def store_batch(df: DataFrame, path: str, batch: str | int, numbers: Sequence[str], categories: Sequence[str] = ()) -> None:
    """Write the state of ``df`` under ``path`` as ``batch``, in place of what that
    batch held before."""
    batch_state(df, numbers, categories).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_state(spark: SparkSession, path: str, batches: Sequence[str | int] | None = None) -> DataFrame:
    """The stored state of all batches, or of ``batches`` (a partition filter)."""
    state = spark.read.schema(STATE + ", batch string").parquet(path)
    return state if batches is None else state.where(F.col("batch").isin(*[str(b) for b in batches]))


def merged_bins(state: DataFrame) -> DataFrame:
    """One row per (column, bin) of all batches of ``state``."""
    return state.where("kind = 'number'").groupBy("column", "bin").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        F.min("min").alias("min"), F.max("max").alias("max"))


def merged_stats(state: DataFrame, probs: Sequence[float] = tuple(i / 10 for i in range(1, 10))) -> DataFrame:
    """G20 from the stored state: column, count, missing, mean, std (sample), min,
    max and p10 ... p90.  All but the quantiles are exact; the quantile q is the mean
    of the bin that holds the value of rank ceil(q * count), so it is off by 2 % of
    that value at most.  The table takes the place of ``monitor.baseline_stats`` in
    ``feature_drift`` and ``psi``.  A column without a value keeps its row."""
    num = state.where("kind = 'number'")
    full = F.col("bin").isNotNull()
    n = F.sum(F.when(full, F.col("n")).otherwise(0))
    col = num.groupBy("column").agg(
        n.alias("count"), F.sum(F.when(full, 0).otherwise(F.col("n"))).alias("missing"),
        F.try_divide(F.sum(F.col("n") * F.col("mean")), n).alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"))
    # one row per column; deviations are taken from the common mean, so nothing cancels
    around = num.where(full).join(F.broadcast(col.select(F.col("column").alias("_c"), F.col("mean").alias("_m"))), F.col("column") == F.col("_c"))
    m2 = around.groupBy(F.col("column").alias("_c")).agg(
        F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_m")) ** 2).alias("_m2"))
    # a column's window holds its bins, not its rows
    w = Window.partitionBy("column").orderBy("bin")
    ranked = merged_bins(state).where(full).select(
        F.col("column").alias("_q"), "mean", F.sum("n").over(w).alias("_upto"), F.sum("n").over(Window.partitionBy("column")).alias("_n"))
    at = [F.min_by("mean", F.when(F.col("_upto") >= F.lit(p) * F.col("_n") - 1e-9, F.col("_upto"))).alias(f"p{round(p * 100)}") for p in probs]
    q = ranked.groupBy("_q").agg(*at)
    return (col.join(m2, F.col("column") == F.col("_c"), "left").join(q, F.col("column") == F.col("_q"), "left")
            .select("column", "count", "missing", "mean",
                    F.when(F.col("count") > 1, F.sqrt(F.col("_m2") / (F.col("count") - 1))).alias("std"), "min", "max",
                    *[f"p{round(p * 100)}" for p in probs]))


def constraints(state: DataFrame) -> DataFrame:
    """What the stored batches promise, one row per column: kind (number or text),
    completeness (share of rows with a value), is_non_negative, min, max (NULL for
    text) and n_categories (NULL for numbers).  The values of a text column are in
    the state itself; they are never gathered into one row."""
    given = F.when(F.col("kind") == "number", F.col("bin").isNotNull()).otherwise(F.col("category").isNotNull())
    number = F.col("kind") == "number"
    seen = state.groupBy("kind", "column", "bin", "category").agg(F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"))
    return seen.groupBy("column", "kind").agg(
        safe_div(F.sum(F.when(given, F.col("n")).otherwise(0)), F.sum("n")).alias("completeness"),
        F.when(number, F.min("min") >= 0).alias("is_non_negative"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.when(~number, F.count("category")).alias("n_categories"))


def violations(promised: DataFrame, base: DataFrame, current: DataFrame, slack: float = 0.0) -> DataFrame:
    """Where the batch with state ``current`` breaks the constraints
    ``promised`` of the state ``base``: column, check, expected, actual.

    completeness: a smaller share of rows with a value (by more than ``slack``);
    non_negative, below_min, above_max: the extremes; new_category: expected 0,
    actual the rows whose text the base never held; kind, missing_column, extra_column:
    the columns themselves (1 expected, 0 found, or the reverse)."""
    b = promised.select("column", *[F.col(c).alias(f"_{c}") for c in ("kind", "completeness", "is_non_negative", "min", "max")])
    j = b.join(constraints(current), "column", "full")
    both = F.col("_kind") == F.col("kind")

    def check(name: str, broken: Column, expected: Column, actual: Column) -> Column:
        return F.when(F.coalesce(broken, F.lit(False)), F.struct(
            F.lit(name).alias("check"), expected.cast("double").alias("expected"), actual.cast("double").alias("actual")))

    one, zero = F.lit(1), F.lit(0)
    each = F.array(
        check("missing_column", F.col("kind").isNull(), one, zero), check("extra_column", F.col("_kind").isNull(), zero, one),
        check("kind", F.col("_kind") != F.col("kind"), one, zero),
        check("completeness", both & (F.col("completeness") < F.col("_completeness") - slack), F.col("_completeness"), F.col("completeness")),
        check("non_negative", both & F.col("_is_non_negative") & ~F.col("is_non_negative"), zero, F.col("min")),
        check("below_min", both & (F.col("min") < F.col("_min")), F.col("_min"), F.col("min")),
        check("above_max", both & (F.col("max") > F.col("_max")), F.col("_max"), F.col("max")))
    broken = j.select("column", F.inline(F.filter(each, lambda c: c.isNotNull())))
    texts = lambda s: s.where("kind = 'text' AND category IS NOT NULL")
    new = texts(current).join(texts(base).select("column", "category").distinct(), ["column", "category"], "left_anti").join(
        texts(base).select("column").distinct(), "column", "left_semi")
    return broken.unionByName(new.groupBy("column").agg(F.sum("n").cast("double").alias("actual")).select(
        "column", F.lit("new_category").alias("check"), F.lit(0.0).alias("expected"), "actual"))
