"""Column expressions shared by the operators (all JVM-side built-ins).

Spark 4 runs with ANSI semantics on: division by zero and bad casts raise.
Every expression here is total — it returns NULL instead of failing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL when b is 0 or NULL (pandas gives inf/NaN; both end as NULL here)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clean_double(c: str | Column) -> Column:
    """NaN and ±inf → NULL (B17, T24).  NaN is above every number here, so one
    comparison tells; nested uses repeat the column's expression."""
    x = col(c).cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def lenient_double(c: str | Column) -> Column:
    """pandas ``to_numeric(errors='coerce')`` (B3).  A text with the suffix of a Java
    literal ("12d", "3.5F") is no number."""
    x = col(c)
    suffixed = F.when(F.typeof(x) == "string", F.rtrim(x.cast("string")).rlike("[dDfF]$")).otherwise(False)
    return clean_double(F.when(~suffixed, x).try_cast("double"))


def lenient_timestamp(c: str | Column, fmt: str = "MM/dd/yyyy") -> Column:
    """pandas ``to_datetime(errors='coerce')`` for one format."""
    x = col(c)
    return F.try_to_timestamp(x.cast("string"), F.lit(fmt))


def weekday_mon0(c: str | Column) -> Column:
    """Monday = 0 … Sunday = 6 (T6); ``dayofweek`` would be Sunday = 1."""
    return F.weekday(col(c))


def half_even(c: str | Column, digits: int = 2) -> Column:
    """NumPy/pandas ``round`` (T10): scale by 10^d in double arithmetic, round
    half to even to an integer, scale back — the same steps as ``np.round``.
    (``bround(x, d)`` alone rounds the exact binary value of x, which differs
    from NumPy when x·10^d lands exactly on .5 after the multiply.)"""
    scale = float(10 ** digits)
    return F.bround(col(c).cast("double") * F.lit(scale), 0) / F.lit(scale)


def sample_skewness(n: Column, g1: Column) -> Column:
    """Bias-corrected G1 from Spark's population skewness g1."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-corrected excess G2 from Spark's population excess kurtosis g2."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def unit_hash(key: str | Column, seed: int | str = 42) -> Column:
    """Deterministic value in [0, 1) from md5(key ‖ '|' ‖ seed).

    First 8 hex digits → integer / 2^32.  Independent of partitioning and
    repeatable in DuckDB as ``('0x' || substr(md5(k || '|' || seed), 1, 8))::BIGINT / 4294967296``.
    """
    h = F.md5(F.concat_ws("|", col(key).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def unit_hash_sql(key_sql: str, seed: int | str = 42) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', CAST({key_sql} AS VARCHAR), '{seed}')), 1, 8))::BIGINT / 4294967296.0)"


def group_mode(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Most frequent non-NULL ``value`` per ``keys`` group, the smallest among
    ties (T7, pandas ``mode()[0]``); one row per group that has a value.

    Spark's ``mode`` merges a value→count map of the whole group in one
    task.  Here rows are counted per (group, value) with a map-side combine,
    and each group keeps ``min_by(value, (−count, value))``, itself a partial
    aggregate, so no task holds more than one row per group: a group with a
    third of the rows or millions of distinct values splits like any other."""
    keys = list(keys)
    counts = (df.where(F.col(value).isNotNull())
                .groupBy(*keys, F.col(value).alias("_mv")).agg(F.count(F.lit(1)).alias("_mc")))
    rank = F.struct((-F.col("_mc")).alias("_n"), F.col("_mv").alias("_v"))
    return counts.groupBy(*keys).agg(F.min_by("_mv", rank).alias(out))
