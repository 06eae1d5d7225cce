"""Profiling and aggregation (survey §2.3, C1–C39).

Every operator is a DataFrame → DataFrame transformation.  Statistics over
many columns share one scan: wide ``agg`` for moments and counts, and one
unpivot to (column, value) for quantiles, which are then exact and spread by
value range (see ``functions.ordered``).  Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.ordered import exact_quantiles, running
from ledgerlens.functions.skew import group_lookup
from ledgerlens.functions.stats import (clean_double, group_mode, half_even, safe_div, sample_kurtosis,
                                        sample_skewness)

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, DATETIME)]


def _is_missing(df: DataFrame, c: str) -> Column:
    """pandas ``isnull``: NULL, and NaN for floating columns."""
    dt = df.schema[c].dataType
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.col(c).isNull() | F.isnan(F.col(c))
    return F.col(c).isNull()


def melt(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (), name: str = "column",
         value: str = "value") -> DataFrame:
    """Wide → long with values as double (NaN/inf → NULL)."""
    cast = df.select(*ids, *[clean_double(c).alias(c) for c in cols])
    return cast.unpivot(list(ids), list(cols), name, value)


# ---------------------------------------------------------------- C1–C4, C7
def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row (``duplicated().sum()``); map-side combined."""
    return (df.groupBy(*df.columns).count()
              .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows")))


def basic_stats(df: DataFrame) -> DataFrame:
    """One row of table statistics (memory size has no meaning for a lazy table)."""
    cols = df.columns
    n_cells = F.count(F.lit(1)) * F.lit(len(cols))
    missing = reduce(lambda a, b: a + b, [F.sum(_is_missing(df, c).cast("long")) for c in cols])
    base = df.agg(F.count(F.lit(1)).alias("n_rows"), missing.alias("missing_values"),
                  n_cells.alias("_cells"))
    dup = duplicate_rows(df)
    return base.withColumn("duplicate_rows", dup.scalar()) \
        .select("n_rows", F.lit(len(cols)).alias("n_columns"),
                F.lit(len(numeric_columns(df))).alias("n_numeric_columns"),
                F.lit(len(categorical_columns(df))).alias("n_categorical_columns"),
                F.lit(len(datetime_columns(df))).alias("n_datetime_columns"),
                F.col("missing_values").cast("bigint").alias("missing_values"),
                F.round(safe_div(F.col("missing_values") * 100.0, "_cells"), 6).alias("missing_percentage"),
                "duplicate_rows")


def missing_summary(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """Per column missing count, percent (2 d.p., half-even) and type,
    sorted by percent descending then column name."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.sum(_is_missing(df, c).cast("long")).alias(f"m{i}") for i, c in enumerate(cols)])
    types = {c: t for c, t in df.dtypes}
    stack = "stack({}, {}) AS (column, data_type, missing_count)".format(
        len(cols), ", ".join(f"'{c}', '{types[c]}', m{i}" for i, c in enumerate(cols)))
    long = wide.selectExpr("_n", stack)
    out = long.select("column", F.coalesce("missing_count", F.lit(0)).cast("bigint").alias("missing_count"),
                      half_even(safe_div(F.col("missing_count") * 100.0, "_n"), 2).alias("missing_percentage"),
                      "data_type")
    if only_missing:
        out = out.where(F.col("missing_count") > 0)
    return out.orderBy(F.col("missing_percentage").desc(), "column")


def value_counts(df: DataFrame, col: str, top_n: int = 10) -> DataFrame:
    """Top-N non-NULL values by count (ties by value), share of all rows in %."""
    total = df.select(F.count(F.lit(1))).scalar()
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return (counts.withColumn("percentage", half_even(safe_div(F.col("count") * 100.0, total), 2))
                  .orderBy(F.col("count").desc(), F.col("value").asc()).limit(top_n))


def categorical_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct (non-NULL) and missing count per categorical column."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.countDistinct(c).alias(f"d{i}"), F.sum(F.col(c).isNull().cast("long")).alias(f"m{i}")]
    wide = df.agg(*aggs)
    stack = "stack({}, {}) AS (column, n_unique, n_missing)".format(
        len(cols), ", ".join(f"'{c}', d{i}, m{i}" for i, c in enumerate(cols)))
    return wide.selectExpr(stack).select("column", F.col("n_unique").cast("bigint").alias("n_unique"),
                                         F.coalesce("n_missing", F.lit(0)).cast("bigint").alias("n_missing"))


def quality_report(df: DataFrame, amount_col: str, date_col: str, as_of: str) -> DataFrame:
    """Completeness, uniqueness and validity in one row; ``as_of`` replaces "now"."""
    cols = df.columns
    missing = reduce(lambda a, b: a + b, [F.sum(_is_missing(df, c).cast("long")) for c in cols])
    dup = duplicate_rows(df).scalar()
    agg = df.agg(F.count(F.lit(1)).alias("n"), missing.alias("missing_cells"),
                 F.sum((F.col(amount_col) < 0).cast("long")).alias("negative_payments"),
                 F.sum((F.col(amount_col) == 0).cast("long")).alias("zero_payments"),
                 F.sum((F.col(date_col) > F.lit(as_of).cast("timestamp_ntz")).cast("long")).alias("future_dates"))
    n_cells = F.col("n") * F.lit(len(cols))
    return agg.select((n_cells).cast("bigint").alias("total_cells"),
                      F.col("missing_cells").cast("bigint").alias("missing_cells"),
                      F.round(100.0 - safe_div(F.col("missing_cells") * 100.0, n_cells), 6).alias("completeness_rate"),
                      dup.alias("duplicate_rows"),
                      F.round(safe_div(dup * 100.0, "n"), 6).alias("duplicate_percentage"),
                      F.coalesce("negative_payments", F.lit(0)).cast("bigint").alias("negative_payments"),
                      F.coalesce("zero_payments", F.lit(0)).cast("bigint").alias("zero_payments"),
                      F.coalesce("future_dates", F.lit(0)).cast("bigint").alias("future_dates"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """One ``basic_stats`` row per stage, stacked."""
    b = basic_stats(before).select(F.lit("before").alias("stage"), "n_rows", "n_columns", "missing_values",
                                   "duplicate_rows")
    a = basic_stats(after).select(F.lit("after").alias("stage"), "n_rows", "n_columns", "missing_values",
                                  "duplicate_rows")
    return b.unionByName(a)


# ---------------------------------------------------------------- C9, C10, C36
def describe(df: DataFrame, cols: Sequence[str], percentiles: Sequence[float] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
             ) -> DataFrame:
    """Pandas ``describe`` + extra percentiles + corrected skewness and
    excess kurtosis, one row per column.  Moments in one wide aggregate;
    quantiles exact, in one pass over the unpivoted columns."""
    long = melt(df, cols)
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.skewness("value").alias("_g1"), F.kurtosis("value").alias("_g2"))
    names = [f"p{int(round(p * 100))}" for p in percentiles]
    qs = exact_quantiles(long, "value", percentiles, ["column"], names, bounded_groups=True)
    n = F.col("count").cast("double")
    out = moments.join(qs, "column", "left")
    return out.select("column", F.col("count").cast("bigint").alias("count"), "mean", "std", "min", *names, "max",
                      sample_skewness(n, F.col("_g1")).alias("skewness"),
                      sample_kurtosis(n, F.col("_g2")).alias("kurtosis"))


def axis_ranges(df: DataFrame, cols: Sequence[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """1st–99th percentile range per column."""
    return exact_quantiles(melt(df, cols), "value", [lo, hi], ["column"], ["range_lo", "range_hi"], bounded_groups=True)


# ---------------------------------------------------------------- C11–C26
STAT_FUNCS = {
    "count": lambda v: F.count(v),
    "sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0)),           # T5: all-NULL sum is 0
    "mean": lambda v: F.avg(v),
    "std": lambda v: F.stddev_samp(v),                          # T2: n − 1
    "min": lambda v: F.min(v),
    "max": lambda v: F.max(v),
}


def group_stats(df: DataFrame, value: str, by: Sequence[str], stats: Sequence[str] = (
        "count", "sum", "mean", "median", "std", "min", "max"), digits: int | None = 2, dropna: bool = True,
        prefix: str = "") -> DataFrame:
    """Statistics of ``value`` per group.

    ``dropna=True`` drops NULL group keys like pandas ``groupby`` (T4);
    ``digits`` rounds half-even (T10).  Medians are exact and spread by range.
    """
    by = list(by)
    src = df.select(*by, clean_double(value).alias("_x"))
    if dropna and by:
        src = src.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by]))
    aggs = [STAT_FUNCS[s]("_x").alias(f"{prefix}{s}") for s in stats if s != "median"]
    out = src.groupBy(*by).agg(*aggs) if by else src.agg(*aggs)
    if "median" in stats:
        med = exact_quantiles(src, "_x", [0.5], by, [f"{prefix}median"])
        if by:
            med = med.select(*[F.col(c).alias(f"_m_{c}") for c in by], f"{prefix}median")
            cond = reduce(lambda a, b: a & b, [out[c].eqNullSafe(med[f"_m_{c}"]) for c in by])
            out = out.join(med, cond, "left").drop(*[f"_m_{c}" for c in by])
        else:
            out = out.withColumn(f"{prefix}median", med.select(f"{prefix}median").scalar())
    sel = []
    for s in stats:
        c = F.col(f"{prefix}{s}")
        if s == "count":
            sel.append(c.cast("bigint").alias(f"{prefix}{s}"))
        elif digits is not None:
            sel.append(half_even(c, digits).alias(f"{prefix}{s}"))
        else:
            sel.append(c.alias(f"{prefix}{s}"))
    return out.select(*by, *sel)


def top_groups(df: DataFrame, by: str, value: str, n: int = 20, order: str = "sum") -> DataFrame:
    """Groups ranked by total (or count), top n; ties by key."""
    g = df.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total_amount"), F.count(F.lit(1)).alias("n_payments"),
        F.avg(value).alias("mean_amount"))
    key = "total_amount" if order == "sum" else "n_payments"
    return g.orderBy(F.col(key).desc(), F.col(by).asc()).limit(n)


def recipient_rollup(df: DataFrame, keys: Sequence[str], amount: str = "amount", count_col: str = "number_of_payments",
                     payer: str = "payer_id", form: str = "form", nature: str = "nature",
                     modal: bool = True) -> DataFrame:
    """C25 (``modal=True``) / C26 (``modal=False``): amount statistics, summed
    counts and distinct payers per key, NULL keys kept (``dropna=False``).
    C25 adds the modal form and nature (smallest among ties, T7); C26 the
    number of distinct forms and natures."""
    keys = list(keys)
    stats = group_stats(df, amount, keys, digits=None, dropna=False, prefix="amount_")
    extra = [F.coalesce(F.sum(count_col), F.lit(0)).cast("bigint").alias("number_of_payments_sum"),
             F.countDistinct(payer).alias("payer_nunique")]
    if not modal:
        extra += [F.countDistinct(form).alias("form_nunique"), F.countDistinct(nature).alias("nature_nunique")]
    other = df.groupBy(*keys).agg(*extra)
    parts = [other]
    if modal:
        parts += [group_mode(df, keys, form, "form_mode"), group_mode(df, keys, nature, "nature_mode")]
    out = stats
    for i, part in enumerate(parts):
        # one row per group on both sides; groups without a value get NULL modes
        part = part.select(*[F.col(c).alias(f"_k{i}_{c}") for c in keys], *[e for e in part.columns if e not in keys])
        cond = reduce(lambda a, b: a & b, [out[c].eqNullSafe(part[f"_k{i}_{c}"]) for c in keys])
        out = out.join(part, cond, "inner" if i == 0 else "left").drop(*[f"_k{i}_{c}" for c in keys])
    return out


# ---------------------------------------------------------------- C15, C16, C22, C23, C38, C39
def calendar_month_stats(df: DataFrame, date_col: str, value: str) -> DataFrame:
    """Per calendar month (``to_period('M')``): sum, mean, count."""
    m = F.date_format(F.col(date_col), "yyyy-MM").alias("period")
    return (df.where(F.col(date_col).isNotNull()).groupBy(m)
              .agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total_amount"), F.avg(value).alias("mean_amount"),
                   F.count(F.lit(1)).alias("n_payments")))


WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def weekday_counts(df: DataFrame, date_col: str) -> DataFrame:
    """Payments per weekday in fixed Monday…Sunday order, absent days NULL.

    The 7-row day table is a calendar constant, so its size is fixed."""
    spark = df.sparkSession
    days = spark.range(7).select(F.col("id").cast("int").alias("day_index"),
                                 F.element_at(F.array(*[F.lit(d) for d in WEEKDAY_NAMES]),
                                              (F.col("id") + 1).cast("int")).alias("day_name"))
    counts = (df.where(F.col(date_col).isNotNull()).groupBy(F.weekday(date_col).alias("_d"))
                .agg(F.count(F.lit(1)).alias("n_payments")))
    return (F.broadcast(days).join(counts, F.col("day_index") == F.col("_d"), "left")
            .select("day_index", "day_name", "n_payments"))


def period_group_stats(df: DataFrame, period: str | Column, group: str, value: str) -> DataFrame:
    """C38 (per period × group) and C39 (payments per recipient-month)."""
    p = F.col(period) if isinstance(period, str) else period
    return (df.groupBy(p.alias("period"), F.col(group))
              .agg(F.count(F.lit(1)).alias("n_payments"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total_amount"),
                   F.avg(value).alias("mean_amount")))


# ---------------------------------------------------------------- C27, C28
def histogram(df: DataFrame, col: str, bins: int = 50, log10: bool = False, positive_only: bool = False
              ) -> DataFrame:
    """Equal-width histogram (numpy rules: last bin closed), every bin
    present.  Edges come from one min/max aggregate (a scalar subquery)."""
    x = clean_double(col)
    src = df.select(x.alias("_x")).where(F.col("_x").isNotNull())
    if positive_only or log10:
        src = src.where(F.col("_x") > 0)
    if log10:
        src = src.select(F.log10("_x").alias("_x"))
    rng = src.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    lo = rng.select("lo").scalar()
    hi = rng.select("hi").scalar()
    width = F.when(hi > lo, (hi - lo) / bins)
    b = F.when(width.isNull(), F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - lo) / width), F.lit(bins - 1))).cast("int")
    counts = src.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin_id"))
    lo_e = F.when(width.isNull(), lo - 0.5 + F.col("bin_id") / bins).otherwise(lo + F.col("bin_id") * width)
    hi_e = F.when(width.isNull(), lo - 0.5 + (F.col("bin_id") + 1) / bins).otherwise(lo + (F.col("bin_id") + 1) * width)
    return (edges.join(counts, F.col("bin_id") == F.col("bin"), "left")
            .select(F.col("bin_id").alias("bin"), lo_e.alias("bin_lo"), hi_e.alias("bin_hi"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
            .where(lo.isNotNull()))


# ---------------------------------------------------------------- C29, C37
def box_summary(df: DataFrame, value: str, group: str, log1p: bool = True) -> DataFrame:
    """Per group quartiles, 1.5·IQR whiskers (furthest values inside the
    fences) and outlier count, on log1p of positive values."""
    x = F.col(value).cast("double")
    src = df.where(x > 0).select(F.col(group), (F.log1p(x) if log1p else x).alias("_x"))
    src = src.where(F.col(group).isNotNull())
    q = exact_quantiles(src, "_x", [0.25, 0.5, 0.75], [group], ["q1", "median", "q3"])
    j = group_lookup(src, q, [group], "inner")
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    inside = (F.col("_x") >= lo_f) & (F.col("_x") <= hi_f)
    return j.groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_x"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_hi"),
        F.sum((~inside).cast("long")).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))


def outlier_counts(df: DataFrame, value: str, z: float = 3.0, pct: float = 0.99) -> DataFrame:
    """C37/E11 totals: IQR rule (1.5·IQR), |z| > 3 with population std after
    NULL → 0 (scipy ``zscore``), above the 99th percentile."""
    x = F.coalesce(clean_double(value), F.lit(0.0))
    src = df.select(x.alias("_x"))
    q = exact_quantiles(src, "_x", [0.25, 0.75, pct], [], ["q1", "q3", "qp"])
    m = src.agg(F.avg("_x").alias("mu"), F.stddev_pop("_x").alias("sd"))
    q1 = q.select("q1").scalar()
    q3 = q.select("q3").scalar()
    qp = q.select("qp").scalar()
    mu = m.select("mu").scalar()
    sd = m.select("sd").scalar()
    iqr = q3 - q1
    zc = F.abs(F.col("_x") - mu) / sd
    return src.agg(
        F.sum(((F.col("_x") < q1 - 1.5 * iqr) | (F.col("_x") > q3 + 1.5 * iqr)).cast("long")).alias("iqr_outliers"),
        F.sum(F.when(sd > 0, (zc > z).cast("long")).otherwise(0)).alias("zscore_outliers"),
        F.sum((F.col("_x") > qp).cast("long")).alias("percentile_outliers"))


# ---------------------------------------------------------------- C30, C31
def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r of every ordered pair, pairwise-complete, one aggregate."""
    cols = list(cols)
    src = df.select(*[clean_double(c).alias(c) for c in cols])
    aggs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i < j:
                both = F.col(a).isNotNull() & F.col(b).isNotNull()
                aggs.append(F.corr(F.when(both, F.col(a)), F.when(both, F.col(b))).alias(f"r_{i}_{j}"))
    wide = src.agg(*aggs) if aggs else src.agg(F.count(F.lit(1)).alias("_n"))
    entries = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            r = "CAST(1.0 AS DOUBLE)" if i == j else (f"r_{min(i, j)}_{max(i, j)}")
            entries.append(f"'{a}', '{b}', {r}")
    stack = f"stack({len(entries)}, {', '.join(entries)}) AS (feature_a, feature_b, r)"
    return wide.selectExpr(stack)


def strong_correlations(corr: DataFrame, cols: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """Pairs a<b (by position) with |r| > threshold, by |r| descending."""
    pos = {c: i for i, c in enumerate(cols)}
    idx = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(pos[c]))])
    return (corr.where(idx[F.col("feature_a")] < idx[F.col("feature_b")])
                .where(F.abs("r") > threshold)
                .orderBy(F.abs("r").desc(), "feature_a", "feature_b"))


# ---------------------------------------------------------------- C32–C35
def pivot_mean(df: DataFrame, row_col: str, col_col: str, value: str, top_rows: int = 10, top_cols: int = 10
               ) -> DataFrame:
    """Mean of value for the top rows × top columns (by count), long form.

    The two top-n lists have at most ``top_rows``/``top_cols`` rows: a bound
    set by the parameters, so they are broadcast for the semi joins."""
    def top(c, n):
        return (df.where(F.col(c).isNotNull()).groupBy(c).count()
                  .orderBy(F.col("count").desc(), F.col(c).asc()).limit(n).select(c))
    sel = df.join(F.broadcast(top(row_col, top_rows)), row_col, "left_semi") \
            .join(F.broadcast(top(col_col, top_cols)), col_col, "left_semi")
    return sel.groupBy(row_col, col_col).agg(F.avg(value).alias("mean_amount"))


def hierarchy_totals(df: DataFrame, path: Sequence[str], value: str) -> DataFrame:
    """Totals at every level of the path (``rollup``) with the level depth."""
    path = list(path)
    g = df.rollup(*path).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total_amount"),
                             F.count(F.lit(1)).alias("n_payments"), F.grouping_id().alias("_gid"))
    # depth = number of path columns that are not rolled up
    bits = [(F.col("_gid").bitwiseAND(1 << (len(path) - 1 - i)) == 0).cast("int") for i in range(len(path))]
    depth = reduce(lambda a, b: a + b, bits)
    return g.select(*path, "total_amount", "n_payments", depth.alias("level"))


def normalized_group_means(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Mean per group, min-max normalised across groups (range 0 → 0)."""
    means = df.groupBy(group).agg(*[F.avg(c).alias(c) for c in cols])
    bounds = means.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols])
    out = [group]
    for c in cols:
        lo = bounds.select(f"lo_{c}").scalar()
        hi = bounds.select(f"hi_{c}").scalar()
        out.append(F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0)).alias(c))
    return means.select(*out)


def category_index(df: DataFrame, col: str) -> DataFrame:
    """0-based index of each distinct value in value order (not appearance)."""
    distinct = df.where(F.col(col).isNotNull()).select(col).distinct().withColumn("_one", F.lit(1))
    r = running(distinct, [col], ["_one"], [], "sum", ["_idx"])
    return r.select(col, (F.col("_idx") - 1).cast("bigint").alias("category_index"))
