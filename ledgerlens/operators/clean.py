"""Projection, filtering and cleaning (survey §2.2, B1–B25).

Statistics that drive a fill or a clip (medians, quartiles, modes) are
computed once for all columns, exactly and spread over the cluster; the
resulting parameter table has one row per column, so it is collected and
enters the row expressions as literals (the cleaned table stays one lazy plan
without nested subqueries).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.ordered import exact_quantiles, running, wide_quantiles
from ledgerlens.functions.skew import group_lookup
from ledgerlens.functions.stats import clean_double, group_mode, lenient_double, lenient_timestamp, unit_hash
from ledgerlens.operators.profile import numeric_columns
from ledgerlens.session import TASK_ROWS, cut_lineage, fitted_params, shuffle_partitions, sized_partitions

# Fixed values that must equal the reference's behaviour.
INDICATOR_MAP = {"Yes": 1, "Y": 1, "No": 0, "N": 0, "Unknown": 0}
MODE_FILLED = ("covered_recipient_type", "nature_of_payment_or_transfer_of_value")
ID_EXCLUDE_PATTERNS = ("_id", "_code", "_province", "_postal")


# ---------------------------------------------------------------- B1, B2, B21
def select_present(df: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """B1: keep the wanted columns that exist; report the absent names."""
    have = [c for c in wanted if c in df.columns]
    return df.select(*have), [c for c in wanted if c not in df.columns]


def first_present(df: DataFrame, candidates: Sequence[str], default: str | None = None) -> str | None:
    """B2: first candidate column name present in the table."""
    lower = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c in df.columns:
            return c
        if c.lower() in lower:
            return lower[c.lower()]
    return default


def numeric_features(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns that are not ids or codes."""
    return [c for c in numeric_columns(df)
            if c not in exclude and not any(p in c.lower() for p in ID_EXCLUDE_PATTERNS)]


# ---------------------------------------------------------------- B3–B8, B17, B23
def indicator(c: str | Column) -> Column:
    """Yes/Y → 1, No/N/Unknown/unmapped/NULL → 0."""
    x = F.col(c) if isinstance(c, str) else c
    ones = [k for k, v in INDICATOR_MAP.items() if v == 1]
    return F.when(x.isin(*ones), F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def convert_types(df: DataFrame, amount: str | None = "amount", date: str | None = "date_of_payment",
                  count: str | None = "number_of_payments", state: str | None = "recipient_state",
                  indicators: Sequence[str] = (), date_format: str = "MM/dd/yyyy") -> DataFrame:
    """Lenient numeric cast, absolute amount (T23: negatives survive as
    positives), lenient date parse (typed dates pass through), count NULL → 1,
    indicators → 0/1, state upper-cased and trimmed."""
    out = df
    if amount and amount in df.columns:
        out = out.withColumn(amount, F.abs(lenient_double(amount)))
    if date and date in df.columns and isinstance(df.schema[date].dataType, T.StringType):
        out = out.withColumn(date, lenient_timestamp(date, date_format))
    if count and count in df.columns:
        out = out.withColumn(count, F.coalesce(lenient_double(F.col(count)).cast("bigint"), F.lit(1)).cast("bigint"))
    for c in indicators:
        if c in df.columns:
            out = out.withColumn(c, indicator(c))
    if state and state in df.columns:
        out = out.withColumn(state, F.trim(F.upper(F.col(state))))
    return out


def inf_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """±inf and NaN → NULL in floating columns."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: clean_double(c) for c in cols})


def positive_only(df: DataFrame, col: str) -> DataFrame:
    """Rows with a non-NULL positive value."""
    return df.where(F.col(col).isNotNull() & (F.col(col) > 0))


# ---------------------------------------------------------------- B9–B13
def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Exact quantiles of many columns in the same scans: rows (column, *names); a
    column without values has no row."""
    cols = list(cols)
    found = wide_quantiles(df.select(*[clean_double(c).alias(c) for c in cols]), cols, probs)
    schema = T.StructType([T.StructField("column", T.StringType())] + [T.StructField(n, T.DoubleType()) for n in names])
    return df.sparkSession.createDataFrame([(c, *found[c]) for c in cols if found[c]], schema)


def _fitted(stats: DataFrame) -> dict:
    """{column: Row} of a per-column statistics table (bounded by the column count)."""
    return {r["column"]: r for r in fitted_params(stats)}


def _lit(v) -> Column:
    return F.lit(None).cast("double") if v is None else F.lit(float(v))


def median_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL/NaN → column median (exact, all columns in one pass)."""
    cols = list(cols)
    if not cols:
        return df
    med = _fitted(column_quantiles(df, cols, [0.5], ["median"]))
    return df.withColumns({c: F.coalesce(clean_double(c), _lit(med[c]["median"] if c in med else None)) for c in cols})


def mode_value(df: DataFrame, col: str) -> Column:
    """Most frequent non-NULL value, smallest among ties (T7), as a scalar."""
    return group_mode(df, [], col, "_mode").scalar()


def mode_fill(df: DataFrame, cols: Sequence[str], default: str = "Unknown") -> DataFrame:
    """NULL → modal value (``default`` when the column is all NULL)."""
    return df.withColumns({c: F.coalesce(F.col(c), mode_value(df, c), F.lit(default)) for c in cols})


def constant_fill(df: DataFrame, cols: Sequence[str], value="Unknown") -> DataFrame:
    """B12."""
    return df.na.fill(value, subset=list(cols))


def forward_backward_fill(df: DataFrame, col: str, order_cols: Sequence[str], group_cols: Sequence[str] = ()
                          ) -> DataFrame:
    """Ffill then bfill of ``col`` along an explicit order (T22: file order
    is not a thing to rely on).  Spread by range, no single-partition window.
    Numeric and timestamp columns are supported (timestamps pass as epoch
    microseconds)."""
    if not order_cols:
        raise ValueError("forward fill needs an explicit order column")
    dt = df.schema[col].dataType
    is_ts = isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))
    v = F.unix_micros(F.col(col).cast("timestamp")) if is_ts else F.col(col).cast("double")
    group_cols = list(group_cols)
    spare = [] if col in (*order_cols, *group_cols) else [col]           # the column itself need not travel
    src = df.withColumn("_ff_v", v).drop(*spare)
    fwd = running(src, list(order_cols), ["_ff_v"], group_cols, "last", ["_ff_f"], sized_partitions(df.sparkSession, df))
    # rows before a group's first value take that value: no second ordered pass
    known = src.select(*group_cols, F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)],
                                             F.col("_ff_v").cast("double").alias("_ff_b")).alias("_ff_a")).where(~F.isnan("_ff_a._ff_b"))
    first = known.where(F.col("_ff_a._ff_b").isNotNull()).groupBy(*group_cols).agg(F.min("_ff_a")["_ff_b"].alias("_ff_b"))
    if group_cols:
        bwd = group_lookup(fwd, first, group_cols)
    else:
        bwd = fwd.withColumn("_ff_b", _lit(fitted_params(first, 1)[0]["_ff_b"]))
    filled = F.coalesce("_ff_f", "_ff_b")
    if is_ts:
        filled = F.timestamp_micros(filled.cast("bigint"))
        if isinstance(dt, T.TimestampNTZType):
            filled = filled.cast("timestamp_ntz")
        elif isinstance(dt, T.DateType):
            filled = filled.cast("date")
    else:
        filled = filled.cast(dt)
    return bwd.withColumn(col, filled).drop("_ff_v", "_ff_f", "_ff_b").select(*df.columns)


def fill_missing(df: DataFrame, mode_cols: Sequence[str] = MODE_FILLED) -> DataFrame:
    """Strings → mode for ``mode_cols`` else "Unknown"; numbers → 0 when
    the name holds count/number, else the median.  T19: this runs before the
    id filter, so string ids are never NULL afterwards."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    nums = numeric_columns(df)
    zero = [c for c in nums if "count" in c.lower() or "number" in c.lower()]
    med = [c for c in nums if c not in zero]
    out = mode_fill(df, [c for c in strings if c in mode_cols])
    out = constant_fill(out, [c for c in strings if c not in mode_cols], "Unknown")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in zero}) if zero else out
    if med:
        stats = _fitted(column_quantiles(df, med, [0.5], ["median"]))
        out = out.withColumns({c: F.coalesce(clean_double(c), _lit(stats[c]["median"] if c in stats else None))
                               .cast(df.schema[c].dataType) for c in med})
    return out


# ---------------------------------------------------------------- B14–B16
def drop_duplicates(df: DataFrame) -> DataFrame:
    """Distinct rows (hash aggregate with map-side combine: a row copied a
    million times collapses before the shuffle)."""
    return df.dropDuplicates()


def dedup_by_record(df: DataFrame, key: str, latest: str) -> DataFrame:
    """One row per ``key``, the one with the largest ``latest`` (ties by
    the remaining columns).  An aggregate, not a window, so a key with a
    third of all rows is reduced map-side instead of sorted in one task."""
    rest = [c for c in df.columns if c not in (key, latest)]
    best = F.max(F.struct(F.col(latest).alias("_o"), *[F.col(c) for c in rest])).alias("_b")
    g = df.groupBy(key).agg(best)
    return g.select(key, F.col("_b._o").alias(latest), *[F.col(f"_b.{c}").alias(c) for c in rest]).select(*df.columns)


def drop_invalid(df: DataFrame, amount: str = "amount", date: str = "date_of_payment",
                 record_key: str | None = "recipient_id") -> DataFrame:
    """Distinct rows with amount > 0, a date and (optionally) a key."""
    out = drop_duplicates(df).where(F.col(amount) > 0).where(F.col(date).isNotNull())
    if record_key:
        out = out.where(F.col(record_key).isNotNull())
    return out


def retention_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """B16 report: records before/after, removed, retention %."""
    b = before.select(F.count(F.lit(1))).scalar()
    a = after.select(F.count(F.lit(1))).scalar()
    spark = before.sparkSession
    return spark.range(1).select(b.alias("records_before"), a.alias("records_after"),
                                 (b - a).alias("records_removed"),
                                 F.round(F.try_divide(a * 100.0, b), 6).alias("retention_pct"))


# ---------------------------------------------------------------- quarantine
def strict_rules(amount: str = "amount", date: str = "date_of_payment", count: str | None = "number_of_payments",
                 record_key: str | None = "recipient_id", date_format: str = "MM/dd/yyyy") -> dict[str, Column]:
    """Reasons to reject a raw text row, by name: a field that is missing (NULL or
    blank), cannot be read, or holds an amount of 0.  The lenient path fills or
    corrects such rows; the strict one sets them aside."""
    def blank(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))

    number, day = lenient_double(amount), lenient_timestamp(date, date_format)
    rules = {"amount_missing": blank(amount), "amount_unreadable": ~blank(amount) & number.isNull(), "amount_zero": number == 0,
             "date_missing": blank(date), "date_unreadable": ~blank(date) & day.isNull()}
    if count:
        rules["count_unreadable"] = ~blank(count) & lenient_double(count).isNull()
    if record_key:
        rules["key_missing"] = blank(record_key)
    return rules


def quarantine(df: DataFrame, path: str, rules: dict[str, Column], approved: dict[str, DataFrame] | None = None
               ) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows), written in one pass under ``path`` by decision,
    so each side reads only its own files.

    ``rules`` name the conditions that reject a row; ``approved`` gives per column a
    one-column list of allowed values (B22: a value not on it gives
    ``<column>_not_listed``; NULL is not listed either).  Rejected rows carry all
    their reasons (``reasons``, in the order of the rules).  Equal rows become one row
    with ``n_copies`` on both sides, counted map-side, so nothing is lost and a row
    copied a million times is one row in the shuffle.  The names reasons, n_copies
    and accepted must be free."""
    if clash := {"reasons", "n_copies", "accepted"} & set(df.columns):
        raise ValueError(f"reserved column names: {sorted(clash)}")
    rules, rows = dict(rules), df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n_copies"))
    for i, (c, codes) in enumerate((approved or {}).items()):
        listed = codes.select(F.col(codes.columns[0]).alias(f"_code{i}")).where(F.col(f"_code{i}").isNotNull()).distinct()
        rows = rows.join(listed, F.col(c) == F.col(f"_code{i}"), "left")
        rules[f"{c}_not_listed"] = F.col(f"_code{i}").isNull()
    named = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()])
    tagged = rows.withColumn("reasons", F.filter(named, lambda r: r.isNotNull())).select(*df.columns, "n_copies", "reasons")
    tagged.withColumn("accepted", F.size("reasons") == 0).write.mode("overwrite").partitionBy("accepted").parquet(path)
    spark = df.sparkSession
    back = spark.read.schema(T.StructType([*tagged.schema.fields, T.StructField("accepted", T.BooleanType())])).parquet(path)
    return back.where("accepted").drop("accepted", "reasons"), back.where("NOT accepted").drop("accepted")


def quarantine_report(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows per outcome: accepted, rejected, duplicates (copies beyond the first on
    either side) and one line per reason; a row with two reasons counts in both."""
    both = accepted.select("n_copies", F.lit("accepted").alias("outcome")).unionByName(
        rejected.select("n_copies", F.lit("rejected").alias("outcome")))
    reasons = rejected.select("n_copies", F.explode("reasons").alias("outcome"))
    copies = both.select((F.col("n_copies") - 1).alias("n_copies"), F.lit("duplicate").alias("outcome"))
    return both.unionByName(reasons).unionByName(copies).groupBy("outcome").agg(F.sum("n_copies").alias("n_rows"))


def clean_extract(df: DataFrame, order: Sequence[str], indicators: Sequence[str] = (), mode_cols: Sequence[str] = MODE_FILLED,
                  amount: str = "amount", date: str = "date_of_payment", count: str = "number_of_payments",
                  state: str = "recipient_state", record_key: str | None = "recipient_id",
                  date_format: str = "MM/dd/yyyy", max_missing: float = 0.5, clip: tuple[float, float] | None = (0.001, 0.999)) -> DataFrame:
    """The whole lenient path over a raw extract, in the reference's order: infinite
    values to NULL (B17), types (B3-B8), sparse columns dropped (B18), amount by its
    median (B9), dates forward and backward along ``order`` (B10), all other gaps
    by name (B11-B13), copies and amounts of 0 dropped (B14, B16), numbers clipped to
    the ``clip`` quantiles of what is left (B20).  The fill comes before the row
    filter, so a row is dropped only for an amount of 0, or where a whole column is
    empty.  Clipped columns are doubles."""
    typed = convert_types(inf_to_null(df), amount, date, count, state, indicators, date_format)
    gaps = typed.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in typed.columns]).first()
    keep = [c for c in typed.columns if c in (amount, date, count, record_key, *order)
            or gaps["_n"] - gaps[c] <= max_missing * gaps["_n"]]
    filled = median_fill(typed.select(*keep), [amount])
    filled = forward_backward_fill(filled, date, list(order))
    filled = fill_missing(filled, mode_cols)
    n = -(-gaps["_n"] // TASK_ROWS)
    if n > shuffle_partitions(df.sparkSession):
        filled = filled.repartition(n, *filled.columns)          # the distinct below needs no exchange of its own
    valid = drop_invalid(filled, amount, date, record_key)
    if not clip:
        return valid
    valid = cut_lineage(valid)                               # the quantiles read it several times
    return quantile_clip(valid, numeric_features(valid), *clip)


# ---------------------------------------------------------------- B18–B20, B24
def missing_profile(df: DataFrame, cols: Sequence[str]) -> tuple[int, dict]:
    """Row count and NULL/NaN/inf count per column: one aggregate, one row."""
    prof = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.sum(clean_double(c).isNull().cast("long")).alias(c) for c in cols]).collect()[0]
    return prof["_n"] or 0, {c: prof[c] or 0 for c in cols}


def drop_sparse_columns(df: DataFrame, cols: Sequence[str], max_missing: float = 0.5,
                        profile: tuple[int, dict] | None = None) -> list[str]:
    """The columns of ``cols`` with at most ``max_missing`` share missing.

    Returns names (a decision on a one-row profile, bounded by the column
    count), so callers keep the lazy plan."""
    n, nulls = profile or missing_profile(df, cols)
    return [c for c in cols if nulls[c] / (n or 1) <= max_missing]


def _clip(col: str, lo: Column, hi: Column) -> Column:
    x = clean_double(col)
    # NULL stays NULL; bounds apply only to present values
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def tukey_clip(df: DataFrame, cols: Sequence[str], k: float = 3.0) -> DataFrame:
    """Clip to [q1 − k·IQR, q3 + k·IQR], quartiles exact, one pass."""
    cols = list(cols)
    q = _fitted(column_quantiles(df, cols, [0.25, 0.75], ["q1", "q3"]))
    bounds = {}
    for c in cols:
        if c not in q:          # all NULL: nothing to clip
            continue
        q1, q3 = float(q[c]["q1"]), float(q[c]["q3"])
        bounds[c] = _clip(c, F.lit(q1 - k * (q3 - q1)), F.lit(q3 + k * (q3 - q1)))
    return df.withColumns(bounds)


def quantile_clip(df: DataFrame, cols: Sequence[str], lo: float = 0.001, hi: float = 0.999) -> DataFrame:
    """Clip to the [lo, hi] quantiles (exact)."""
    cols = list(cols)
    q = _fitted(column_quantiles(df, cols, [lo, hi], ["lo", "hi"]))
    return df.withColumns({c: _clip(c, F.lit(float(q[c]["lo"])), F.lit(float(q[c]["hi"]))) for c in cols if c in q})


def top_share_filter(df: DataFrame, col: str, q: float = 0.9) -> DataFrame:
    """Rows at or above the q-quantile of ``col``."""
    cut = exact_quantiles(df, col, [q], [], ["cut"]).select("cut").scalar()
    return df.where(F.col(col) >= cut)


# ---------------------------------------------------------------- B22, B25
def validate_categories(df: DataFrame, col: str, approved: DataFrame, approved_col: str | None = None
                        ) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``col`` is on the approved list, data-quality rows that are
    not).  The optimizer chooses the join by the list's size."""
    approved_col = approved_col or col
    codes = approved.select(F.col(approved_col).alias("_code")).distinct()
    cond = F.col(col) == F.col("_code")
    return df.join(codes, cond, "left_semi"), df.join(codes, cond, "left_anti")


def prepare_matrix(df: DataFrame, cols: Sequence[str], k: float = 3.0,
                   nulls: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """B19 → B9 → D14 fit in as few exact passes as the data allows.

    One pass gives q1, median, q3 and the NULL count of every column.  The
    k·IQR clip leaves the quartiles where they are (they lie inside the
    bounds) and so does the median fill of a column without NULLs; only
    columns that had NULLs get a second quantile pass after the fill.
    Returns (clipped + filled table, robust-scale parameters
    (column, center, scale) with IQR 0 → 1).  ``nulls``: missing counts per
    column when the caller has profiled the same rows already."""
    cols = list(cols)
    stats = _fitted(column_quantiles(df, cols, [0.25, 0.5, 0.75], ["q1", "median", "q3"]))
    if nulls is None:
        nulls = missing_profile(df, cols)[1]
    exprs = {}
    for c in cols:
        if c not in stats:
            continue
        q1, med, q3 = (float(stats[c][n]) for n in ("q1", "median", "q3"))
        clipped = _clip(c, F.lit(q1 - k * (q3 - q1)), F.lit(q3 + k * (q3 - q1)))
        exprs[c] = F.coalesce(clipped, F.lit(med))
    out = df.withColumns(exprs)
    redo = [c for c in cols if (nulls[c] or 0) > 0 and c in stats]
    again = _fitted(column_quantiles(out, redo, [0.25, 0.5, 0.75], ["q1", "median", "q3"])) if redo else {}
    spark = df.sparkSession
    rows = []
    for c in cols:
        s = again.get(c) or stats.get(c)
        if s is None:
            continue
        iqr = float(s["q3"]) - float(s["q1"])
        rows.append((c, float(s["median"]), 1.0 if iqr == 0 else iqr))
    params = spark.createDataFrame(rows, "column string, center double, scale double")
    return out, params
