"""Monitoring: baseline statistics and drift (survey §2.6, G20–G25).

A baseline is a small table of per-column statistics (one row per column);
a current batch is profiled the same way and the two are joined on the
column name.  PSI uses the baseline's decile edges, so both batches are
bucketed by the same rule in one pass each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.ordered import exact_quantiles, running
from ledgerlens.functions.stats import clean_double, safe_div
from ledgerlens.operators.profile import melt

# Fixed values that must equal the reference's behaviour.
FEATURE_DRIFT_ALARM = 0.15      # mean moved by more than 15% of the baseline mean
RATE_DRIFT_ALARM = 0.25         # anomaly rate moved by more than 25%
PSI_EPS = 1e-4

# Our own choice.
MIX_ALARM = 0.1                 # a tenth of the reason codes moved


def baseline_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, count, missing, mean, std, min, max, p10…p90) — one
    aggregate for moments, one exact-quantile pass for the deciles."""
    long = melt(df, cols)
    mom = long.groupBy("column").agg(F.count("value").alias("count"),
                                     F.sum(F.col("value").isNull().cast("long")).alias("missing"),
                                     F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                     F.min("value").alias("min"), F.max("value").alias("max"))
    probs = [i / 10 for i in range(1, 10)]
    q = exact_quantiles(long, "value", probs, ["column"], [f"p{i}0" for i in range(1, 10)], bounded_groups=True)
    return mom.join(q, "column", "left")


def feature_drift(base: DataFrame, current: DataFrame, alarm: float = FEATURE_DRIFT_ALARM) -> DataFrame:
    """Relative change of each column's mean against the baseline."""
    b = base.select("column", F.col("mean").alias("baseline_mean"))
    c = current.select("column", F.col("mean").alias("current_mean"))
    j = b.join(c, "column", "full")
    rel = F.abs(safe_div(F.col("current_mean") - F.col("baseline_mean"), F.abs(F.col("baseline_mean"))))
    return j.select("column", "baseline_mean", "current_mean", rel.alias("relative_change"),
                    F.coalesce(rel > alarm, F.lit(False)).alias("drift_alarm"))


def psi(base_df: DataFrame, cur_df: DataFrame, base_stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """G21/G23 option: population stability index per column over the
    baseline's decile buckets (10 buckets; empty shares floored at 1e-4)."""
    edges = base_stats.select("column", F.array(*[F.col(f"p{i}0") for i in range(1, 10)]).alias("_e"))

    def shares(df, name):
        # the edges: one row per column
        long = melt(df, cols).where(F.col("value").isNotNull()).join(F.broadcast(edges), "column")
        bucket = F.size(F.filter("_e", lambda e: e < F.col("value")))
        g = long.groupBy("column", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        tot = g.groupBy("column").agg(F.sum("n").alias("_t"))
        return g.join(tot, "column").select("column", "bucket", (F.col("n") / F.col("_t")).alias(name))

    b, c = shares(base_df, "pb"), shares(cur_df, "pc")
    j = b.join(c, ["column", "bucket"], "full")
    pb = F.greatest(F.coalesce("pb", F.lit(0.0)), F.lit(PSI_EPS))
    pc = F.greatest(F.coalesce("pc", F.lit(0.0)), F.lit(PSI_EPS))
    return j.groupBy("column").agg(F.sum((pc - pb) * F.log(pc / pb)).alias("psi"))


def ks_statistic(base_df: DataFrame, cur_df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """G21 option: two-sample Kolmogorov-Smirnov statistic per column, the largest
    distance of the two empirical distribution functions.  Values are counted per
    (column, value, batch) first; the running counts are spread by value range."""
    def long(df, base):
        return melt(df, cols).where(F.col("value").isNotNull()).select(
            "column", "value", F.lit(base).alias("_b"), F.lit(1 - base).alias("_u"))

    both = long(base_df, 1).unionByName(long(cur_df, 0)).groupBy("column", "value").agg(F.sum("_b").alias("_b"), F.sum("_u").alias("_u"))
    cum = running(both, ["value"], ["_b", "_u"], ["column"], "sum", ["_cb", "_cu"])
    total = both.groupBy(F.col("column").alias("_col")).agg(F.sum("_b").alias("_nb"), F.sum("_u").alias("_nu"))
    gap = F.abs(safe_div("_cb", "_nb") - safe_div("_cu", "_nu"))
    # one row per column
    return cum.join(F.broadcast(total), F.col("column") == F.col("_col")).groupBy("column").agg(F.max(gap).alias("ks"))


def rate_drift(base: DataFrame, current: DataFrame, flag: str, alarm: float = RATE_DRIFT_ALARM) -> DataFrame:
    """Anomaly rate of both batches, relative change, alarm and the
    retrain decision (alarm on the rate)."""
    b = base.agg(F.avg(F.col(flag).cast("double")).alias("baseline_rate"))
    c = current.agg(F.avg(F.col(flag).cast("double")).alias("current_rate"))
    br, cr = b.select("baseline_rate").scalar(), c.select("current_rate").scalar()
    rel = F.abs(safe_div(cr - br, br))
    return b.select(br.alias("baseline_rate"), cr.alias("current_rate"), rel.alias("relative_change"),
                    F.coalesce(rel > alarm, F.lit(False)).alias("rate_alarm"))


def score_percentile_drift(base: DataFrame, current: DataFrame, score: str, points: Sequence[float] = (
        0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Score at fixed percentiles in both batches and the difference."""
    names = [f"q{i}" for i in range(len(points))]
    qb = exact_quantiles(base.select(clean_double(score).alias("_s")), "_s", points, [], names)
    qc = exact_quantiles(current.select(clean_double(score).alias("_s")), "_s", points, [], names)
    stack = "stack({}, {}) AS (percentile, v)".format(
        len(points), ", ".join(f"CAST({p} AS DOUBLE), {n}" for p, n in zip(points, names)))
    lb = qb.selectExpr(stack).withColumnRenamed("v", "baseline_score")
    lc = qc.selectExpr(stack).withColumnRenamed("v", "current_score")
    return lb.join(lc, "percentile").withColumn("difference", F.col("current_score") - F.col("baseline_score"))


def mix_drift(base: DataFrame, current: DataFrame, codes: str = "reason_codes", sep: str = ";", none: str = "(none)") -> DataFrame:
    """G23 (reason-code mix): per code the rows that carry it in both batches, its
    share of all codes given in a batch, the difference, and whether it is in
    ``both``, ``new`` or ``gone``.  A row without a code (null or empty) counts
    under ``none``; a code named twice in a row counts once.  One map-side count
    per batch; the codes of a batch are few against its rows."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        given = F.array_distinct(F.filter(F.split(F.coalesce(F.col(codes), F.lit("")), f"\\Q{sep}\\E"), lambda c: F.trim(c) != ""))
        code = F.explode(F.when(F.size(given) > 0, given).otherwise(F.array(F.lit(none))))
        return df.select(code.alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias(name))

    b, c = counts(base, "baseline_rows"), counts(current, "current_rows")
    j = b.join(c, "code", "full").fillna(0, ["baseline_rows", "current_rows"])
    share = lambda n, of: F.coalesce(safe_div(F.col(n), of.agg(F.sum(n)).scalar()), F.lit(0.0))
    j = j.withColumns({"baseline_share": share("baseline_rows", b), "current_share": share("current_rows", c)})
    return j.withColumns({"difference": F.col("current_share") - F.col("baseline_share"),
                          "status": F.when(F.col("baseline_rows") == 0, "new").when(F.col("current_rows") == 0, "gone").otherwise("both")})


def mix_distance(mix: DataFrame, alarm: float = MIX_ALARM) -> DataFrame:
    """One row that sums up ``mix_drift``: the total variation and the
    Jensen-Shannon distance (base 2, 0 to 1) of the two mixes, new and gone codes,
    and an alarm when the total variation is above ``alarm``.  Two empty batches
    are 0 apart; unseen codes need no floor in either distance."""
    p, q = F.col("baseline_share"), F.col("current_share")
    part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    tv = F.coalesce(F.sum(F.abs(p - q)) / 2, F.lit(0.0))
    return mix.agg(tv.alias("total_variation"),
                   F.sqrt(F.greatest(F.coalesce(F.sum(part(p) + part(q)) / 2, F.lit(0.0)), F.lit(0.0))).alias("jensen_shannon"),
                   F.count_if(F.col("status") == "new").alias("n_new"), F.count_if(F.col("status") == "gone").alias("n_gone"),
                   (tv > alarm).alias("mix_alarm"))


def schema_drift(base: DataFrame, current: DataFrame) -> DataFrame:
    """Columns added, removed or retyped between two tables."""
    bt, ct = dict(base.dtypes), dict(current.dtypes)
    rows = [(c, bt.get(c), ct.get(c), "removed" if c not in ct else "added" if c not in bt else "retyped")
            for c in sorted(set(bt) | set(ct)) if bt.get(c) != ct.get(c)]
    return base.sparkSession.createDataFrame(rows, "column string, baseline_type string, current_type string, "
                                                   "change string")


def new_categories(base: DataFrame, current: DataFrame, col: str) -> DataFrame:
    """Values of ``col`` in the current batch never seen in the baseline
    (left anti join on the distinct values), with their row counts."""
    seen = base.select(F.col(col).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    cur = current.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))
    return cur.join(seen, cur[col] == seen["_v"], "left_anti")


def missing_drift(base: DataFrame, current: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing share per column in both batches."""
    def share(df, name):
        a = df.agg(*[F.avg(clean_double(c).isNull().cast("double") if dict(df.dtypes)[c] in ("double", "float")
                           else F.col(c).isNull().cast("double")).alias(c) for c in cols])
        stack = "stack({}, {}) AS (column, {})".format(len(cols), ", ".join(f"'{c}', `{c}`" for c in cols), name)
        return a.selectExpr(stack)
    return share(base, "baseline_missing").join(share(current, "current_missing"), "column")


def retrain_decision(feature_drift_df: DataFrame, rate_drift_df: DataFrame) -> DataFrame:
    """Retrain when any feature drifts or the anomaly rate drifts."""
    f = feature_drift_df.agg(F.coalesce(F.max(F.col("drift_alarm").cast("int")), F.lit(0)).alias("_f"),
                             F.sum(F.col("drift_alarm").cast("int")).alias("n_drifting"))
    return f.select(F.coalesce(F.col("n_drifting"), F.lit(0)).alias("n_drifting"),
                    ((F.col("_f") == 1) | rate_drift_df.select("rate_alarm").scalar()).alias("retrain"))
