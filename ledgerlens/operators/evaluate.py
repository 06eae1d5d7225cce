"""Evaluation, comparison and search summaries (survey §2.6, G1–G19, G27–G30).

Every operator takes a scored table — a score column, a 0/1 flag and
optionally a 0/1 label — and returns a small summary DataFrame.  Curves and
ranks go through the range-partitioned running primitive (no global window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.ordered import exact_quantiles, running
from ledgerlens.functions.stats import clean_double, safe_div


def class_comparison(df: DataFrame, features: Sequence[str], flag: str = "is_anomaly") -> DataFrame:
    """G1: per feature, mean and median for normal (0) and anomaly (1) rows and
    the difference of means in % of the normal mean."""
    from ledgerlens.operators.profile import melt

    long = melt(df.select(flag, *features), features, ids=[flag])
    means = long.groupBy("column").agg(
        F.avg(F.when(F.col(flag) == 0, F.col("value"))).alias("normal_mean"),
        F.avg(F.when(F.col(flag) == 1, F.col("value"))).alias("anomaly_mean"))
    med = exact_quantiles(long, "value", [0.5], ["column", flag], ["_med"], bounded_groups=True)
    meds = med.groupBy("column").agg(F.max(F.when(F.col(flag) == 0, F.col("_med"))).alias("normal_median"),
                                     F.max(F.when(F.col(flag) == 1, F.col("_med"))).alias("anomaly_median"))
    out = means.join(meds, "column", "left")
    return out.select("column", "normal_mean", "normal_median", "anomaly_mean", "anomaly_median",
                      (safe_div(F.col("anomaly_mean") - F.col("normal_mean"), "normal_mean") * 100).alias("difference_pct"))


def score_stats_by_class(df: DataFrame, score: str, flag: str = "is_anomaly") -> DataFrame:
    """Mean, median, min, max of the score per class."""
    s = df.select(F.col(flag), clean_double(score).alias("_s"))
    mom = s.groupBy(flag).agg(F.avg("_s").alias("score_mean"), F.min("_s").alias("score_min"),
                              F.max("_s").alias("score_max"), F.count(F.lit(1)).alias("n"))
    med = exact_quantiles(s, "_s", [0.5], [flag], ["score_median"], bounded_groups=True)
    return mom.join(med, flag, "left").select(flag, "n", "score_mean", "score_median", "score_min", "score_max")


def flagged_category_counts(df: DataFrame, cols: Sequence[str], flag: str = "is_anomaly", top: int = 5
                            ) -> DataFrame:
    """Top values of each categorical column among flagged rows.  Each
    column's top-k is a ``TakeOrderedAndProject`` (k rows kept per task), so a
    column with millions of distinct values is never ranked in one task."""
    flagged = df.where(F.col(flag) == 1)
    parts = []
    for c in cols:
        counts = (flagged.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value"))
                         .agg(F.count(F.lit(1)).alias("count")))
        parts.append(counts.orderBy(F.col("count").desc(), F.col("value")).limit(top)
                           .select(F.lit(c).alias("column"), "value", "count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Counts of every (actual, predicted) cell of the 2×2 matrix."""
    cells = df.sparkSession.createDataFrame([(a, p) for a in (0, 1) for p in (0, 1)], "actual int, predicted int")
    counts = df.groupBy(F.col(label).cast("int").alias("_a"), F.col(pred).cast("int").alias("_p")).agg(
        F.count(F.lit(1)).alias("n"))
    return (F.broadcast(cells).join(counts, (F.col("actual") == F.col("_a")) & (F.col("predicted") == F.col("_p")),
                                    "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("count")))


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class (0 when undefined)."""
    a = df.agg(*[F.sum(((F.col(label) == c) & (F.col(pred) == c)).cast("long")).alias(f"tp{c}") for c in (0, 1)],
               *[F.sum((F.col(pred) == c).cast("long")).alias(f"pp{c}") for c in (0, 1)],
               *[F.sum((F.col(label) == c).cast("long")).alias(f"sup{c}") for c in (0, 1)])
    rows = []
    for c in (0, 1):
        p = F.coalesce(safe_div(f"tp{c}", f"pp{c}"), F.lit(0.0))
        r = F.coalesce(safe_div(f"tp{c}", f"sup{c}"), F.lit(0.0))
        f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
        rows.append(a.select(F.lit(c).alias("class"), p.alias("precision"), r.alias("recall"), f1.alias("f1"),
                             F.coalesce(F.col(f"sup{c}"), F.lit(0)).alias("support")))
    return rows[0].unionByName(rows[1])


def _class_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    s = clean_double(score)
    return (df.where(s.isNotNull()).groupBy(s.alias("_s"))
              .agg(F.sum((F.col(label) == 1).cast("long")).alias("_pos"),
                   F.sum((F.col(label) != 1).cast("long")).alias("_neg")))


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, highest first (the
    full curve; sklearn would also drop collinear points)."""
    counts = _class_counts(df, score, label)
    cum = running(counts, [F.col("_s").desc()], ["_pos", "_neg"], [], "sum", ["_tp", "_fp"])
    tot = counts.agg(F.sum("_pos").alias("P"), F.sum("_neg").alias("N"))
    P, N = tot.select("P").scalar(), tot.select("N").scalar()
    return cum.select(F.col("_s").alias("threshold"), safe_div("_fp", N).alias("fpr"), safe_div("_tp", P).alias("tpr"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """AUC by the rank-sum formula with average ranks for ties (equals
    ``roc_auc_score``)."""
    counts = _class_counts(df, score, label).withColumn("_c", F.col("_pos") + F.col("_neg"))
    cum = running(counts, ["_s"], ["_c"], [], "sum", ["_cum"])
    rank_sum = cum.agg(F.sum(F.col("_pos") * (F.col("_cum") - F.col("_c") + (F.col("_c") + 1) / 2.0)).alias("rs"),
                       F.sum("_pos").alias("P"), F.sum("_neg").alias("N"))
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    return rank_sum.select(safe_div(F.col("rs") - P * (P + 1) / 2.0, P * N).alias("roc_auc"))


def percentile_curve(df: DataFrame, score: str, points: int = 100) -> DataFrame:
    """Score at percentiles 1…100 (exact, linear)."""
    probs = [i / points for i in range(1, points + 1)]
    names = [f"p{i}" for i in range(1, points + 1)]
    q = exact_quantiles(df.select(clean_double(score).alias("_s")), "_s", probs, [], names)
    stack = "stack({}, {}) AS (percentile, score)".format(points, ", ".join(f"{i}, p{i}" for i in range(1, points + 1)))
    return q.selectExpr(stack)


def separation(df: DataFrame, score: str, flag: str = "is_anomaly", min_group: int = 3,
               contamination: float | None = None) -> DataFrame:
    """Cohen's d of normal vs flagged scores with population std, guarded
    like the reference (too few rows or pooled std < 1e-6 → 0, or −inf in the
    penalised variant).  With ``contamination`` the variant subtracts
    2·|flagged rate − contamination|."""
    s = clean_double(score)
    a = df.agg(F.avg(F.when(F.col(flag) == 0, s)).alias("mn"), F.avg(F.when(F.col(flag) == 1, s)).alias("ma"),
               F.stddev_pop(F.when(F.col(flag) == 0, s)).alias("sn"), F.stddev_pop(F.when(F.col(flag) == 1, s)).alias("sa"),
               F.sum((F.col(flag) == 0).cast("long")).alias("nn"), F.sum((F.col(flag) == 1).cast("long")).alias("na"),
               F.sum(F.when(s.isNull(), 1).otherwise(0)).alias("bad"), F.count(F.lit(1)).alias("n"))
    pooled = F.sqrt((F.col("sn") * F.col("sn") + F.col("sa") * F.col("sa")) / 2)
    d = (F.col("mn") - F.col("ma")) / pooled
    fail = F.lit(0.0) if contamination is None else F.lit(float("-inf"))
    ok = (F.col("bad") == 0) & (F.col("nn") >= min_group) & (F.col("na") >= min_group) & (pooled >= 1e-6)
    val = d if contamination is None else d - 2 * F.abs(F.col("na") / F.col("n") - F.lit(contamination))
    return a.select(F.when(ok, val).otherwise(fail).alias("separation"),
                    (F.col("na") / F.col("n")).alias("flagged_rate"))


def mean_by_param(results: DataFrame, param: str, score: str = "score") -> DataFrame:
    """Mean score per parameter value."""
    return results.groupBy(param).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n"))


def param_correlation(results: DataFrame, params: Sequence[str], score: str = "score") -> DataFrame:
    """Pearson r of each parameter with the score."""
    wide = results.agg(*[F.corr(F.col(p).cast("double"), F.col(score)).alias(p) for p in params])
    stack = "stack({}, {}) AS (param, r)".format(len(params), ", ".join(f"'{p}', `{p}`" for p in params))
    return wide.selectExpr(stack)


def model_comparison(df: DataFrame, model_col: str, score: str, flag: str) -> DataFrame:
    """Per model mean, population std and flagged count of the score;
    change % of |mean| against the first model in name order; and the three
    bar metrics each divided by their largest value over models."""
    g = df.groupBy(model_col).agg(F.avg(score).alias("score_mean"), F.stddev_pop(score).alias("score_std"),
                                  F.sum(F.col(flag).cast("long")).alias("n_flagged"), F.count(F.lit(1)).alias("n"))
    base = g.orderBy(model_col).limit(1).select(F.abs("score_mean").alias("_b"))
    b = base.scalar()
    maxes = g.agg(F.max(F.abs("score_mean")).alias("m1"), F.max(safe_div(F.lit(1.0), "score_std")).alias("m2"),
                  F.max(F.col("n_flagged") / F.col("n")).alias("m3"))
    return g.select(model_col, "n", "score_mean", "score_std", "n_flagged",
                    (safe_div(F.abs("score_mean") - b, b) * 100).alias("mean_change_pct"),
                    safe_div(F.abs("score_mean"), maxes.select("m1").scalar()).alias("rel_abs_mean"),
                    safe_div(safe_div(F.lit(1.0), "score_std"), maxes.select("m2").scalar()).alias("rel_inv_std"),
                    safe_div(F.col("n_flagged") / F.col("n"), maxes.select("m3").scalar()).alias("rel_flag_rate"))


def dashboard_totals(df: DataFrame, amount: str, flag: str) -> DataFrame:
    """Counts and average amount of all, flagged and normal rows (0 when empty)."""
    return df.agg(F.count(F.lit(1)).alias("n_total"), F.sum(F.col(flag).cast("long")).alias("n_anomalies"),
                  F.sum((F.col(flag) == 0).cast("long")).alias("n_normal"),
                  F.coalesce(F.avg(amount), F.lit(0.0)).alias("avg_amount_all"),
                  F.coalesce(F.avg(F.when(F.col(flag) == 1, F.col(amount))), F.lit(0.0)).alias("avg_amount_anomaly"),
                  F.coalesce(F.avg(F.when(F.col(flag) == 0, F.col(amount))), F.lit(0.0)).alias("avg_amount_normal"))


def flagged_by_state(df: DataFrame, state: str, flag: str, top: int = 10) -> DataFrame:
    """Flagged rows per state, blank → 'Unknown', top 10 (ties by name)."""
    st = F.when(F.col(state).isNull() | (F.trim(F.col(state)) == ""), F.lit("Unknown")).otherwise(F.col(state))
    return (df.where(F.col(flag) == 1).groupBy(st.alias("state")).agg(F.count(F.lit(1)).alias("n_anomalies"))
              .orderBy(F.col("n_anomalies").desc(), "state").limit(top))


def numeric_summary(df: DataFrame, col: str) -> DataFrame:
    """Mean, median, p95, p99, min, max, count of any numeric column."""
    x = df.select(clean_double(col).alias("_x"))
    q = exact_quantiles(x, "_x", [0.5, 0.95, 0.99], [], ["median", "p95", "p99"])
    m = x.agg(F.avg("_x").alias("mean"), F.min("_x").alias("min"), F.max("_x").alias("max"),
              F.count("_x").alias("count"))
    return m.select("count", "mean", q.select("median").scalar().alias("median"), q.select("p95").scalar().alias("p95"),
                    q.select("p99").scalar().alias("p99"), "min", "max")


def best_so_far(results: DataFrame, order: str, score: str = "score") -> DataFrame:
    """Running best score over search iterations (small results table)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn("best_so_far", F.max(score).over(w))


def top_configurations(results: DataFrame, score: str = "score", n: int = 10, key: str = "candidate") -> DataFrame:
    """Top n configurations by score (ties by key)."""
    return results.orderBy(F.col(score).desc(), F.col(key)).limit(n)


def flagged_rate_by_split(df: DataFrame, split: str, model: str, flag: str) -> DataFrame:
    """Flagged % per split and model."""
    return df.groupBy(split, model).agg((F.avg(F.col(flag).cast("double")) * 100).alias("flagged_pct"),
                                        F.count(F.lit(1)).alias("n"))
