"""Rule-based anomaly detectors (survey §2.5: E6, E7, E11, E12, E13).

All of them are column expressions over statistics computed in one
aggregate; nothing leaves the executors except one-row parameter tables that
enter as scalar subqueries.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.ordered import exact_quantiles
from ledgerlens.functions.stats import clean_double
from ledgerlens.session import fitted_params

# Fixed values that must equal the reference's behaviour.
Z_CUT = 3.0                 # |z| > 3 marks a feature as extreme
PSEUDO_LABEL_PERCENTILE = 0.95
IQR_K = 1.5
TOP_PERCENTILE = 0.99


def pseudo_labels(df: DataFrame, cols: Sequence[str], z_cut: float = Z_CUT, pct: float = PSEUDO_LABEL_PERCENTILE,
                  score_col: str = "outlier_score", label_col: str = "pseudo_label", rule: str = "percentile"
                  ) -> DataFrame:
    """Count of features with |z| > 3 (sample std, T2).

    ``rule="percentile"`` (the reference code): labelled 1 when the count is
    ``>=`` its 95th percentile (T21: ties make it more than 5% — all rows when
    over 95% of rows have no extreme feature).  ``rule="any"``: labelled 1
    when any feature is extreme (the reference's comment for the same step)."""
    cols = list(cols)
    stats = df.agg(*[F.avg(clean_double(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                   *[F.stddev_samp(clean_double(c)).alias(f"s{i}") for i, c in enumerate(cols)])
    row = fitted_params(stats, 1)[0]
    flags = []
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        if m is None or s is None or s == 0:
            flags.append(F.lit(0))          # constant or empty column: z undefined, never extreme
            continue
        z = F.abs((clean_double(c) - F.lit(float(m))) / F.lit(float(s)))
        flags.append(F.coalesce((z > z_cut).cast("int"), F.lit(0)))
    scored = df.withColumn(score_col, reduce(lambda a, b: a + b, flags))
    if rule == "any":
        return scored.withColumn(label_col, (F.col(score_col) > 0).cast("int"))
    cut = exact_quantiles(scored, score_col, [pct], [], ["_cut"]).select("_cut").scalar()
    return scored.withColumn(label_col, (F.col(score_col) >= cut).cast("int"))


def top_share_flag(df: DataFrame, score: str, contamination: float = 0.02, out: str = "is_anomaly") -> DataFrame:
    """Flag the ``contamination`` share with the highest score (score at or
    above its exact (1 − contamination) quantile) — the same convention as the
    isolation forest offset.  NULL scores are not flagged."""
    cut = exact_quantiles(df, score, [1.0 - contamination], [], ["_cut"]).select("_cut").scalar()
    return df.withColumn(out, F.coalesce((F.col(score) >= cut).cast("int"), F.lit(0)))


def class_weight(df: DataFrame, label_col: str = "pseudo_label") -> DataFrame:
    """Negatives / positives (``scale_pos_weight``), one row."""
    return df.agg(F.try_divide(F.sum((F.col(label_col) == 0).cast("double")),
                               F.sum((F.col(label_col) == 1).cast("double"))).alias("scale_pos_weight"))


def baseline_flags(df: DataFrame, value: str, z_cut: float = Z_CUT, iqr_k: float = IQR_K,
                   pct: float = TOP_PERCENTILE) -> DataFrame:
    """Per row, IQR rule, |z| > 3 (population std after NULL → 0, as
    ``scipy.stats.zscore(x.fillna(0))``) and above the 99th percentile."""
    x = F.coalesce(clean_double(value), F.lit(0.0))
    src = df.withColumn("_bx", x)
    q = exact_quantiles(src, "_bx", [0.25, 0.75, pct], [], ["q1", "q3", "qp"])
    m = src.agg(F.avg("_bx").alias("mu"), F.stddev_pop("_bx").alias("sd"))
    q1, q3, qp = (q.select(c).scalar() for c in ("q1", "q3", "qp"))
    mu, sd = m.select("mu").scalar(), m.select("sd").scalar()
    iqr = q3 - q1
    return src.withColumns({
        "is_outlier_iqr": ((F.col("_bx") < q1 - iqr_k * iqr) | (F.col("_bx") > q3 + iqr_k * iqr)).cast("int"),
        "is_outlier_zscore": F.coalesce((F.abs(F.col("_bx") - mu) / F.when(sd > 0, sd) > z_cut).cast("int"),
                                        F.lit(0)),
        "is_outlier_percentile": (F.col("_bx") > qp).cast("int"),
    }).drop("_bx")


# Reason codes (E13; the design text names the idea, the thresholds are ours).
REASONS = (
    ("amount_far_above_peers", lambda: F.col("peer_robust_z") > 3.5),
    ("amount_far_below_peers", lambda: F.col("peer_robust_z") < -3.5),
    ("above_own_history_max", lambda: (F.col("is_new_recipient") == 0) & (F.col("amt_to_max_ratio") > 1.0)),
    ("over_3x_own_average", lambda: F.col("amt_to_avg_ratio") > 3.0),
    ("new_recipient", lambda: F.col("is_new_recipient") == 1),
    ("high_risk_nature", lambda: F.col("is_high_risk_nature") == 1),
)


def reason_codes(df: DataFrame, out: str = "reason_codes") -> DataFrame:
    """E13: ';'-joined reason codes (fixed order) and their count per row."""
    parts = [F.when(cond(), F.lit(name)) for name, cond in REASONS]
    n = reduce(lambda a, b: a + b, [F.coalesce(cond().cast("int"), F.lit(0)) for _, cond in REASONS])
    return df.withColumn(out, F.concat_ws(";", *parts)).withColumn("n_reasons", n)


def rule_flag(score: str | Column, threshold: float = 3.5) -> Column:
    """E12 decision: |robust z| above the threshold (NULL → not flagged)."""
    s = F.col(score) if isinstance(score, str) else score
    return F.coalesce((F.abs(s) > threshold).cast("int"), F.lit(0))
