"""Registered detector and evaluation queries (E6, E7, E11–E13, G1–G9,
G15–G19, G29, D22) over the scored table: robust-z rule as the detector and
E6 pseudo-labels as the reference labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.stats import unit_hash_sql
from ledgerlens.operators import detect as E
from ledgerlens.operators import evaluate as G
from ledgerlens.operators import features as D
from ledgerlens.operators import profile as P
from ledgerlens.plans.flagship import SCORED_SQL, rounded, scored_table
from ledgerlens.plans.registry import register
from ledgerlens.sources.tables import table

W = "WITH " + SCORED_SQL


@register("e6_pseudo_labels", W + """,
pc AS (SELECT quantile_cont(outlier_score, 0.95) AS c FROM lab0)
SELECT outlier_score, CAST(outlier_score >= c AS INTEGER) AS pseudo_label, count(*) AS n_rows FROM lab0, pc
GROUP BY 1, 2""")
def e6(spark, sf):
    """E6 with the reference's rule (``>=`` the 95th percentile, T21)."""
    from ledgerlens.plans.flagship import PEERS, PSEUDO_COLS, feature_table

    f = E.pseudo_labels(D.peer_scores(feature_table(spark, sf), "amount", PEERS), PSEUDO_COLS)
    return f.groupBy("outlier_score", "pseudo_label").agg(F.count(F.lit(1)).alias("n_rows"))


@register("e6_pseudo_labels_any", W + """
SELECT outlier_score, pseudo_label, count(*) AS n_rows FROM final GROUP BY 1, 2""")
def e6_any(spark, sf):
    s = scored_table(spark, sf)
    return s.groupBy("outlier_score", "pseudo_label").agg(F.count(F.lit(1)).alias("n_rows"))


@register("e7_class_weight", W + """
SELECT round(sum(CASE WHEN pseudo_label = 0 THEN 1.0 ELSE 0 END) / sum(CASE WHEN pseudo_label = 1 THEN 1.0 ELSE 0 END), 6)
       AS scale_pos_weight FROM final""")
def e7(spark, sf):
    return rounded(E.class_weight(scored_table(spark, sf)))


@register("e11_baseline_detectors", """
WITH t AS (SELECT recipient_id, coalesce(sum(amount), 0) AS total_amount FROM payments GROUP BY 1),
s AS (SELECT quantile_cont(total_amount, 0.25) AS q1, quantile_cont(total_amount, 0.75) AS q3,
             quantile_cont(total_amount, 0.99) AS qp, avg(total_amount) AS mu, stddev_pop(total_amount) AS sd FROM t)
SELECT recipient_id, round(total_amount, 2) AS total_amount,
       CAST(total_amount < q1 - 1.5 * (q3 - q1) OR total_amount > q3 + 1.5 * (q3 - q1) AS INTEGER) AS is_outlier_iqr,
       coalesce(CAST(abs(total_amount - mu) / nullif(sd, 0) > 3 AS INTEGER), 0) AS is_outlier_zscore,
       CAST(total_amount > qp AS INTEGER) AS is_outlier_percentile
FROM t, s""")
def e11(spark, sf):
    from ledgerlens.sources.tables import payments

    t = payments(spark, sf, ["recipient_id", "amount"]).groupBy("recipient_id").agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_amount"))
    f = E.baseline_flags(t, "total_amount")
    return f.select("recipient_id", F.round("total_amount", 2).alias("total_amount"), "is_outlier_iqr",
                    "is_outlier_zscore", "is_outlier_percentile")


@register("e12_peer_rule_flags", W + """
SELECT record_id, round(anomaly_score, 6) AS anomaly_score FROM final WHERE is_anomaly = 1""")
def e12(spark, sf):
    s = scored_table(spark, sf).where(F.col("is_anomaly") == 1)
    return s.select("record_id", F.round("anomaly_score", 6).alias("anomaly_score"))


@register("e13_reason_codes", W + """
SELECT record_id, concat_ws(';',
         CASE WHEN peer_robust_z > 3.5 THEN 'amount_far_above_peers' END,
         CASE WHEN peer_robust_z < -3.5 THEN 'amount_far_below_peers' END,
         CASE WHEN is_new_recipient = 0 AND amt_to_max_ratio > 1.0 THEN 'above_own_history_max' END,
         CASE WHEN amt_to_avg_ratio > 3.0 THEN 'over_3x_own_average' END,
         CASE WHEN is_new_recipient = 1 THEN 'new_recipient' END,
         CASE WHEN is_high_risk_nature = 1 THEN 'high_risk_nature' END) AS reason_codes,
       coalesce(CAST(peer_robust_z > 3.5 AS INTEGER), 0) + coalesce(CAST(peer_robust_z < -3.5 AS INTEGER), 0)
       + CAST(is_new_recipient = 0 AND amt_to_max_ratio > 1.0 AS INTEGER) + CAST(amt_to_avg_ratio > 3.0 AS INTEGER)
       + CAST(is_new_recipient = 1 AS INTEGER) + CAST(is_high_risk_nature = 1 AS INTEGER) AS n_reasons
FROM final""")
def e13(spark, sf):
    return E.reason_codes(scored_table(spark, sf)).select("record_id", "reason_codes", "n_reasons")


_G1_FEATS = ["amount", "hist_pay_avg", "amt_to_avg_ratio"]


@register("g1_class_comparison", W + "\n" + "\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", round(avg(CASE WHEN is_anomaly = 0 THEN {c} END), 6) AS normal_mean,
       round(quantile_cont({c}, 0.5) FILTER (WHERE is_anomaly = 0), 6) AS normal_median,
       round(avg(CASE WHEN is_anomaly = 1 THEN {c} END), 6) AS anomaly_mean,
       round(quantile_cont({c}, 0.5) FILTER (WHERE is_anomaly = 1), 6) AS anomaly_median,
       round((avg(CASE WHEN is_anomaly = 1 THEN {c} END) - avg(CASE WHEN is_anomaly = 0 THEN {c} END))
             / nullif(avg(CASE WHEN is_anomaly = 0 THEN {c} END), 0) * 100, 6) AS difference_pct
FROM final""" for c in _G1_FEATS))
def g1(spark, sf):
    return rounded(G.class_comparison(scored_table(spark, sf), _G1_FEATS))


@register("g2_score_stats_by_class", W + """
SELECT is_anomaly, count(*) AS n, round(avg(anomaly_score), 6) AS score_mean,
       round(quantile_cont(anomaly_score, 0.5), 6) AS score_median, round(min(anomaly_score), 6) AS score_min,
       round(max(anomaly_score), 6) AS score_max FROM final GROUP BY is_anomaly""")
def g2(spark, sf):
    return rounded(G.score_stats_by_class(scored_table(spark, sf), "anomaly_score"))


@register("g3_flagged_category_counts", W + "\n" + "\nUNION ALL\n".join(f"""
SELECT * FROM (SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count FROM final
               WHERE is_anomaly = 1 AND {c} IS NOT NULL GROUP BY 2 ORDER BY count DESC, value LIMIT 5)"""
                                                                   for c in ["recipient_type", "recipient_state",
                                                                             "nature"]))
def g3(spark, sf):
    return G.flagged_category_counts(scored_table(spark, sf), ["recipient_type", "recipient_state", "nature"])


@register("g4_confusion_matrix", W + """,
cells(actual, predicted) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)),
c AS (SELECT pseudo_label AS a, is_anomaly AS p, count(*) AS n FROM final GROUP BY 1, 2)
SELECT actual, predicted, coalesce(n, 0) AS count FROM cells LEFT JOIN c ON actual = a AND predicted = p""")
def g4(spark, sf):
    return G.confusion_matrix(scored_table(spark, sf), "pseudo_label", "is_anomaly")


@register("g5_classification_report", W + """,
s AS (SELECT sum(CASE WHEN pseudo_label = 0 AND is_anomaly = 0 THEN 1 ELSE 0 END) AS tp0,
             sum(CASE WHEN pseudo_label = 1 AND is_anomaly = 1 THEN 1 ELSE 0 END) AS tp1,
             sum(CASE WHEN is_anomaly = 0 THEN 1 ELSE 0 END) AS pp0, sum(CASE WHEN is_anomaly = 1 THEN 1 ELSE 0 END) AS pp1,
             sum(CASE WHEN pseudo_label = 0 THEN 1 ELSE 0 END) AS sup0,
             sum(CASE WHEN pseudo_label = 1 THEN 1 ELSE 0 END) AS sup1 FROM final),
r AS (SELECT 0 AS class, coalesce(tp0 / nullif(pp0, 0), 0) AS p, coalesce(tp0 / nullif(sup0, 0), 0) AS r, sup0 AS support FROM s
      UNION ALL
      SELECT 1, coalesce(tp1 / nullif(pp1, 0), 0), coalesce(tp1 / nullif(sup1, 0), 0), sup1 FROM s)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, CAST(support AS BIGINT) AS support FROM r""")
def g5(spark, sf):
    return rounded(G.classification_report(scored_table(spark, sf), "pseudo_label", "is_anomaly"))


@register("g6_roc_points", W + """,
c AS (SELECT anomaly_score AS s, sum(CASE WHEN pseudo_label = 1 THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN pseudo_label <> 1 THEN 1 ELSE 0 END) AS neg FROM final WHERE anomaly_score IS NOT NULL GROUP BY 1),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM c)
SELECT round(s, 6) AS threshold,
       round(sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / N, 6) AS fpr,
       round(sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / P, 6) AS tpr
FROM c, t""")
def g6(spark, sf):
    return rounded(G.roc_points(scored_table(spark, sf), "anomaly_score", "pseudo_label"))


@register("g7_roc_auc", W + """,
c AS (SELECT anomaly_score AS s, sum(CASE WHEN pseudo_label = 1 THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN pseudo_label <> 1 THEN 1 ELSE 0 END) AS neg FROM final WHERE anomaly_score IS NOT NULL GROUP BY 1),
r AS (SELECT pos, neg, sum(pos + neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM c)
SELECT round((sum(pos * (cum - (pos + neg) + (pos + neg + 1) / 2.0)) - sum(pos) * (sum(pos) + 1) / 2.0)
             / (sum(pos) * sum(neg)), 6) AS roc_auc FROM r""")
def g7(spark, sf):
    return rounded(G.roc_auc(scored_table(spark, sf), "anomaly_score", "pseudo_label"))


@register("g8_percentile_curve", W + """,
q AS (SELECT quantile_cont(anomaly_score, [""" + ", ".join(str(i / 100) for i in range(1, 101)) + """]) AS v FROM final)
SELECT CAST(i AS INTEGER) AS percentile, round(v[i], 6) AS score FROM q, range(1, 101) t(i)""")
def g8(spark, sf):
    return rounded(G.percentile_curve(scored_table(spark, sf), "anomaly_score"))


def _sep_sql(penalty: bool) -> str:
    fail = "'-inf'::DOUBLE" if penalty else "0.0"
    val = "d - 2 * abs(na * 1.0 / n - 0.05)" if penalty else "d"
    return W + f""",
v AS (SELECT -anomaly_score AS s, is_anomaly FROM final WHERE anomaly_score IS NOT NULL),
a AS (SELECT avg(CASE WHEN is_anomaly = 0 THEN s END) AS mn, avg(CASE WHEN is_anomaly = 1 THEN s END) AS ma,
             stddev_pop(CASE WHEN is_anomaly = 0 THEN s END) AS sn, stddev_pop(CASE WHEN is_anomaly = 1 THEN s END) AS sa,
             sum(CASE WHEN is_anomaly = 0 THEN 1 ELSE 0 END) AS nn, sum(CASE WHEN is_anomaly = 1 THEN 1 ELSE 0 END) AS na,
             count(*) AS n FROM v),
b AS (SELECT *, sqrt((sn * sn + sa * sa) / 2) AS pooled, (mn - ma) / sqrt((sn * sn + sa * sa) / 2) AS d FROM a)
SELECT round(CASE WHEN nn >= {10 if penalty else 3} AND na >= {10 if penalty else 3} AND pooled >= 1e-6
                  THEN {val} ELSE {fail} END, 6) AS separation,
       round(na * 1.0 / n, 6) AS flagged_rate FROM b"""


@register("g9_separation", _sep_sql(False))
def g9(spark, sf):
    s = scored_table(spark, sf).where(F.col("anomaly_score").isNotNull()).withColumn("_d", -F.col("anomaly_score"))
    return rounded(G.separation(s, "_d", "is_anomaly"))


@register("g9_separation_penalised", _sep_sql(True))
def g9p(spark, sf):
    s = scored_table(spark, sf).where(F.col("anomaly_score").isNotNull()).withColumn("_d", -F.col("anomaly_score"))
    return rounded(G.separation(s, "_d", "is_anomaly", min_group=10, contamination=0.05))


_TWO_MODELS = """,
m AS (SELECT 'peer_robust_z' AS model, record_id, dataset_usage, anomaly_score AS score, is_anomaly AS flag FROM fs
      UNION ALL
      SELECT 'peer_z', record_id, dataset_usage, abs(peer_z), coalesce(CAST(abs(peer_z) > 3 AS INTEGER), 0) FROM fs)"""


def _two_models(spark, sf):
    s = D.random_split(scored_table(spark, sf), "record_id", 42)
    a = s.select(F.lit("peer_robust_z").alias("model"), "record_id", "dataset_usage",
                 F.col("anomaly_score").alias("score"), F.col("is_anomaly").alias("flag"))
    b = s.select(F.lit("peer_z").alias("model"), "record_id", "dataset_usage", F.abs("peer_z").alias("score"),
                 E.rule_flag("peer_z", 3.0).alias("flag"))
    return a.unionByName(b)


_FS = f""",
fs AS (SELECT *, CASE WHEN h > 0 AND h <= 0.4 THEN 'train' WHEN h > 0.4 AND h <= 0.5 THEN 'test'
                      WHEN h > 0.5 AND h <= 0.6 THEN 'validation' WHEN h > 0.6 AND h <= 1.0 THEN 'production' END
                 AS dataset_usage
       FROM (SELECT *, {unit_hash_sql('record_id', 42)} AS h
             FROM final))"""


@register("g15_model_comparison", W + _FS + _TWO_MODELS + """,
g AS (SELECT model, count(*) AS n, avg(score) AS score_mean, stddev_pop(score) AS score_std,
             CAST(sum(flag) AS BIGINT) AS n_flagged FROM m GROUP BY model),
b AS (SELECT abs(score_mean) AS b FROM g ORDER BY model LIMIT 1),
x AS (SELECT max(abs(score_mean)) AS m1, max(1.0 / nullif(score_std, 0)) AS m2, max(n_flagged * 1.0 / n) AS m3 FROM g)
SELECT model, n, round(score_mean, 6) AS score_mean, round(score_std, 6) AS score_std, n_flagged,
       round((abs(score_mean) - b) / nullif(b, 0) * 100, 6) AS mean_change_pct,
       round(abs(score_mean) / nullif(m1, 0), 6) AS rel_abs_mean,
       round((1.0 / nullif(score_std, 0)) / nullif(m2, 0), 6) AS rel_inv_std,
       round((n_flagged * 1.0 / n) / nullif(m3, 0), 6) AS rel_flag_rate
FROM g, b, x""")
def g15(spark, sf):
    return rounded(G.model_comparison(_two_models(spark, sf), "model", "score", "flag"))


@register("g29_flagged_rate_by_split", W + _FS + _TWO_MODELS + """
SELECT dataset_usage, model, round(avg(CAST(flag AS DOUBLE)) * 100, 6) AS flagged_pct, count(*) AS n
FROM m GROUP BY 1, 2""")
def g29(spark, sf):
    return rounded(G.flagged_rate_by_split(_two_models(spark, sf), "dataset_usage", "model", "flag"))


@register("g16_dashboard_totals", W + """
SELECT count(*) AS n_total, CAST(sum(is_anomaly) AS BIGINT) AS n_anomalies,
       CAST(sum(CASE WHEN is_anomaly = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_normal,
       round(coalesce(avg(amount), 0), 6) AS avg_amount_all,
       round(coalesce(avg(CASE WHEN is_anomaly = 1 THEN amount END), 0), 6) AS avg_amount_anomaly,
       round(coalesce(avg(CASE WHEN is_anomaly = 0 THEN amount END), 0), 6) AS avg_amount_normal FROM final""")
def g16(spark, sf):
    return rounded(G.dashboard_totals(scored_table(spark, sf), "amount", "is_anomaly"))


@register("g17_flagged_by_state", W + """
SELECT CASE WHEN recipient_state IS NULL OR trim(recipient_state) = '' THEN 'Unknown' ELSE recipient_state END AS state,
       count(*) AS n_anomalies FROM final WHERE is_anomaly = 1 GROUP BY 1 ORDER BY n_anomalies DESC, state LIMIT 10""")
def g17(spark, sf):
    return G.flagged_by_state(scored_table(spark, sf), "recipient_state", "is_anomaly", 10)


@register("g19_numeric_summary_events", """
SELECT count(value) AS count, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
       round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
       min(value) AS min, max(value) AS max FROM events""", payments=False)
def g19(spark, sf):
    return rounded(G.numeric_summary(table(spark, sf, "events"), "value"))


@register("d22_first_normals", W + """
SELECT record_id, date_of_payment, round(amount, 6) AS amount FROM final WHERE is_anomaly = 0
ORDER BY date_of_payment, record_id LIMIT 500""")
def d22(spark, sf):
    s = scored_table(spark, sf).where(F.col("is_anomaly") == 0)
    return rounded(D.top_n(s, "date_of_payment", "record_id", 500).select("record_id", "date_of_payment", "amount"))


@register("g18_anomaly_pie", W + """
SELECT is_anomaly, count(*) AS n_rows FROM final GROUP BY 1""")
def g18(spark, sf):
    return scored_table(spark, sf).groupBy("is_anomaly").agg(F.count(F.lit(1)).alias("n_rows"))


@register("c37_recipient_outlier_counts", """
WITH t AS (SELECT recipient_id, coalesce(sum(amount), 0) AS x FROM payments GROUP BY 1),
q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, quantile_cont(x, 0.99) AS qp,
             avg(x) AS mu, stddev_pop(x) AS sd FROM t)
SELECT CAST(sum(CASE WHEN x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS iqr_outliers,
       CAST(sum(CASE WHEN sd > 0 AND abs(x - mu) / sd > 3 THEN 1 ELSE 0 END) AS BIGINT) AS zscore_outliers,
       CAST(sum(CASE WHEN x > qp THEN 1 ELSE 0 END) AS BIGINT) AS percentile_outliers FROM t, q""")
def c37r(spark, sf):
    """C37 as the reference applies it: on per-recipient totals."""
    from ledgerlens.sources.tables import payments

    t = payments(spark, sf, ["recipient_id", "amount"]).groupBy("recipient_id").agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_amount"))
    return P.outlier_counts(t, "total_amount")


@register("e14_recipient_density", """
WITH r AS (SELECT recipient_id, round(ln(1 + count(*)), 6) AS x, round(ln(1 + avg(amount)), 6) AS y, round(ln(1 + max(amount)), 6) AS z
           FROM payments WHERE recipient_id IS NOT NULL GROUP BY 1),
p AS (SELECT a.recipient_id AS i, b.recipient_id AS j, b.x, b.y, b.z,
             sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d
      FROM r a JOIN r b ON a.recipient_id <> b.recipient_id),
n AS (SELECT i, j, d FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, x, y, z) <= 20),
k AS (SELECT i, max(d) AS kd FROM n GROUP BY 1),
l AS (SELECT n.i, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM n JOIN k ON n.j = k.i GROUP BY 1)
SELECT n.i AS recipient_id, round(any_value(k.kd), 6) AS k_distance, round(avg(b.lrd) / any_value(a.lrd), 6) AS lof
FROM n JOIN k ON n.i = k.i JOIN l a ON n.i = a.i JOIN l b ON n.j = b.i GROUP BY 1""")
def e14(spark, sf):
    """Local outlier factor of every recipient over number, mean and largest of payments."""
    from ledgerlens.operators.density import local_density
    from ledgerlens.session import cut_lineage
    from ledgerlens.sources.tables import payments

    p = payments(spark, sf, ["recipient_id", "amount"]).where(F.col("recipient_id").isNotNull())
    ln = lambda c: F.round(F.log(1 + c), 6)
    r = cut_lineage(p.groupBy("recipient_id").agg(ln(F.count(F.lit(1))).alias("x"), ln(F.avg("amount")).alias("y"), ln(F.max("amount")).alias("z")))
    return rounded(local_density(r, ["x", "y", "z"]).select("recipient_id", "k_distance", "lof"))
