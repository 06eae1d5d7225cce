"""Registered feature-engineering queries (D1–D21) and the flagship."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.functions.stats import unit_hash_sql
from ledgerlens.operators import features as D
from ledgerlens.plans.flagship import (FEATURES_SQL, FLAGSHIP_SQL, PEER_SQL, PEERS, cleaned_payments,
                                       feature_table, flagship, rounded)
from ledgerlens.plans.registry import register
from ledgerlens.sources.tables import payments

register("flagship_peer_outliers", FLAGSHIP_SQL)(flagship)


def _round_sql(cols, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


@register("d1_calendar", """
SELECT record_id, year(date_of_payment) AS payment_year, month(date_of_payment) AS payment_month,
       quarter(date_of_payment) AS payment_quarter, isodow(date_of_payment) - 1 AS payment_dayofweek,
       CAST(isodow(date_of_payment) >= 6 AS INTEGER) AS is_weekend FROM payments""")
def d1(spark, sf):
    return D.calendar(payments(spark, sf, ["record_id", "date_of_payment"])).select("record_id", "payment_year", "payment_month", "payment_quarter",
                                                  "payment_dayofweek", "is_weekend")


_SPLIT_SQL = f"""
split AS (SELECT *, {unit_hash_sql('record_id', 42)} AS h FROM payments),
labelled AS (SELECT *, CASE WHEN h > 0 AND h <= 0.4 THEN 'train' WHEN h > 0.4 AND h <= 0.5 THEN 'test'
                            WHEN h > 0.5 AND h <= 0.6 THEN 'validation' WHEN h > 0.6 AND h <= 1.0 THEN 'production'
                       END AS dataset_usage FROM split)"""


@register("d2_random_split", f"WITH {_SPLIT_SQL} SELECT record_id, dataset_usage FROM labelled")
def d2(spark, sf):
    return D.random_split(payments(spark, sf, ["record_id"]), "record_id", 42).select("record_id", "dataset_usage")


@register("d3_split_shares", f"""WITH {_SPLIT_SQL}
SELECT dataset_usage, count(*) AS n_rows, round(count(*) * 100.0 / (SELECT count(*) FROM labelled), 6) AS pct
FROM labelled GROUP BY 1""")
def d3(spark, sf):
    return D.split_shares(D.random_split(payments(spark, sf, ["record_id"]), "record_id", 42))


@register("d4_recipient_history_train", f"""WITH {_SPLIT_SQL}
SELECT recipient_id, count(amount) AS hist_pay_count, round(coalesce(sum(amount), 0), 2) AS hist_pay_total,
       round(avg(amount), 6) AS hist_pay_avg, round(stddev_samp(amount), 6) AS hist_pay_std, max(amount) AS hist_pay_max
FROM labelled WHERE dataset_usage = 'train' AND recipient_id IS NOT NULL GROUP BY recipient_id""")
def d4(spark, sf):
    train = D.random_split(payments(spark, sf, ["record_id", "recipient_id", "amount"])).where(F.col("dataset_usage") == "train")
    h = D.recipient_history(train)
    return h.select("recipient_id", "hist_pay_count", F.round("hist_pay_total", 2).alias("hist_pay_total"),
                    F.round("hist_pay_avg", 6).alias("hist_pay_avg"), F.round("hist_pay_std", 6).alias("hist_pay_std"),
                    "hist_pay_max")


_RATIO_COLS = ["hist_pay_count", "hist_pay_total", "hist_pay_avg", "hist_pay_std", "hist_pay_max",
               "amt_to_avg_ratio", "amt_to_max_ratio"]


@register("d6_random_history_features", f"""WITH {_SPLIT_SQL},
train AS (SELECT * FROM labelled WHERE dataset_usage = 'train'),
gm AS (SELECT quantile_cont(amount, 0.5) AS gm FROM train),
hist AS (SELECT recipient_id, count(amount) AS c, coalesce(sum(amount), 0) AS t, avg(amount) AS a,
                stddev_samp(amount) AS s, max(amount) AS m FROM train WHERE recipient_id IS NOT NULL GROUP BY 1),
j AS (SELECT l.record_id, l.dataset_usage, l.amount, h.c, h.t, h.a, h.s, h.m, gm.gm
      FROM labelled l LEFT JOIN hist h ON l.recipient_id = h.recipient_id, gm)
SELECT record_id, dataset_usage,
       round(CAST(coalesce(c, 0) AS DOUBLE), 6) AS hist_pay_count, round(coalesce(t, 0), 6) AS hist_pay_total,
       round(coalesce(a, gm), 6) AS hist_pay_avg, round(coalesce(s, 0), 6) AS hist_pay_std,
       round(coalesce(m, 0), 6) AS hist_pay_max,
       round(coalesce(CASE WHEN a <> 0 THEN amount / a END, CASE WHEN gm <> 0 THEN amount / gm END), 6) AS amt_to_avg_ratio,
       round(coalesce(CASE WHEN m <> 0 THEN amount / m END, 0), 6) AS amt_to_max_ratio,
       CAST(a IS NULL AS INTEGER) AS is_new_recipient
FROM j""")
def d6(spark, sf):
    f = D.random_history_features(payments(spark, sf, ["record_id", "recipient_id", "amount"]))
    return rounded(f.select("record_id", "dataset_usage", *_RATIO_COLS, "is_new_recipient"))


@register("d9_time_history_features", "WITH " + FEATURES_SQL + """
SELECT record_id, recipient_id, payment_year, payment_month, payment_quarter, payment_dayofweek, is_weekend,
       is_high_risk_nature, is_new_recipient, """ + _round_sql(["amount", *_RATIO_COLS]) + """
FROM features""")
def d9(spark, sf):
    return rounded(feature_table(spark, sf).select("record_id", "recipient_id", "payment_year", "payment_month", "payment_quarter",
                            "payment_dayofweek", "is_weekend", "is_high_risk_nature", "is_new_recipient", "amount",
                            *_RATIO_COLS))


@register("d11_peer_scores", "WITH " + PEER_SQL + """
SELECT record_id, """ + _round_sql(["peer_mean", "peer_std", "peer_median", "peer_mad", "peer_z", "peer_robust_z"]) + """
FROM scored""")
def d11(spark, sf):
    f = D.peer_scores(feature_table(spark, sf), "amount", PEERS)
    return rounded(f.select("record_id", "peer_mean", "peer_std", "peer_median", "peer_mad", "peer_z", "peer_robust_z"))


@register("d12_frequency_encoding", """
SELECT record_id, round(CAST(count(*) OVER (PARTITION BY specialty) AS DOUBLE) / count(*) OVER (), 6) AS specialty_freq
FROM payments""")
def d12(spark, sf):
    return D.frequency_encode(payments(spark, sf, ["record_id", "specialty"]), "specialty").select(
        "record_id", F.round("specialty_freq", 6).alias("specialty_freq"))


@register("d13_relationship_features", """
WITH div AS (SELECT recipient_id, count(DISTINCT payer_id) AS payer_diversity FROM payments GROUP BY 1),
rel AS (SELECT recipient_id, payer_id, count(*) AS relationship_count FROM payments GROUP BY 1, 2),
prev AS (SELECT record_id, recipient_id, payer_id, amount,
                lag(amount) OVER (PARTITION BY recipient_id ORDER BY date_of_payment, record_id) AS prev_amount
         FROM payments)
SELECT p.record_id, d.payer_diversity, r.relationship_count, p.prev_amount,
       round(CASE WHEN p.prev_amount <> 0 THEN p.amount / p.prev_amount END, 6) AS amount_change_ratio
FROM prev p LEFT JOIN div d ON p.recipient_id IS NOT DISTINCT FROM d.recipient_id
LEFT JOIN rel r ON p.recipient_id IS NOT DISTINCT FROM r.recipient_id AND p.payer_id IS NOT DISTINCT FROM r.payer_id""")
def d13(spark, sf):
    r = D.relationship_features(payments(spark, sf, ["record_id", "recipient_id", "payer_id", "date_of_payment", "amount"]))
    return r.select("record_id", "payer_diversity", "relationship_count", "prev_amount",
                    F.round("amount_change_ratio", 6).alias("amount_change_ratio"))


SCALE_COLS = ["amount", "number_of_payments", "hist_pay_count", "hist_pay_avg", "hist_pay_max", "amt_to_avg_ratio",
              "amt_to_max_ratio", "payment_month"]


def _scale_sql(kind: str) -> str:
    parts = []
    for c in SCALE_COLS:
        if kind == "robust":
            parts.append(f"""SELECT '{c}' AS "column", round(quantile_cont({c}, 0.5), 6) AS center,
       round(CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 THEN 1.0
                  ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END, 6) AS scale FROM features""")
        else:
            parts.append(f"""SELECT '{c}' AS "column", round(CAST(min({c}) AS DOUBLE), 6) AS center,
       round(CAST(max({c}) - min({c}) AS DOUBLE), 6) AS scale FROM features""")
    return "WITH " + FEATURES_SQL + "\n" + "\nUNION ALL\n".join(parts)


@register("d14_robust_scale_params", _scale_sql("robust"))
def d14(spark, sf):
    return rounded(D.robust_scale_fit(feature_table(spark, sf), SCALE_COLS))


@register("d15_minmax_params", _scale_sql("minmax"))
def d15(spark, sf):
    return rounded(D.minmax_fit(feature_table(spark, sf), SCALE_COLS))


@register("d14_robust_scaled_features", "WITH " + FEATURES_SQL + """,
p AS (SELECT quantile_cont(amount, 0.5) AS ca, quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25) AS ia,
             quantile_cont(amt_to_avg_ratio, 0.5) AS cr,
             quantile_cont(amt_to_avg_ratio, 0.75) - quantile_cont(amt_to_avg_ratio, 0.25) AS ir FROM features)
SELECT record_id, round((amount - ca) / CASE WHEN ia = 0 THEN 1.0 ELSE ia END, 6) AS amount,
       round((amt_to_avg_ratio - cr) / CASE WHEN ir = 0 THEN 1.0 ELSE ir END, 6) AS amt_to_avg_ratio
FROM features, p""")
def d14_apply(spark, sf):
    f = feature_table(spark, sf)
    cols = ["amount", "amt_to_avg_ratio"]
    return rounded(D.scale_apply(f, D.robust_scale_fit(f, cols), cols).select("record_id", *cols))


@register("d16_exact_split", f"""
WITH h AS (SELECT record_id, {unit_hash_sql('record_id', 42)} AS h FROM payments),
r AS (SELECT record_id, row_number() OVER (ORDER BY h, record_id) AS rn, count(*) OVER () AS n FROM h)
SELECT record_id, CAST(rn <= n - ceil(n * 0.2) AS INTEGER) AS is_train FROM r""")
def d16(spark, sf):
    return D.exact_split(payments(spark, sf, ["record_id"]), "record_id", 0.2, 42).select("record_id", "is_train")


@register("d17_stratified_split", f"""
WITH h AS (SELECT record_id, form, {unit_hash_sql('record_id', 7)} AS h FROM payments),
r AS (SELECT record_id, row_number() OVER (PARTITION BY form ORDER BY h, record_id) AS rn,
             count(*) OVER (PARTITION BY form) AS n FROM h)
SELECT record_id, CAST(rn <= n - ceil(n * 0.2) AS INTEGER) AS is_train FROM r""")
def d17(spark, sf):
    return D.exact_split(payments(spark, sf, ["record_id", "form"]), "record_id", 0.2, 7, label="form").select("record_id", "is_train")


@register("d18_amount_percentile", """
SELECT record_id, round((rank() OVER (ORDER BY amount) + (count(*) OVER (PARTITION BY amount) - 1) / 2.0)
                        / count(*) OVER () * 100.0, 6) AS amount_percentile FROM payments""")
def d18(spark, sf):
    p = D.score_percentile(payments(spark, sf, ["record_id", "amount"]), "amount", "amount_percentile")
    return p.select("record_id", F.round("amount_percentile", 6).alias("amount_percentile"))


@register("d19_cumulative_share", """
WITH t AS (SELECT recipient_type, sum(amount) AS total FROM payments GROUP BY 1)
SELECT recipient_type, round(total, 2) AS total_amount,
       round(sum(total) OVER (ORDER BY total DESC, recipient_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             / sum(total) OVER (), 6) AS cumulative_share FROM t""")
def d19(spark, sf):
    t = payments(spark, sf, ["recipient_type", "amount"]).groupBy("recipient_type").agg(F.sum("amount").alias("total"))
    s = D.cumulative_share(t, "total", "recipient_type")
    return s.select("recipient_type", F.round("total", 2).alias("total_amount"),
                    F.round("cumulative_share", 6).alias("cumulative_share"))


@register("d20_top_amounts", """
SELECT record_id, recipient_id, payer_name, amount, nature FROM payments ORDER BY amount DESC, record_id LIMIT 10""")
def d20(spark, sf):
    t = D.top_n(payments(spark, sf, ["record_id", "recipient_id", "payer_name", "amount", "nature"]), "amount", "record_id", 10, ascending=False)
    return t.select("record_id", "recipient_id", "payer_name", "amount", "nature")


@register("d21_every_kth", """
WITH r AS (SELECT record_id, amount, row_number() OVER (ORDER BY amount, record_id) AS rn, count(*) OVER () AS n
           FROM payments)
SELECT record_id, amount, CAST(rn - 1 AS BIGINT) AS point_index FROM r
WHERE (rn - 1) % greatest(CAST(ceil(n / 100.0) AS BIGINT), 1) = 0""")
def d21(spark, sf):
    k = D.every_kth(payments(spark, sf, ["record_id", "amount"]), "amount", "record_id", 100)
    return k.select("record_id", "amount", "point_index")


@register("d10_time_split", """
SELECT CASE WHEN date_of_payment < TIMESTAMP '1999-10-01' THEN 'train'
            WHEN date_of_payment < TIMESTAMP '2000-10-01' THEN 'validation'
            WHEN date_of_payment IS NOT NULL THEN 'test' END AS time_split, count(*) AS n_rows
FROM payments GROUP BY 1""")
def d10(spark, sf):
    s = D.time_split(payments(spark, sf, ["date_of_payment"]), "date_of_payment", "1999-10-01", "2000-10-01")
    return s.groupBy("time_split").agg(F.count(F.lit(1)).alias("n_rows"))


@register("d13_rolling_30d", """
WITH daily AS (SELECT recipient_id, CAST(date_of_payment AS DATE) AS day, count(amount) AS n,
                      coalesce(sum(amount), 0) AS s FROM payments
               WHERE recipient_id IS NOT NULL AND date_of_payment IS NOT NULL GROUP BY 1, 2)
SELECT recipient_id, day,
       CAST(sum(n) OVER w AS BIGINT) AS n_payments_30d, round(sum(s) OVER w, 2) AS total_amount_30d
FROM daily WINDOW w AS (PARTITION BY recipient_id ORDER BY day RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)""")
def d13r(spark, sf):
    r = D.rolling_sums(payments(spark, sf, ["recipient_id", "date_of_payment", "amount"]))
    return r.withColumn("total_amount_30d", F.round("total_amount_30d", 2))


#: payment days before it give the level, those from it on are watched
CHANGE_SINCE = "1999-01-01"


@register("d13_sudden_changes", f"""
WITH daily AS (SELECT recipient_id, CAST(date_of_payment AS DATE) AS day, sum(CAST(round(amount * 100) AS BIGINT)) AS x FROM payments
               WHERE recipient_id IS NOT NULL AND date_of_payment IS NOT NULL AND amount IS NOT NULL GROUP BY 1, 2),
base AS (SELECT recipient_id, count(*) AS n, CAST(sum(x) AS DOUBLE) / count(*) AS mean,
                CASE WHEN count(*) * sum(x * x) - sum(x) * sum(x) > 0
                     THEN sqrt(CAST(count(*) * sum(x * x) - sum(x) * sum(x) AS DOUBLE) / CAST(count(*) * (count(*) - 1) AS DOUBLE)) END AS sd
         FROM daily WHERE day < DATE '{CHANGE_SINCE}' GROUP BY 1),
z AS (SELECT d.recipient_id, day, n, mean, sd,
             CASE WHEN sd IS NOT NULL THEN greatest(least((CAST(x AS DOUBLE) - mean) / sd, 1e6), -1e6) END AS z
      FROM daily AS d LEFT JOIN base USING (recipient_id) WHERE day >= DATE '{CHANGE_SINCE}'),
p AS (SELECT *, sum(CAST(round((z - 0.5::DOUBLE) * 1e6) AS BIGINT)) OVER w AS pu, sum(CAST(round((-z - 0.5::DOUBLE) * 1e6) AS BIGINT)) OVER w AS pd
      FROM z WINDOW w AS (PARTITION BY recipient_id ORDER BY day ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, pu - least(0, min(pu) OVER w) AS su, pd - least(0, min(pd) OVER w) AS sl
      FROM p WINDOW w AS (PARTITION BY recipient_id ORDER BY day ROWS UNBOUNDED PRECEDING))
SELECT recipient_id, count(*) AS n_days, coalesce(max(n), 0) AS base_days, round(max(mean) / 100, 6) AS level,
       round(CASE WHEN max(sd) IS NOT NULL THEN CAST(max(su) AS DOUBLE) / 1e6 END, 6) AS up_max,
       round(CASE WHEN max(sd) IS NOT NULL THEN CAST(max(sl) AS DOUBLE) / 1e6 END, 6) AS down_max,
       CAST(min(day) FILTER (sd IS NOT NULL AND su > 5000000) AS VARCHAR) AS up_since,
       CAST(min(day) FILTER (sd IS NOT NULL AND sl > 5000000) AS VARCHAR) AS down_since
FROM s GROUP BY 1""")
def d13_changes(spark, sf):
    out = D.sudden_changes(payments(spark, sf, ["recipient_id", "date_of_payment", "amount"]), CHANGE_SINCE)
    return rounded(out.withColumns({c: F.col(c).cast("string") for c in ("up_since", "down_since")}))
