"""Registered profiling queries (C1–C39) over the payments view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import profile as P
from ledgerlens.operators.features import calendar
from ledgerlens.plans.registry import register
from ledgerlens.sources.tables import payments

STATS7 = ("count", "sum", "mean", "median", "std", "min", "max")


def _stats7_sql(by: str, value: str = "amount", where: str = "", extra_where: str = "") -> str:
    cond = f"WHERE {by} IS NOT NULL" if by else ""
    if extra_where:
        cond = (cond + " AND " if cond else "WHERE ") + extra_where
    group = f"GROUP BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return f"""
SELECT {sel}count({value}) AS amount_count,
       round_even(coalesce(sum({value}), 0), 2) AS amount_sum,
       round_even(avg({value}), 2) AS amount_mean,
       round_even(quantile_cont({value}, 0.5), 2) AS amount_median,
       round_even(stddev_samp({value}), 2) AS amount_std,
       round_even(min({value}), 2) AS amount_min,
       round_even(max({value}), 2) AS amount_max
FROM payments {cond} {group}"""


@register("c13_stats_by_recipient_type", _stats7_sql("recipient_type"))
def c13(spark, sf):
    """Minimum slice: 7 statistics per recipient type, half-even 2 d.p."""
    return P.group_stats(payments(spark, sf, ["recipient_type", "amount"]), "amount", ["recipient_type"], STATS7, 2,
                         prefix="amount_")


@register("c24_stats_by_recipient", _stats7_sql("recipient_id"))
def c24(spark, sf):
    return P.group_stats(payments(spark, sf, ["recipient_id", "amount"]), "amount", ["recipient_id"], STATS7, 2,
                         prefix="amount_")


@register("c19_state_map", """
SELECT recipient_state, round(coalesce(sum(amount), 0), 2) AS total_amount, round(avg(amount), 6) AS mean_amount,
       round(quantile_cont(amount, 0.5), 6) AS median_amount, count(*) AS n_payments
FROM payments WHERE recipient_state IS NOT NULL GROUP BY recipient_state""")
def c19(spark, sf):
    s = P.group_stats(payments(spark, sf, ["recipient_state", "amount"]), "amount", ["recipient_state"],
                      ("sum", "mean", "median", "count"), None)
    return s.select("recipient_state", F.round("sum", 2).alias("total_amount"), F.round("mean", 6).alias("mean_amount"),
                    F.round("median", 6).alias("median_amount"), F.col("count").alias("n_payments"))


@register("c11_global_stats", """
SELECT count(*) AS n_payments, round(sum(amount), 2) AS total_amount, round(avg(amount), 6) AS mean_amount,
       min(amount) AS min_amount, max(amount) AS max_amount FROM payments""")
def c11(spark, sf):
    return payments(spark, sf, ["amount"]).agg(F.count(F.lit(1)).alias("n_payments"), F.round(F.sum("amount"), 2).alias("total_amount"),
                                   F.round(F.avg("amount"), 6).alias("mean_amount"),
                                   F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"))


@register("c12_by_recipient_type_sql", """
SELECT recipient_type, count(*) AS n_payments, round(sum(amount), 2) AS total_amount,
       round(avg(amount), 6) AS mean_amount, min(amount) AS min_amount, max(amount) AS max_amount
FROM payments GROUP BY recipient_type ORDER BY total_amount DESC""")
def c12(spark, sf):
    """C12 through the SQL front end: the view is registered, Catalyst plans it."""
    payments(spark, sf, ["recipient_type", "amount"]).createOrReplaceTempView("payments")
    return spark.sql("""
        SELECT recipient_type, count(*) AS n_payments, round(sum(amount), 2) AS total_amount,
               round(avg(amount), 6) AS mean_amount, min(amount) AS min_amount, max(amount) AS max_amount
        FROM payments GROUP BY recipient_type ORDER BY total_amount DESC""")


_PERIOD4 = """
SELECT {key} AS {name}, count(amount) AS amount_count, round_even(coalesce(sum(amount), 0), 2) AS amount_sum,
       round_even(avg(amount), 2) AS amount_mean, round_even(quantile_cont(amount, 0.5), 2) AS amount_median
FROM payments WHERE date_of_payment IS NOT NULL GROUP BY {key}"""


@register("c14_by_month", _PERIOD4.format(key="month(date_of_payment)", name="payment_month"))
def c14m(spark, sf):
    return P.group_stats(calendar(payments(spark, sf, ["date_of_payment", "amount"])), "amount", ["payment_month"],
                         ("count", "sum", "mean", "median"), 2, prefix="amount_")


@register("c14_by_quarter", _PERIOD4.format(key="quarter(date_of_payment)", name="payment_quarter"))
def c14q(spark, sf):
    return P.group_stats(calendar(payments(spark, sf, ["date_of_payment", "amount"])), "amount", ["payment_quarter"],
                         ("count", "sum", "mean", "median"), 2, prefix="amount_")


@register("c15_calendar_month", """
SELECT strftime(date_of_payment, '%Y-%m') AS period, round(coalesce(sum(amount), 0), 2) AS total_amount,
       round(avg(amount), 6) AS mean_amount, count(*) AS n_payments
FROM payments WHERE date_of_payment IS NOT NULL GROUP BY 1""")
def c15(spark, sf):
    s = P.calendar_month_stats(payments(spark, sf, ["date_of_payment", "amount"]), "date_of_payment", "amount")
    return s.select("period", F.round("total_amount", 2).alias("total_amount"),
                    F.round("mean_amount", 6).alias("mean_amount"), "n_payments")


@register("c16_weekday_counts", """
WITH d(day_index, day_name) AS (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'),
                                     (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday')),
c AS (SELECT isodow(date_of_payment) - 1 AS di, count(*) AS n FROM payments
      WHERE date_of_payment IS NOT NULL GROUP BY 1)
SELECT d.day_index, d.day_name, c.n AS n_payments FROM d LEFT JOIN c ON d.day_index = c.di""")
def c16(spark, sf):
    return P.weekday_counts(payments(spark, sf, ["date_of_payment"]), "date_of_payment")


@register("c17_top_states", """
SELECT recipient_state, round(coalesce(sum(amount), 0), 2) AS total_amount, count(*) AS n_payments,
       round(avg(amount), 6) AS mean_amount
FROM payments WHERE recipient_state IS NOT NULL GROUP BY recipient_state
ORDER BY sum(amount) DESC, recipient_state LIMIT 20""")
def c17(spark, sf):
    t = P.top_groups(payments(spark, sf, ["recipient_state", "amount"]), "recipient_state", "amount", 20)
    return t.select("recipient_state", F.round("total_amount", 2).alias("total_amount"), "n_payments",
                    F.round("mean_amount", 6).alias("mean_amount"))


@register("c18_top_states_by_count", """
SELECT recipient_state, round(coalesce(sum(amount), 0), 2) AS total_amount, count(*) AS n_payments,
       round(avg(amount), 6) AS mean_amount
FROM payments WHERE recipient_state IS NOT NULL GROUP BY recipient_state
ORDER BY count(*) DESC, recipient_state LIMIT 10""")
def c18(spark, sf):
    t = P.top_groups(payments(spark, sf, ["recipient_state", "amount"]), "recipient_state", "amount", 10, order="count")
    return t.select("recipient_state", F.round("total_amount", 2).alias("total_amount"), "n_payments",
                    F.round("mean_amount", 6).alias("mean_amount"))


@register("c20_top_natures", """
SELECT nature, round(coalesce(sum(amount), 0), 2) AS total_amount, count(*) AS n_payments,
       round(avg(amount), 6) AS mean_amount
FROM payments WHERE nature IS NOT NULL GROUP BY nature ORDER BY sum(amount) DESC, nature LIMIT 15""")
def c20(spark, sf):
    t = P.top_groups(payments(spark, sf, ["nature", "amount"]), "nature", "amount", 15)
    return t.select("nature", F.round("total_amount", 2).alias("total_amount"), "n_payments",
                    F.round("mean_amount", 6).alias("mean_amount"))


@register("c21_total_by_recipient_type", """
SELECT recipient_type, round(coalesce(sum(amount), 0), 2) AS total_amount FROM payments
WHERE recipient_type IS NOT NULL GROUP BY recipient_type""")
def c21(spark, sf):
    return (payments(spark, sf, ["recipient_type", "amount"]).where(F.col("recipient_type").isNotNull()).groupBy("recipient_type")
            .agg(F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("total_amount")))


@register("c22_monthly_counts_totals", """
SELECT month(date_of_payment) AS payment_month, count(*) AS n_payments, round(sum(amount), 2) AS total_amount
FROM payments WHERE date_of_payment IS NOT NULL GROUP BY 1""")
def c22(spark, sf):
    c = calendar(payments(spark, sf, ["date_of_payment", "amount"])).where(F.col("payment_month").isNotNull())
    return c.groupBy("payment_month").agg(F.count(F.lit(1)).alias("n_payments"),
                                          F.round(F.sum("amount"), 2).alias("total_amount"))


@register("c23_quarterly_sum", """
SELECT quarter(date_of_payment) AS payment_quarter, round(sum(amount), 2) AS total_amount
FROM payments WHERE date_of_payment IS NOT NULL GROUP BY 1""")
def c23(spark, sf):
    c = calendar(payments(spark, sf, ["date_of_payment", "amount"])).where(F.col("payment_quarter").isNotNull())
    return c.groupBy("payment_quarter").agg(F.round(F.sum("amount"), 2).alias("total_amount"))


_ROLLUP_KEYS = "recipient_id, recipient_type, recipient_state"


@register("c25_recipient_rollup", f"""
WITH s AS (
  SELECT {_ROLLUP_KEYS}, count(amount) AS amount_count, round(coalesce(sum(amount), 0), 2) AS amount_sum,
         round(avg(amount), 6) AS amount_mean, round(quantile_cont(amount, 0.5), 6) AS amount_median,
         round(stddev_samp(amount), 6) AS amount_std, min(amount) AS amount_min, max(amount) AS amount_max,
         CAST(coalesce(sum(number_of_payments), 0) AS BIGINT) AS number_of_payments_sum,
         count(DISTINCT payer_id) AS payer_nunique
  FROM payments GROUP BY {_ROLLUP_KEYS}),
fc AS (SELECT {_ROLLUP_KEYS}, form, count(*) AS c FROM payments WHERE form IS NOT NULL GROUP BY ALL),
fm AS (SELECT {_ROLLUP_KEYS}, min(form) AS form_mode FROM
         (SELECT *, max(c) OVER (PARTITION BY {_ROLLUP_KEYS}) AS mc FROM fc) WHERE c = mc GROUP BY ALL),
nc AS (SELECT {_ROLLUP_KEYS}, nature, count(*) AS c FROM payments WHERE nature IS NOT NULL GROUP BY ALL),
nm AS (SELECT {_ROLLUP_KEYS}, min(nature) AS nature_mode FROM
         (SELECT *, max(c) OVER (PARTITION BY {_ROLLUP_KEYS}) AS mc FROM nc) WHERE c = mc GROUP BY ALL)
SELECT s.*, fm.form_mode, nm.nature_mode FROM s
LEFT JOIN fm ON s.recipient_id IS NOT DISTINCT FROM fm.recipient_id
   AND s.recipient_type IS NOT DISTINCT FROM fm.recipient_type
   AND s.recipient_state IS NOT DISTINCT FROM fm.recipient_state
LEFT JOIN nm ON s.recipient_id IS NOT DISTINCT FROM nm.recipient_id
   AND s.recipient_type IS NOT DISTINCT FROM nm.recipient_type
   AND s.recipient_state IS NOT DISTINCT FROM nm.recipient_state""")
def c25(spark, sf):
    r = P.recipient_rollup(payments(spark, sf, ["recipient_id", "recipient_type", "recipient_state", "amount",
                                                "number_of_payments", "payer_id", "form", "nature"]),
                           ["recipient_id", "recipient_type", "recipient_state"])
    return r.select("recipient_id", "recipient_type", "recipient_state", "amount_count",
                    F.round("amount_sum", 2).alias("amount_sum"), F.round("amount_mean", 6).alias("amount_mean"),
                    F.round("amount_median", 6).alias("amount_median"), F.round("amount_std", 6).alias("amount_std"),
                    "amount_min", "amount_max", "number_of_payments_sum", "payer_nunique", "form_mode", "nature_mode")


@register("c26_group_features", """
SELECT recipient_type, recipient_state, count(amount) AS amount_count, round(coalesce(sum(amount), 0), 2) AS amount_sum,
       round(avg(amount), 6) AS amount_mean, round(quantile_cont(amount, 0.5), 6) AS amount_median,
       round(stddev_samp(amount), 6) AS amount_std, min(amount) AS amount_min, max(amount) AS amount_max,
       CAST(coalesce(sum(number_of_payments), 0) AS BIGINT) AS number_of_payments_sum, count(DISTINCT payer_id) AS payer_nunique,
       count(DISTINCT form) AS form_nunique, count(DISTINCT nature) AS nature_nunique
FROM payments GROUP BY recipient_type, recipient_state""")
def c26(spark, sf):
    r = P.recipient_rollup(payments(spark, sf, ["recipient_type", "recipient_state", "amount", "number_of_payments",
                                                "payer_id", "form", "nature"]),
                           ["recipient_type", "recipient_state"], modal=False)
    return r.select("recipient_type", "recipient_state", "amount_count",
                    F.round("amount_sum", 2).alias("amount_sum"), F.round("amount_mean", 6).alias("amount_mean"),
                    F.round("amount_median", 6).alias("amount_median"), F.round("amount_std", 6).alias("amount_std"),
                    "amount_min", "amount_max", "number_of_payments_sum", "payer_nunique", "form_nunique",
                    "nature_nunique")


_HIST = """
WITH src AS (SELECT {x} AS x FROM payments WHERE amount IS NOT NULL {cond}),
r AS (SELECT min(x) AS lo, max(x) AS hi FROM src),
b AS (SELECT CAST(CASE WHEN r.hi > r.lo THEN least(floor((x - r.lo) / ((r.hi - r.lo) / {bins})), {bins} - 1)
                        ELSE 0 END AS INTEGER) AS bin, count(*) AS n
      FROM src, r GROUP BY 1),
e AS (SELECT CAST(i AS INTEGER) AS bin FROM range({bins}) t(i))
SELECT e.bin, round(CASE WHEN r.hi > r.lo THEN r.lo + e.bin * ((r.hi - r.lo) / {bins})
                         ELSE r.lo - 0.5 + e.bin / {bins} END, 6) AS bin_lo,
       round(CASE WHEN r.hi > r.lo THEN r.lo + (e.bin + 1) * ((r.hi - r.lo) / {bins})
                  ELSE r.lo - 0.5 + (e.bin + 1) / {bins} END, 6) AS bin_hi,
       coalesce(b.n, 0) AS count
FROM e CROSS JOIN r LEFT JOIN b ON e.bin = b.bin WHERE r.lo IS NOT NULL"""


@register("c27_amount_histogram", _HIST.format(x="amount", cond="", bins=50))
def c27(spark, sf):
    h = P.histogram(payments(spark, sf, ["amount"]), "amount", 50)
    return h.select("bin", F.round("bin_lo", 6).alias("bin_lo"), F.round("bin_hi", 6).alias("bin_hi"), "count")


@register("c28_log_amount_histogram", _HIST.format(x="log10(amount)", cond="AND amount > 0", bins=50))
def c28(spark, sf):
    h = P.histogram(payments(spark, sf, ["amount"]), "amount", 50, log10=True)
    return h.select("bin", F.round("bin_lo", 6).alias("bin_lo"), F.round("bin_hi", 6).alias("bin_hi"), "count")


@register("c29_box_by_recipient_type", """
WITH src AS (SELECT recipient_type, ln(1 + amount) AS x FROM payments WHERE amount > 0 AND recipient_type IS NOT NULL),
q AS (SELECT recipient_type, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
             quantile_cont(x, 0.75) AS q3 FROM src GROUP BY 1)
SELECT q.recipient_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(CASE WHEN x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN x END), 6) AS whisker_lo,
       round(max(CASE WHEN x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN x END), 6) AS whisker_hi,
       CAST(sum(CASE WHEN x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT)
         AS n_outliers,
       count(*) AS n
FROM src JOIN q USING (recipient_type) GROUP BY q.recipient_type, q1, median, q3""")
def c29(spark, sf):
    b = P.box_summary(payments(spark, sf, ["recipient_type", "amount"]), "amount", "recipient_type")
    return b.select("recipient_type", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "whisker_lo",
                                                                            "whisker_hi")], "n_outliers", "n")


CORR_COLS = ["amount", "number_of_payments", "payment_month", "payment_dayofweek", "payment_quarter"]


def _corr_sql(strong: bool) -> str:
    cols = CORR_COLS
    feats = """calendar AS (SELECT amount, number_of_payments, month(date_of_payment) AS payment_month,
        isodow(date_of_payment) - 1 AS payment_dayofweek, quarter(date_of_payment) AS payment_quarter FROM payments)"""
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if strong and not i < j:
                continue
            src = "" if i == j else " FROM calendar"
            r = "1.0" if i == j else f"corr({a}, {b})"
            parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round({r}, 6) AS r{src}")
    body = "\nUNION ALL\n".join(parts)
    if strong:
        return f"WITH {feats}, allr AS ({body}) SELECT * FROM allr WHERE abs(r) > 0.7"
    return f"WITH {feats}\n{body}"


@register("c30_correlation_matrix", _corr_sql(False))
def c30(spark, sf):
    c = P.correlation_matrix(calendar(payments(spark, sf, ["amount", "number_of_payments", "date_of_payment"])), CORR_COLS)
    return c.select("feature_a", "feature_b", F.round("r", 6).alias("r"))


@register("c31_strong_correlations", _corr_sql(True))
def c31(spark, sf):
    c = P.correlation_matrix(calendar(payments(spark, sf, ["amount", "number_of_payments", "date_of_payment"])), CORR_COLS)
    s = P.strong_correlations(c, CORR_COLS, 0.7)
    return s.select("feature_a", "feature_b", F.round("r", 6).alias("r"))


@register("c32_pivot_mean", """
WITH tr AS (SELECT specialty FROM payments WHERE specialty IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10),
tc AS (SELECT recipient_state FROM payments WHERE recipient_state IS NOT NULL GROUP BY 1
       ORDER BY count(*) DESC, 1 LIMIT 10)
SELECT specialty, recipient_state, round(avg(amount), 6) AS mean_amount FROM payments
WHERE specialty IN (SELECT specialty FROM tr) AND recipient_state IN (SELECT recipient_state FROM tc)
GROUP BY 1, 2""")
def c32(spark, sf):
    p = P.pivot_mean(payments(spark, sf, ["specialty", "recipient_state", "amount"]), "specialty", "recipient_state", "amount", 10, 10)
    return p.select("specialty", "recipient_state", F.round("mean_amount", 6).alias("mean_amount"))


@register("c33_hierarchy_totals", """
SELECT recipient_type, recipient_state, form, round(coalesce(sum(amount), 0), 2) AS total_amount, count(*) AS n_payments,
       3 - (grouping(recipient_type) + grouping(recipient_state) + grouping(form)) AS level
FROM payments GROUP BY ROLLUP (recipient_type, recipient_state, form)""")
def c33(spark, sf):
    h = P.hierarchy_totals(payments(spark, sf, ["recipient_type", "recipient_state", "form", "amount"]), ["recipient_type", "recipient_state", "form"], "amount")
    return h.select("recipient_type", "recipient_state", "form", F.round("total_amount", 2).alias("total_amount"),
                    "n_payments", "level")


@register("c34_normalized_group_means", """
WITH m AS (SELECT recipient_type, avg(amount) AS amount, avg(number_of_payments) AS number_of_payments
           FROM payments GROUP BY recipient_type),
b AS (SELECT min(amount) AS la, max(amount) AS ha, min(number_of_payments) AS ln, max(number_of_payments) AS hn FROM m)
SELECT recipient_type, round(CASE WHEN ha > la THEN (amount - la) / (ha - la) ELSE 0 END, 6) AS amount,
       round(CASE WHEN hn > ln THEN (number_of_payments - ln) / (hn - ln) ELSE 0 END, 6) AS number_of_payments
FROM m, b""")
def c34(spark, sf):
    n = P.normalized_group_means(payments(spark, sf, ["recipient_type", "amount", "number_of_payments"]), "recipient_type", ["amount", "number_of_payments"])
    return n.select("recipient_type", F.round("amount", 6).alias("amount"),
                    F.round("number_of_payments", 6).alias("number_of_payments"))


@register("c35_category_index", """
SELECT specialty, CAST(dense_rank() OVER (ORDER BY specialty) - 1 AS BIGINT) AS category_index
FROM (SELECT DISTINCT specialty FROM payments WHERE specialty IS NOT NULL)""")
def c35(spark, sf):
    return P.category_index(payments(spark, sf, ["record_id", "specialty"]), "specialty")


@register("c36_axis_ranges", """
SELECT 'amount' AS column, quantile_cont(amount, 0.01) AS range_lo, quantile_cont(amount, 0.99) AS range_hi FROM payments
UNION ALL
SELECT 'number_of_payments', quantile_cont(number_of_payments, 0.01), quantile_cont(number_of_payments, 0.99) FROM payments""")
def c36(spark, sf):
    return P.axis_ranges(payments(spark, sf, ["amount", "number_of_payments"]), ["amount", "number_of_payments"])


@register("c37_outlier_counts", """
WITH s AS (SELECT coalesce(amount, 0) AS x FROM payments),
q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, quantile_cont(x, 0.99) AS qp,
             avg(x) AS mu, stddev_pop(x) AS sd FROM s)
SELECT CAST(sum(CASE WHEN x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT)
         AS iqr_outliers,
       CAST(sum(CASE WHEN sd > 0 AND abs(x - mu) / sd > 3 THEN 1 ELSE 0 END) AS BIGINT) AS zscore_outliers,
       CAST(sum(CASE WHEN x > qp THEN 1 ELSE 0 END) AS BIGINT) AS percentile_outliers
FROM s, q""")
def c37(spark, sf):
    return P.outlier_counts(payments(spark, sf, ["amount"]), "amount")


@register("c38_period_group", """
SELECT quarter(date_of_payment) AS period, recipient_type, count(*) AS n_payments,
       round(coalesce(sum(amount), 0), 2) AS total_amount, round(avg(amount), 6) AS mean_amount
FROM payments GROUP BY 1, 2""")
def c38(spark, sf):
    g = P.period_group_stats(payments(spark, sf, ["date_of_payment", "recipient_type", "amount"]), F.quarter("date_of_payment"), "recipient_type", "amount")
    return g.select("period", "recipient_type", "n_payments", F.round("total_amount", 2).alias("total_amount"),
                    F.round("mean_amount", 6).alias("mean_amount"))


@register("c39_recipient_month", """
SELECT strftime(date_of_payment, '%Y-%m') AS period, recipient_id, count(*) AS n_payments,
       round(coalesce(sum(amount), 0), 2) AS total_amount, round(avg(amount), 6) AS mean_amount
FROM payments GROUP BY 1, 2""")
def c39(spark, sf):
    g = P.period_group_stats(payments(spark, sf, ["date_of_payment", "recipient_id", "amount"]), F.date_format("date_of_payment", "yyyy-MM"), "recipient_id", "amount")
    return g.select("period", "recipient_id", "n_payments", F.round("total_amount", 2).alias("total_amount"),
                    F.round("mean_amount", 6).alias("mean_amount"))


@register("c1_basic_stats", """
SELECT count(*) AS n_rows, 12 AS n_columns, 4 AS n_numeric_columns, 7 AS n_categorical_columns,
       1 AS n_datetime_columns,
       CAST(sum((record_id IS NULL)::INT + (recipient_id IS NULL)::INT + (recipient_type IS NULL)::INT
           + (recipient_state IS NULL)::INT + (specialty IS NULL)::INT + (payer_id IS NULL)::INT
           + (payer_name IS NULL)::INT + (amount IS NULL OR isnan(amount))::INT + (number_of_payments IS NULL)::INT
           + (date_of_payment IS NULL)::INT + (form IS NULL)::INT + (nature IS NULL)::INT) AS BIGINT) AS missing_values,
       round(100.0 * sum((record_id IS NULL)::INT + (recipient_id IS NULL)::INT + (recipient_type IS NULL)::INT
           + (recipient_state IS NULL)::INT + (specialty IS NULL)::INT + (payer_id IS NULL)::INT
           + (payer_name IS NULL)::INT + (amount IS NULL OR isnan(amount))::INT + (number_of_payments IS NULL)::INT
           + (date_of_payment IS NULL)::INT + (form IS NULL)::INT + (nature IS NULL)::INT) / (count(*) * 12), 6)
           AS missing_percentage,
       (SELECT count(*) - count(DISTINCT (record_id, recipient_id, recipient_type, recipient_state, specialty, payer_id,
               payer_name, amount, number_of_payments, date_of_payment, form, nature)) FROM payments) AS duplicate_rows
FROM payments""")
def c1(spark, sf):
    return P.basic_stats(payments(spark, sf))


@register("c2_duplicate_rows", """
SELECT CAST(count(*) - count(DISTINCT (recipient_type, recipient_state, form, nature)) AS BIGINT) AS duplicate_rows
FROM payments""")
def c2(spark, sf):
    """Duplicates on a 4-column projection (the whole rows are unique)."""
    return P.duplicate_rows(payments(spark, sf, ["recipient_type", "recipient_state", "form", "nature"]))


@register("c3_missing_summary", """
WITH n AS (SELECT count(*) AS n FROM payments),
m AS (
  SELECT 'record_id' AS "column", 'string' AS data_type, count(*) - count(record_id) AS missing_count FROM payments
  UNION ALL SELECT 'recipient_id', 'bigint', count(*) - count(recipient_id) FROM payments
  UNION ALL SELECT 'recipient_type', 'string', count(*) - count(recipient_type) FROM payments
  UNION ALL SELECT 'recipient_state', 'string', count(*) - count(recipient_state) FROM payments
  UNION ALL SELECT 'specialty', 'string', count(*) - count(specialty) FROM payments
  UNION ALL SELECT 'payer_id', 'bigint', count(*) - count(payer_id) FROM payments
  UNION ALL SELECT 'payer_name', 'string', count(*) - count(payer_name) FROM payments
  UNION ALL SELECT 'amount', 'double', sum(CASE WHEN amount IS NULL OR isnan(amount) THEN 1 ELSE 0 END) FROM payments
  UNION ALL SELECT 'number_of_payments', 'bigint', count(*) - count(number_of_payments) FROM payments
  UNION ALL SELECT 'date_of_payment', 'timestamp_ntz', count(*) - count(date_of_payment) FROM payments
  UNION ALL SELECT 'form', 'string', count(*) - count(form) FROM payments
  UNION ALL SELECT 'nature', 'string', count(*) - count(nature) FROM payments)
SELECT "column", CAST(missing_count AS BIGINT) AS missing_count,
       round_even(missing_count * 100.0 / n, 2) AS missing_percentage, data_type FROM m, n""")
def c3(spark, sf):
    return P.missing_summary(payments(spark, sf), only_missing=False)


@register("c5_value_counts_nature", """
SELECT nature AS value, count(*) AS count, round_even(count(*) * 100.0 / (SELECT count(*) FROM payments), 2) AS percentage
FROM payments WHERE nature IS NOT NULL GROUP BY nature ORDER BY count DESC, value LIMIT 10""")
def c5(spark, sf):
    return P.value_counts(payments(spark, sf, ["nature"]), "nature", 10)


@register("c6_categorical_profile", """
SELECT 'recipient_type' AS column, count(DISTINCT recipient_type) AS n_unique, count(*) - count(recipient_type) AS n_missing FROM payments
UNION ALL SELECT 'recipient_state', count(DISTINCT recipient_state), count(*) - count(recipient_state) FROM payments
UNION ALL SELECT 'specialty', count(DISTINCT specialty), count(*) - count(specialty) FROM payments
UNION ALL SELECT 'form', count(DISTINCT form), count(*) - count(form) FROM payments
UNION ALL SELECT 'nature', count(DISTINCT nature), count(*) - count(nature) FROM payments""")
def c6(spark, sf):
    return P.categorical_profile(payments(spark, sf, ["recipient_type", "recipient_state", "specialty", "form", "nature"]), ["recipient_type", "recipient_state", "specialty", "form", "nature"])


@register("c7_quality_report", """
SELECT CAST(count(*) * 12 AS BIGINT) AS total_cells, CAST(sum(
         (recipient_type IS NULL)::INT + (recipient_state IS NULL)::INT + (specialty IS NULL)::INT
         + (payer_name IS NULL)::INT + (amount IS NULL)::INT + (date_of_payment IS NULL)::INT + (form IS NULL)::INT
         + (nature IS NULL)::INT + (record_id IS NULL)::INT + (recipient_id IS NULL)::INT + (payer_id IS NULL)::INT
         + (number_of_payments IS NULL)::INT) AS BIGINT) AS missing_cells,
       round(100.0 - sum(
         (recipient_type IS NULL)::INT + (recipient_state IS NULL)::INT + (specialty IS NULL)::INT
         + (payer_name IS NULL)::INT + (amount IS NULL)::INT + (date_of_payment IS NULL)::INT + (form IS NULL)::INT
         + (nature IS NULL)::INT + (record_id IS NULL)::INT + (recipient_id IS NULL)::INT + (payer_id IS NULL)::INT
         + (number_of_payments IS NULL)::INT) * 100.0 / (count(*) * 12), 6) AS completeness_rate,
       (SELECT CAST(count(*) - count(DISTINCT (record_id, recipient_id, recipient_type, recipient_state, specialty,
               payer_id, payer_name, amount, number_of_payments, date_of_payment, form, nature)) AS BIGINT)
        FROM payments) AS duplicate_rows,
       round((SELECT count(*) - count(DISTINCT (record_id, recipient_id, recipient_type, recipient_state, specialty,
               payer_id, payer_name, amount, number_of_payments, date_of_payment, form, nature)) FROM payments)
             * 100.0 / count(*), 6) AS duplicate_percentage,
       CAST(sum((amount < 0)::INT) AS BIGINT) AS negative_payments,
       CAST(sum((amount = 0)::INT) AS BIGINT) AS zero_payments,
       CAST(sum((date_of_payment > TIMESTAMP '2025-01-01')::INT) AS BIGINT) AS future_dates
FROM payments""")
def c7(spark, sf):
    return P.quality_report(payments(spark, sf), "amount", "date_of_payment", "2025-01-01")


@register("c9_describe", """
SELECT 'amount' AS column, count(amount) AS count, round(avg(amount), 6) AS mean, round(stddev_samp(amount), 6) AS std,
       min(amount) AS min, round(quantile_cont(amount, 0.25), 6) AS p25, round(quantile_cont(amount, 0.5), 6) AS p50,
       round(quantile_cont(amount, 0.75), 6) AS p75, round(quantile_cont(amount, 0.9), 6) AS p90,
       round(quantile_cont(amount, 0.95), 6) AS p95, round(quantile_cont(amount, 0.99), 6) AS p99, max(amount) AS max,
       round(skewness(amount), 6) AS skewness, round(kurtosis(amount), 6) AS kurtosis FROM payments
UNION ALL
SELECT 'number_of_payments', count(number_of_payments), round(avg(number_of_payments), 6),
       round(stddev_samp(number_of_payments), 6), min(number_of_payments),
       round(quantile_cont(number_of_payments, 0.25), 6), round(quantile_cont(number_of_payments, 0.5), 6),
       round(quantile_cont(number_of_payments, 0.75), 6), round(quantile_cont(number_of_payments, 0.9), 6),
       round(quantile_cont(number_of_payments, 0.95), 6), round(quantile_cont(number_of_payments, 0.99), 6),
       max(number_of_payments), round(skewness(number_of_payments), 6), round(kurtosis(number_of_payments), 6)
FROM payments""")
def c9(spark, sf):
    d = P.describe(payments(spark, sf, ["amount", "number_of_payments"]), ["amount", "number_of_payments"])
    r = [c for c in d.columns if c not in ("column", "count", "min", "max")]
    return d.select("column", "count", *[F.round(c, 6).alias(c) for c in r], "min", "max").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "p90", "p95", "p99", "max", "skewness", "kurtosis")
