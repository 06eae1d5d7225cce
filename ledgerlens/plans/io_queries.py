"""Registered source, cleaning, monitoring and streaming queries
(A1–A17, B9–B24, G20–G26, ST1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.stats import group_mode, unit_hash_sql
from ledgerlens.operators import clean as C
from ledgerlens.operators import features as D
from ledgerlens.operators import monitor as MON
from ledgerlens.operators import profile as P
from ledgerlens.plans.flagship import (CLEAN_SQL, FEATURES_SQL, SCORED_SQL, feature_table,
                                       rounded, scored_table)
from ledgerlens.plans.registry import register
from ledgerlens.session import scratch_path
from ledgerlens.sources import files as S
from ledgerlens.sources.tables import payments, table
from ledgerlens.streaming import intake as ST

PAYMENT_SELECT = ("record_id, recipient_id, recipient_type, recipient_state, specialty, payer_id, payer_name, amount, "
                  "number_of_payments, date_of_payment, form, nature")


# ---------------------------------------------------------------- sources
@register("a1_csv_roundtrip", f"SELECT {PAYMENT_SELECT} FROM payments")
def a1(spark, sf):
    """Payments → CSV (quoted) → read back with the explicit schema."""
    p = payments(spark, sf)
    path = scratch_path(spark, "csv")
    S.write_csv(p, path)
    back = S.read_csv(spark, path, p.schema)
    return back.drop("_corrupt_record")


@register("a3_schema_typing")
def a3(spark, sf):
    """Inferred CSV schema with id-like names forced to text, as rows."""
    path = scratch_path(spark, "csv")
    S.write_csv(payments(spark, sf), path)
    schema = S.infer_schema(spark, path)
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema.fields],
                                 "column string, data_type string")


_TYPES = ("CASE WHEN column_type = 'VARCHAR' THEN 'string' WHEN column_type = 'INTEGER' THEN 'int' "
          "WHEN column_type LIKE 'TIMESTAMP%' THEN 'timestamp_ntz' ELSE lower(column_type) END")


@register("a5_register_view_describe", f"""
SELECT column_name AS col_name, {_TYPES} AS data_type, CAST(NULL AS VARCHAR) AS comment FROM (DESCRIBE lineitem)""", payments=False)
def a5(spark, sf):
    return S.register_view(spark, "lineitem_ext", f"{sf.rstrip('/')}/lineitem.parquet")


@register("a4_external_csv_table", """
SELECT CAST(year(date_of_payment) AS VARCHAR) AS program_year, count(*) AS n_rows, count(DISTINCT payer_id) AS n_payers,
       round(sum(amount), 2) AS total_amount FROM payments GROUP BY 1""")
def a4(spark, sf):
    """Partitioned CSV files as a table of the session's catalog."""
    p = payments(spark, sf).select("record_id", "payer_id", "amount", F.year("date_of_payment").cast("string").alias("program_year"))
    path = scratch_path(spark, "csv-table")
    p.write.partitionBy("program_year").option("header", True).csv(path)
    t = S.create_external_table(spark, path.rsplit("/", 1)[1].replace("-", "_"), path, p.schema, "csv", ["program_year"], {"header": "true"})
    return t.groupBy("program_year").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("payer_id").alias("n_payers"),
                                         F.round(F.sum("amount"), 2).alias("total_amount"))


@register("a5_show_partitions", """
SELECT DISTINCT 'program_year=' || year(date_of_payment) AS partition FROM payments""")
def a5_partitions(spark, sf):
    """Partitions that the catalog finds under an external Parquet table."""
    p = payments(spark, sf).select("record_id", "amount", F.year("date_of_payment").cast("string").alias("program_year"))
    path = scratch_path(spark, "table")
    S.write_lake(p, path)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    S.create_external_table(spark, name, path, p.schema, "parquet", ["program_year"])
    return S.show_partitions(spark, name)


@register("a6_schema_violations", """
SELECT column_name AS column, lower(column_type) AS data_type, 'text-like column typed numeric' AS problem
FROM (DESCRIBE SELECT o_custkey AS recipient_id, l_suppkey AS payer_id, l_extendedprice AS amount FROM lineitem, orders)
WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') AND column_name LIKE '%id%'""", payments=False)
def a6(spark, sf):
    return S.schema_violations(payments(spark, sf))


_LAKE_SQL = """
SELECT CAST(year(date_of_payment) AS VARCHAR) AS program_year, count(*) AS n_rows,
       round(sum(amount), 2) AS total_amount FROM payments GROUP BY 1"""


def _lake(spark, sf):
    p = payments(spark, sf).withColumn("program_year", F.year("date_of_payment").cast("string"))
    return S.write_lake(p, scratch_path(spark, "lake"), ["program_year"])


@register("a7_lake_partitions", _LAKE_SQL)
def a7(spark, sf):
    lake = _lake(spark, sf)
    return lake.groupBy(F.col("program_year").cast("string").alias("program_year")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("amount"), 2).alias("total_amount"))


@register("a7_lake_partition_pruned", """
SELECT count(*) AS n_rows, round(sum(amount), 2) AS total_amount FROM payments WHERE year(date_of_payment) = 2000""")
def a7p(spark, sf):
    """A filter on the partition column reads one directory (PartitionFilters in the scan)."""
    lake = _lake(spark, sf)
    return lake.where(F.col("program_year") == "2000").agg(F.count(F.lit(1)).alias("n_rows"),
                                                           F.round(F.sum("amount"), 2).alias("total_amount"))


@register("a8_preview", f"SELECT {PAYMENT_SELECT} FROM payments ORDER BY record_id LIMIT 10")
def a8(spark, sf):
    return payments(spark, sf).orderBy("record_id").limit(10)


@register("a9_row_count", "SELECT count(*) AS n_rows FROM payments")
def a9(spark, sf):
    return payments(spark, sf, []).agg(F.count(F.lit(1)).alias("n_rows"))


@register("a10_storage_comparison")
def a10(spark, sf):
    p = payments(spark, sf)
    csv = scratch_path(spark, "csv")
    S.write_csv(p, csv)
    lake = scratch_path(spark, "lake")
    S.write_lake(p.withColumn("program_year", F.year("date_of_payment").cast("string")), lake)
    return S.storage_sizes(spark, {"csv": csv, "parquet": lake})


@register("a11_lake_validation", """
SELECT 'table_readable' AS "check", true AS passed, '13 columns' AS detail
UNION ALL SELECT 'has_rows', count(*) > 0, count(*) || ' rows' FROM payments
UNION ALL SELECT 'columns_present', true, 'all present'
UNION ALL SELECT 'partitions_present', true, count(DISTINCT year(date_of_payment)) || ' partitions' FROM payments""")
def a11(spark, sf):
    return S.validate_lake(_lake(spark, sf), ["record_id", "amount", "date_of_payment"], "program_year")


@register("a12_sequential_extract", "SELECT * FROM lineitem LIMIT 100", payments=False)
def a12(spark, sf):
    return S.sequential_extract(table(spark, sf, "lineitem"), 100)


@register("a13_random_extract", f"""
SELECT {PAYMENT_SELECT} FROM payments ORDER BY {unit_hash_sql('record_id', 42)}, record_id LIMIT 100""")
def a13(spark, sf):
    return S.random_extract(payments(spark, sf), "record_id", 100, 42)


@register("a17_random_feature_rows", "WITH " + FEATURES_SQL + f"""
SELECT record_id, round(amount, 6) AS amount, round(hist_pay_avg, 6) AS hist_pay_avg FROM features
WHERE amount IS NOT NULL ORDER BY {unit_hash_sql('record_id', 7)}, record_id LIMIT 50""")
def a17(spark, sf):
    f = S.random_extract(feature_table(spark, sf), "record_id", 50, 7, require="amount")
    return rounded(f.select("record_id", "amount", "hist_pay_avg"))


@register("a16_capture_parse", "SELECT CAST(event_id AS VARCHAR) AS event_id, user_id, event_type, value FROM events",
          payments=False)
def a16(spark, sf):
    lines = ST.capture_lines(table(spark, sf, "events"))
    records, _ = S.parse_capture(lines, ST.EVENT_RECORD)
    return records.select(F.col("capture_id").alias("event_id"), "user_id", "event_type", "value")


@register("a16_props_json", """
SELECT event_type, count(*) AS n_events, CAST(sum(TRY_CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_total,
       CAST(sum(CASE WHEN TRY_CAST(json_extract(props, '$.k') AS BIGINT) IS NULL THEN 1 ELSE 0 END) AS BIGINT)
         AS n_unparsed
FROM events GROUP BY event_type""", payments=False)
def a16p(spark, sf):
    e = table(spark, sf, "events").withColumn("_p", F.from_json("props", "struct<k: bigint>"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("_p.k").alias("k_total"),
                                       F.sum(F.col("_p.k").isNull().cast("long")).alias("n_unparsed"))


# ---------------------------------------------------------------- cleaning
@register("b_clean_payments", "WITH " + CLEAN_SQL + f" SELECT {PAYMENT_SELECT} FROM valid")
def b_clean(spark, sf):
    p = payments(spark, sf)
    return C.drop_invalid(C.fill_missing(C.convert_types(p)), record_key="recipient_id").select(*p.columns)


_RAW_HIST = FEATURES_SQL


def _raw_history(spark, sf):
    """The recipient history before its fills, read off the feature table: a recipient
    has an average and a maximum exactly where it has earlier payments."""
    f = feature_table(spark, sf)
    return f.withColumns({"hist_pay_avg": F.when(F.col("hist_pay_count") > 0, F.col("hist_pay_avg")),
                          "hist_pay_max": F.when(F.col("hist_pay_count") > 0, F.col("hist_pay_max"))})


@register("b9_median_fill_history", "WITH " + _RAW_HIST + """
SELECT record_id, round(coalesce(avg0, (SELECT quantile_cont(avg0, 0.5) FROM h0)), 6) AS hist_pay_avg,
       round(coalesce(max0, (SELECT quantile_cont(max0, 0.5) FROM h0)), 6) AS hist_pay_max FROM h0""")
def b9(spark, sf):
    h = C.median_fill(_raw_history(spark, sf), ["hist_pay_avg", "hist_pay_max"])
    return rounded(h.select("record_id", "hist_pay_avg", "hist_pay_max"))


@register("b10_ffill_bfill_history_max", "WITH " + _RAW_HIST + """,
f AS (SELECT record_id, date_of_payment, max0,
             last_value(max0 IGNORE NULLS) OVER (ORDER BY date_of_payment, record_id
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ff FROM h0)
SELECT record_id, round(coalesce(ff, first_value(ff IGNORE NULLS) OVER (ORDER BY date_of_payment, record_id
                              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS hist_pay_max FROM f""")
def b10(spark, sf):
    h = _raw_history(spark, sf).select("record_id", "date_of_payment", "hist_pay_max")
    return rounded(C.forward_backward_fill(h, "hist_pay_max", ["date_of_payment", "record_id"])
                   .select("record_id", "hist_pay_max"))


@register("b11_mode_fill_recipients", """
WITH nc AS (SELECT recipient_id, nature, count(*) AS c FROM payments WHERE nature IS NOT NULL GROUP BY 1, 2),
nm AS (SELECT recipient_id, min(nature) AS nature_mode FROM
        (SELECT *, max(c) OVER (PARTITION BY recipient_id) AS mc FROM nc) WHERE c = mc GROUP BY 1),
r AS (SELECT c.c_custkey AS recipient_id, nm.nature_mode FROM customer c LEFT JOIN nm ON c.c_custkey = nm.recipient_id),
m AS (SELECT nature_mode AS v, count(*) AS c FROM r WHERE nature_mode IS NOT NULL GROUP BY 1),
top AS (SELECT v FROM m ORDER BY c DESC, v LIMIT 1)
SELECT recipient_id, coalesce(nature_mode, (SELECT v FROM top), 'Unknown') AS nature_mode FROM r""")
def b11(spark, sf):
    """Recipients (every customer) with their modal payment nature; customers
    without payments get NULL from the left join and then the overall mode."""
    roll = group_mode(payments(spark, sf, ["recipient_id", "nature"]), ["recipient_id"], "nature", "nature_mode")
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("recipient_id"))
    return C.mode_fill(cust.join(roll, "recipient_id", "left"), ["nature_mode"])


@register("b14_distinct_rows", """
SELECT DISTINCT recipient_type, recipient_state, form, nature FROM payments""")
def b14(spark, sf):
    return C.drop_duplicates(payments(spark, sf, ["recipient_type", "recipient_state", "form", "nature"]))


@register("b15_latest_per_recipient", """
SELECT recipient_id, date_of_payment, amount, record_id FROM (
  SELECT recipient_id, date_of_payment, amount, record_id,
         row_number() OVER (PARTITION BY recipient_id ORDER BY date_of_payment DESC, amount DESC, record_id DESC) AS rn
  FROM payments) WHERE rn = 1""")
def b15(spark, sf):
    p = payments(spark, sf, ["recipient_id", "date_of_payment", "amount", "record_id"])
    return C.dedup_by_record(p, "recipient_id", "date_of_payment")


@register("b16_retention_report", "WITH " + CLEAN_SQL + """
SELECT (SELECT count(*) FROM payments) AS records_before, (SELECT count(*) FROM valid) AS records_after,
       (SELECT count(*) FROM payments) - (SELECT count(*) FROM valid) AS records_removed,
       round((SELECT count(*) FROM valid) * 100.0 / (SELECT count(*) FROM payments), 6) AS retention_pct""")
def b16(spark, sf):
    p = payments(spark, sf, ["recipient_id", "recipient_state", "amount", "date_of_payment", "number_of_payments", "record_id"])
    return C.retention_report(p, C.drop_invalid(C.convert_types(p), record_key="recipient_id"))


@register("b19_tukey_clip_amount", """
WITH q AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM payments)
SELECT record_id, round(CASE WHEN amount IS NULL THEN NULL
                             ELSE least(greatest(amount, q1 - 3 * (q3 - q1)), q3 + 3 * (q3 - q1)) END, 6) AS amount
FROM payments, q""")
def b19(spark, sf):
    return rounded(C.tukey_clip(payments(spark, sf, ["record_id", "amount"]), ["amount"], 3.0))


@register("b20_quantile_clip_amount", """
WITH q AS (SELECT quantile_cont(amount, 0.001) AS lo, quantile_cont(amount, 0.999) AS hi FROM payments)
SELECT record_id, round(least(greatest(amount, lo), hi), 6) AS amount FROM payments, q""")
def b20(spark, sf):
    return rounded(C.quantile_clip(payments(spark, sf, ["record_id", "amount"]), ["amount"]))


_AMERICA = """approved AS (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AMERICA')"""


@register("b22_category_validation", f"""
WITH {_AMERICA}
SELECT CASE WHEN recipient_state IN (SELECT n_name FROM approved) THEN 'valid' ELSE 'data_quality' END AS status,
       count(*) AS n_rows FROM payments GROUP BY 1""")
def b22(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    approved = nation.join(region.where(F.col("r_name") == "AMERICA"), F.col("n_regionkey") == F.col("r_regionkey"),
                           "left_semi").select("n_name")
    ok, bad = C.validate_categories(payments(spark, sf, ["recipient_state"]), "recipient_state", approved, "n_name")
    return (ok.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("status", F.lit("valid"))
            .unionByName(bad.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("status", F.lit("data_quality")))
            .where(F.col("n_rows") > 0).select("status", "n_rows"))


@register("b24_top_decile", """
WITH q AS (SELECT quantile_cont(amount, 0.9) AS c FROM payments)
SELECT count(*) AS n_rows, round(sum(amount), 2) AS total_amount FROM payments, q WHERE amount >= c""")
def b24(spark, sf):
    t = C.top_share_filter(payments(spark, sf, ["amount"]), "amount", 0.9)
    return t.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("amount"), 2).alias("total_amount"))


# ---------------------------------------------------------------- monitoring (two time batches)
CUT = "1999-01-01"
DRIFT_COLS = ["amount", "number_of_payments", "hist_pay_avg", "amt_to_avg_ratio"]


def _batches(df):
    d = F.col("date_of_payment")
    return df.where(d < F.lit(CUT).cast("timestamp_ntz")), df.where(d >= F.lit(CUT).cast("timestamp_ntz"))


def _stats_sql(where: str) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, round(quantile_cont({c}, 0.5), 6) AS p50
       FROM features WHERE {where}""" for c in DRIFT_COLS)


@register("g20_baseline_stats", "WITH " + FEATURES_SQL + "\n" + _stats_sql(f"date_of_payment < TIMESTAMP '{CUT}'"))
def g20(spark, sf):
    base, _ = _batches(feature_table(spark, sf))
    return rounded(MON.baseline_stats(base, DRIFT_COLS).select("column", "count", "mean", "std", "p50"))


@register("g21_feature_drift", "WITH " + FEATURES_SQL + f""",
b AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in DRIFT_COLS)} FROM features WHERE date_of_payment < TIMESTAMP '{CUT}'),
c AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in DRIFT_COLS)} FROM features WHERE date_of_payment >= TIMESTAMP '{CUT}')
""" + "\nUNION ALL\n".join(f"""SELECT '{c}' AS "column", round(b.{c}, 6) AS baseline_mean, round(c.{c}, 6) AS current_mean,
       round(abs((c.{c} - b.{c}) / abs(b.{c})), 6) AS relative_change, abs((c.{c} - b.{c}) / abs(b.{c})) > 0.15 AS drift_alarm
FROM b, c""" for c in DRIFT_COLS))
def g21(spark, sf):
    base, cur = _batches(feature_table(spark, sf))
    d = MON.feature_drift(MON.baseline_stats(base, DRIFT_COLS), MON.baseline_stats(cur, DRIFT_COLS))
    return rounded(d)


def _long_sql(where: str) -> str:
    return "\n    UNION ALL\n    ".join(
        f"""SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM features WHERE {where} AND {c} IS NOT NULL
                                      AND NOT isnan(CAST({c} AS DOUBLE))""" for c in DRIFT_COLS)


@register("g21_psi", "WITH " + FEATURES_SQL + f""",
lb AS ({_long_sql(f"date_of_payment < TIMESTAMP '{CUT}'")}),
lc AS ({_long_sql(f"date_of_payment >= TIMESTAMP '{CUT}'")}),
e AS (SELECT col, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM lb GROUP BY col),
bb AS (SELECT l.col, len(list_filter(e.q, lambda x: x < l.v)) AS bucket FROM lb l JOIN e ON l.col = e.col),
bc AS (SELECT l.col, len(list_filter(e.q, lambda x: x < l.v)) AS bucket FROM lc l JOIN e ON l.col = e.col),
sb AS (SELECT col, bucket, count(*) / sum(count(*)) OVER (PARTITION BY col) AS pb FROM bb GROUP BY col, bucket),
sc AS (SELECT col, bucket, count(*) / sum(count(*)) OVER (PARTITION BY col) AS pc FROM bc GROUP BY col, bucket),
j AS (SELECT coalesce(sb.col, sc.col) AS col, greatest(coalesce(pb, 0.0), 1e-4) AS pb,
             greatest(coalesce(pc, 0.0), 1e-4) AS pc
      FROM sb FULL JOIN sc ON sb.col = sc.col AND sb.bucket = sc.bucket)
SELECT col AS "column", round(sum((pc - pb) * ln(pc / pb)), 6) AS psi FROM j GROUP BY col""")
def g21p(spark, sf):
    base, cur = _batches(feature_table(spark, sf))
    return rounded(MON.psi(base, cur, MON.baseline_stats(base, DRIFT_COLS), DRIFT_COLS))


@register("g22_rate_drift", "WITH " + SCORED_SQL + f""",
r AS (SELECT avg(CASE WHEN date_of_payment < TIMESTAMP '{CUT}' THEN CAST(is_anomaly AS DOUBLE) END) AS br,
             avg(CASE WHEN date_of_payment >= TIMESTAMP '{CUT}' THEN CAST(is_anomaly AS DOUBLE) END) AS cr FROM final)
SELECT round(br, 6) AS baseline_rate, round(cr, 6) AS current_rate, round(abs((cr - br) / br), 6) AS relative_change,
       coalesce(abs((cr - br) / br) > 0.25, false) AS rate_alarm FROM r""")
def g22(spark, sf):
    base, cur = _batches(scored_table(spark, sf))
    return rounded(MON.rate_drift(base, cur, "is_anomaly"))


@register("g23_score_drift", "WITH " + SCORED_SQL + f""",
b AS (SELECT quantile_cont(anomaly_score, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q FROM final
      WHERE date_of_payment < TIMESTAMP '{CUT}'),
c AS (SELECT quantile_cont(anomaly_score, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q FROM final
      WHERE date_of_payment >= TIMESTAMP '{CUT}'),
p AS (SELECT * FROM (VALUES (1, 0.01), (2, 0.05), (3, 0.25), (4, 0.5), (5, 0.75), (6, 0.95), (7, 0.99)) t(i, pct))
SELECT p.pct AS percentile, round(b.q[p.i], 6) AS baseline_score, round(c.q[p.i], 6) AS current_score,
       round(c.q[p.i] - b.q[p.i], 6) AS difference FROM p, b, c""")
def g23(spark, sf):
    base, cur = _batches(scored_table(spark, sf))
    d = MON.score_percentile_drift(base, cur, "anomaly_score")
    return rounded(d.withColumn("percentile", F.col("percentile").cast("double")))


@register("g24_new_relationships", f"""
WITH b AS (SELECT DISTINCT concat_ws('#', recipient_id, payer_id) AS rel FROM payments
           WHERE date_of_payment < TIMESTAMP '{CUT}'),
c AS (SELECT concat_ws('#', recipient_id, payer_id) AS relationship, count(*) AS n_rows FROM payments
      WHERE date_of_payment >= TIMESTAMP '{CUT}' GROUP BY 1)
SELECT relationship, n_rows FROM c WHERE relationship NOT IN (SELECT rel FROM b)""")
def g24(spark, sf):
    """New-category drift on (recipient, payer) relationships first seen in the current batch."""
    p = payments(spark, sf, ["recipient_id", "payer_id", "date_of_payment"]).withColumn("relationship", F.concat_ws("#", "recipient_id", "payer_id"))
    base, cur = _batches(p)
    return MON.new_categories(base, cur, "relationship")


@register("g24_missing_drift", "WITH " + FEATURES_SQL + "\n" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column",
       avg(CASE WHEN date_of_payment < TIMESTAMP '{CUT}' THEN CAST({c} IS NULL AS DOUBLE) END) AS baseline_missing,
       avg(CASE WHEN date_of_payment >= TIMESTAMP '{CUT}' THEN CAST({c} IS NULL AS DOUBLE) END) AS current_missing
FROM features""" for c in DRIFT_COLS))
def g24m(spark, sf):
    base, cur = _batches(feature_table(spark, sf))
    return MON.missing_drift(base, cur, DRIFT_COLS)


@register("g21_ks", "WITH " + FEATURES_SQL + f""",
l AS ({_long_sql("true").replace("SELECT '", f"SELECT date_of_payment < TIMESTAMP '{CUT}' AS base, '")}),
c AS (SELECT col, v, sum(CAST(base AS INTEGER)) AS b, sum(1 - CAST(base AS INTEGER)) AS u FROM l GROUP BY col, v),
f AS (SELECT col, sum(b) OVER w / sum(b) OVER (PARTITION BY col) AS fb, sum(u) OVER w / sum(u) OVER (PARTITION BY col) AS fu
      FROM c WINDOW w AS (PARTITION BY col ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT col AS "column", round(max(abs(fb - fu)), 6) AS ks FROM f GROUP BY col""")
def g21k(spark, sf):
    base, cur = _batches(feature_table(spark, sf))
    return rounded(MON.ks_statistic(base, cur, DRIFT_COLS))


@register("g24_schema_drift", """
SELECT 'n_chars' AS column, 'bigint' AS baseline_type, CAST(NULL AS VARCHAR) AS current_type, 'removed' AS change FROM (SELECT 1)
WHERE 'n_chars' IN (SELECT column_name FROM (DESCRIBE documents))
UNION ALL SELECT 'doc_id', 'bigint', 'string', 'retyped' UNION ALL SELECT 'n_words', NULL, 'int', 'added'""", payments=False)
def g24s(spark, sf):
    """A current batch that lost, gained and retyped a column of the baseline."""
    base = table(spark, sf, "documents")
    cur = base.drop("n_chars").withColumns({"doc_id": F.col("doc_id").cast("string"), "n_words": F.lit(1)})
    return MON.schema_drift(base, cur)


_MIX_SQL = "WITH " + SCORED_SQL + f""",
codes AS (SELECT date_of_payment < TIMESTAMP '{CUT}' AS early, list_filter([
         CASE WHEN peer_robust_z > 3.5 THEN 'amount_far_above_peers' END,
         CASE WHEN peer_robust_z < -3.5 THEN 'amount_far_below_peers' END,
         CASE WHEN is_new_recipient = 0 AND amt_to_max_ratio > 1.0 THEN 'above_own_history_max' END,
         CASE WHEN amt_to_avg_ratio > 3.0 THEN 'over_3x_own_average' END,
         CASE WHEN is_new_recipient = 1 THEN 'new_recipient' END,
         CASE WHEN is_high_risk_nature = 1 THEN 'high_risk_nature' END], lambda x: x IS NOT NULL) AS l FROM final),
each AS (SELECT early, unnest(CASE WHEN len(l) = 0 THEN ['(none)'] ELSE l END) AS code FROM codes),
n AS (SELECT code, count(*) FILTER (early) AS b, count(*) FILTER (NOT early) AS c FROM each WHERE early IS NOT NULL GROUP BY code),
mix AS (SELECT code, b, c, coalesce(b / nullif((SELECT sum(b) FROM n), 0), 0) AS p, coalesce(c / nullif((SELECT sum(c) FROM n), 0), 0) AS q FROM n)
"""


def _mix(spark, sf):
    from ledgerlens.operators.detect import reason_codes

    return MON.mix_drift(*_batches(reason_codes(scored_table(spark, sf))))


@register("g23_reason_mix", _MIX_SQL + """
SELECT code, b AS baseline_rows, c AS current_rows, round(p, 6) AS baseline_share, round(q, 6) AS current_share,
       round(q - p, 6) AS difference, CASE WHEN b = 0 THEN 'new' WHEN c = 0 THEN 'gone' ELSE 'both' END AS status FROM mix""")
def g23_mix(spark, sf):
    return rounded(_mix(spark, sf))


@register("g23_reason_mix_distance", _MIX_SQL + f"""
SELECT round(sum(abs(p - q)) / 2, 6) AS total_variation,
       round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
                               + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)), 6) AS jensen_shannon,
       count(*) FILTER (b = 0) AS n_new, count(*) FILTER (c = 0) AS n_gone, sum(abs(p - q)) / 2 > {MON.MIX_ALARM} AS mix_alarm FROM mix""")
def g23_mix_distance(spark, sf):
    return rounded(MON.mix_distance(_mix(spark, sf)))


@register("g25_retrain_decision", "WITH " + SCORED_SQL + f""",
b AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in DRIFT_COLS)} FROM features WHERE date_of_payment < TIMESTAMP '{CUT}'),
c AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in DRIFT_COLS)} FROM features WHERE date_of_payment >= TIMESTAMP '{CUT}'),
d AS (""" + "\n  UNION ALL\n  ".join(
    f"""SELECT coalesce(CASE WHEN b.{c} <> 0 THEN abs((c.{c} - b.{c}) / abs(b.{c})) END > 0.15, false) AS alarm FROM b, c"""
    for c in DRIFT_COLS) + f"""),
r AS (SELECT avg(CASE WHEN date_of_payment < TIMESTAMP '{CUT}' THEN CAST(is_anomaly AS DOUBLE) END) AS br,
             avg(CASE WHEN date_of_payment >= TIMESTAMP '{CUT}' THEN CAST(is_anomaly AS DOUBLE) END) AS cr FROM final)
SELECT CAST(coalesce(sum(CAST(alarm AS INTEGER)), 0) AS BIGINT) AS n_drifting,
       coalesce(max(CAST(alarm AS INTEGER)), 0) = 1
       OR (SELECT coalesce(CASE WHEN br <> 0 THEN abs((cr - br) / br) END > 0.25, false) FROM r) AS retrain
FROM d""")
def g25(spark, sf):
    fb, fc = _batches(feature_table(spark, sf))
    sb, sc = _batches(scored_table(spark, sf))
    d = MON.feature_drift(MON.baseline_stats(fb, DRIFT_COLS), MON.baseline_stats(fc, DRIFT_COLS))
    return MON.retrain_decision(d, MON.rate_drift(sb, sc, "is_anomaly"))


@register("g26_dictionary_lookup", """
SELECT n AS name, 'string' AS type, 'nullable' AS constraints,
       'categorical column with ' || k || ' distinct values...' AS description
FROM (SELECT 'recipient_type' AS n, count(DISTINCT recipient_type) AS k FROM payments
      UNION ALL SELECT 'recipient_state', count(DISTINCT recipient_state) FROM payments)""")
def g26(spark, sf):
    """Data dictionary built from the payments schema and its profile (A15
    shape: ``data.fields[]``), written as JSON, read back and searched."""
    p = payments(spark, sf)
    prof = P.categorical_profile(p, ["recipient_type", "recipient_state", "specialty", "form", "nature"])
    desc = prof.select(F.col("column").alias("name"),
                       F.concat(F.lit("categorical column with "), F.col("n_unique").cast("string"),
                                F.lit(" distinct values")).alias("description"),
                       F.lit("string").alias("type"), F.lit("nullable").alias("constraints"))
    doc = desc.agg(F.struct(F.collect_list(F.struct("name", "description", "type", "constraints")).alias("fields"))
                   .alias("data"))
    path = scratch_path(spark, "dict")
    doc.coalesce(1).write.mode("overwrite").json(path)
    fields = S.read_dictionary(spark, path)
    return S.dictionary_lookup(fields, keyword="recipient")


# ---------------------------------------------------------------- streaming
@register("st1_capture_stream", """
SELECT event_type, count(*) AS n_records, round(sum(value), 2) AS total_value FROM events GROUP BY 1""", payments=False)
def st1(spark, sf):
    """Capture files derived from the events table, taken in by an
    ``availableNow`` file stream in several micro-batches."""
    src = scratch_path(spark, "capture")
    ST.capture_lines(table(spark, sf, "events")).repartition(8).write.mode("overwrite").text(src)
    out = ST.run_intake(spark, src, scratch_path(spark, "intake"), scratch_path(spark, "stream-ckpt"),
                        ST.EVENT_RECORD, files_per_batch=2)
    return out["records"].groupBy("event_type").agg(F.count(F.lit(1)).alias("n_records"),
                                                     F.round(F.sum("value"), 2).alias("total_value"))
