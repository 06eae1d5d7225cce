"""Registered queries on dirty rows (B3-B22) and on the stored baseline (G20, G24, ST1).

The dirty extract is the payments view as raw text.  What is wrong with a row
follows from the hex digits of its key, so both engines make the same rows from
the same tables; one row in sixteen appears twice."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ledgerlens.operators import baseline as B
from ledgerlens.operators import clean as C
from ledgerlens.plans.flagship import rounded, with_record_id
from ledgerlens.plans.io_queries import CUT, _batches
from ledgerlens.plans.registry import register
from ledgerlens.session import compiled_methods, cut_lineage, scratch_path
from ledgerlens.sources.tables import payments, table
from ledgerlens.streaming import intake as ST

MODES = ("recipient_type", "nature")
CODES = ["recipient_type", "form", "nature"]


def dirty_payments(spark, sf):
    """The raw extract: amounts, counts and dates as text, gaps, odd spellings, copies."""
    p = payments(spark, sf, ["record_id", "recipient_id", "recipient_type", "recipient_state", "payer_id", "amount",
                             "number_of_payments", "date_of_payment", "form", "nature"])
    def digit(k, **cases):
        """A case per hex digit of the key; ``other`` where none fits."""
        d, out = F.substring("record_id", k, 1), None
        for name, value in cases.items():
            if name != "other":
                out = (F if out is None else out).when(d.isin(*name[1:]), value)
        return out.otherwise(cases["other"])

    null, text = F.lit(None), F.col("amount").cast("decimal(18,2)").cast("string")
    n, day = F.col("number_of_payments").cast("string"), F.col("date_of_payment")
    price = F.col("amount") * 1.5
    state = F.col("recipient_state")
    rows = p.select(
        "record_id", digit(8, d01=null, other=F.col("recipient_id").cast("string")).alias("recipient_id"), "recipient_type",
        digit(4, d01234567=F.concat(F.lit("  "), F.lower(state), F.lit(" ")), d8=null, other=state).alias("recipient_state"),
        digit(1, d0=null, d1=F.lit("n/a"), d2=F.concat(F.lit("-"), text), d3=F.concat(F.lit(" "), text, F.lit(" ")), d4=F.lit("0.00"),
              d5=F.concat(text, F.lit("d")), d6=F.concat(F.lit("1,"), text), other=text).alias("amount"),
        digit(3, d0=null, d1=F.lit("two"), d2=F.concat(n, F.lit(".0")), d3=F.lit("inf"), other=n).alias("number_of_payments"),
        digit(2, d0=null, d1=F.lit("13/45/2020"), d2=F.date_format(day, "yyyy-MM-dd"), other=F.date_format(day, "MM/dd/yyyy")).alias("date_of_payment"),
        digit(7, d0=null, other=F.col("form")).alias("form"), digit(6, d0=null, other=F.col("nature")).alias("nature"),
        digit(5, d0=F.lit("Yes"), d1=F.lit("Y"), d2=F.lit("No"), d3=F.lit("N"), d4=F.lit("Unknown"), d5=null, other=F.lit("maybe")).alias("ownership_indicator"),
        digit(10, d01=null, other=(F.col("payer_id") % 7).cast("double")).alias("product_count"),
        digit(11, d0=null, d1=F.lit(float("nan")), d2=F.lit(float("inf")), d3=F.lit(float("-inf")), other=price).alias("list_price"),
        digit(12, d0=F.lit("noted"), other=null).cast("string").alias("note"), digit(13, d0=F.lit(2), other=F.lit(1)).alias("_times"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_copy", "_times")


DIRTY_SQL = """
one AS (
  SELECT record_id, CASE WHEN substr(record_id, 8, 1) NOT IN ('0', '1') THEN CAST(recipient_id AS VARCHAR) END AS recipient_id, recipient_type,
         CASE WHEN substr(record_id, 4, 1) < '8' THEN '  ' || lower(recipient_state) || ' '
              WHEN substr(record_id, 4, 1) > '8' THEN recipient_state END AS recipient_state,
         CASE substr(record_id, 1, 1) WHEN '0' THEN NULL WHEN '1' THEN 'n/a' WHEN '2' THEN '-' || t WHEN '3' THEN ' ' || t || ' '
              WHEN '4' THEN '0.00' WHEN '5' THEN t || 'd' WHEN '6' THEN '1,' || t ELSE t END AS amount,
         CASE substr(record_id, 3, 1) WHEN '0' THEN NULL WHEN '1' THEN 'two' WHEN '2' THEN number_of_payments || '.0' WHEN '3' THEN 'inf'
              ELSE CAST(number_of_payments AS VARCHAR) END AS number_of_payments,
         CASE substr(record_id, 2, 1) WHEN '0' THEN NULL WHEN '1' THEN '13/45/2020' WHEN '2' THEN strftime(date_of_payment, '%Y-%m-%d')
              ELSE strftime(date_of_payment, '%m/%d/%Y') END AS date_of_payment,
         CASE WHEN substr(record_id, 7, 1) <> '0' THEN form END AS form, CASE WHEN substr(record_id, 6, 1) <> '0' THEN nature END AS nature,
         CASE substr(record_id, 5, 1) WHEN '0' THEN 'Yes' WHEN '1' THEN 'Y' WHEN '2' THEN 'No' WHEN '3' THEN 'N' WHEN '4' THEN 'Unknown'
              WHEN '5' THEN NULL ELSE 'maybe' END AS ownership_indicator,
         CASE WHEN substr(record_id, 10, 1) NOT IN ('0', '1') THEN CAST(payer_id % 7 AS DOUBLE) END AS product_count,
         CASE WHEN substr(record_id, 11, 1) NOT IN ('0', '1', '2', '3') THEN amount * 1.5 END AS list_price
  FROM (SELECT *, CAST(CAST(amount AS DECIMAL(18, 2)) AS VARCHAR) AS t FROM payments)),
dirty AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE substr(record_id, 13, 1) = '0'),
read AS (SELECT *, CASE WHEN regexp_matches(trim(amount), '^-?[0-9]+(\\.[0-9]+)?$') THEN CAST(amount AS DOUBLE) END AS number,
                CASE WHEN regexp_matches(number_of_payments, '^[0-9]+(\\.[0-9]+)?$') THEN CAST(CAST(number_of_payments AS DOUBLE) AS BIGINT) END AS payments_read,
                CAST(try_strptime(date_of_payment, '%m/%d/%Y') AS DATE) AS day FROM dirty)"""

NUMBERS = ("amount", "number_of_payments", "ownership_indicator", "product_count", "list_price")
CLEANED_SQL = "WITH " + DIRTY_SQL + """,
dates AS (SELECT *, last_value(day IGNORE NULLS) OVER (ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS forward FROM read),
modes AS (SELECT (SELECT nature FROM dirty WHERE nature IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, nature LIMIT 1) AS nature_mode,
                 (SELECT recipient_type FROM dirty WHERE recipient_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, recipient_type LIMIT 1) AS type_mode,
                 (SELECT quantile_cont(abs(number), 0.5) FROM read) AS amount_median, (SELECT quantile_cont(list_price, 0.5) FROM read) AS price_median),
filled AS (
  SELECT DISTINCT record_id, coalesce(recipient_id, 'Unknown') AS recipient_id, coalesce(recipient_type, type_mode) AS recipient_type,
         coalesce(trim(upper(recipient_state)), 'Unknown') AS recipient_state, coalesce(form, 'Unknown') AS form,
         coalesce(nature, nature_mode) AS nature, coalesce(abs(number), amount_median) AS amount,
         CAST(coalesce(payments_read, 1) AS DOUBLE) AS number_of_payments,
         CAST(coalesce(ownership_indicator IN ('Yes', 'Y'), false) AS DOUBLE) AS ownership_indicator,
         coalesce(product_count, 0) AS product_count, coalesce(list_price, price_median) AS list_price,
         coalesce(forward, first_value(forward IGNORE NULLS) OVER (ORDER BY record_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS date_of_payment
  FROM dates, modes),
valid AS (SELECT * FROM filled WHERE amount > 0),
q AS (SELECT """ + ", ".join(f"quantile_cont({c}, 0.001) AS {c}_lo, quantile_cont({c}, 0.999) AS {c}_hi" for c in NUMBERS) + " FROM valid)"


def _cleaned(spark, sf):
    """(raw extract, cleaned extract), row keys as 16 bytes (``with_record_id`` spells
    them; their order is the same)."""
    # read once per statistic: the parsed extract is written first
    compiled_methods(spark)
    raw = cut_lineage(dirty_payments(spark, sf).withColumn("record_id", F.unhex("record_id")))
    return raw, C.clean_extract(raw, ["record_id"], ["ownership_indicator"], MODES)


@register("b_dirty_clean", CLEANED_SQL + """
SELECT record_id, recipient_id, recipient_type, recipient_state, form, nature, CAST(date_of_payment AS VARCHAR) AS date_of_payment,
       """ + ", ".join(f"round(least(greatest({c}, {c}_lo), {c}_hi), 6) AS {c}" for c in NUMBERS) + " FROM valid, q")
def b_dirty(spark, sf):
    """The whole cleaning path; the column ``note``, nearly empty, is dropped."""
    cleaned = with_record_id(_cleaned(spark, sf)[1])
    return rounded(cleaned.withColumn("date_of_payment", F.date_format("date_of_payment", "yyyy-MM-dd")))


@register("b16_dirty_retention", CLEANED_SQL + """
SELECT (SELECT count(*) FROM dirty) AS records_before, (SELECT count(*) FROM valid) AS records_after,
       (SELECT count(*) FROM dirty) - (SELECT count(*) FROM valid) AS records_removed,
       round((SELECT count(*) FROM valid) * 100.0 / (SELECT count(*) FROM dirty), 6) AS retention_pct""")
def b16_dirty(spark, sf):
    return C.retention_report(*_cleaned(spark, sf))


#: natures are checked against the priorities of urgent and high orders
QUARANTINE_SQL = "WITH " + DIRTY_SQL + """,
tagged AS (
  SELECT record_id, list_filter([
         CASE WHEN amount IS NULL THEN 'amount_missing' END, CASE WHEN amount IS NOT NULL AND number IS NULL THEN 'amount_unreadable' END,
         CASE WHEN number = 0 THEN 'amount_zero' END, CASE WHEN date_of_payment IS NULL THEN 'date_missing' END,
         CASE WHEN date_of_payment IS NOT NULL AND day IS NULL THEN 'date_unreadable' END,
         CASE WHEN number_of_payments IS NOT NULL AND payments_read IS NULL THEN 'count_unreadable' END,
         CASE WHEN recipient_id IS NULL THEN 'key_missing' END,
         CASE WHEN nature IS NULL OR nature NOT IN (SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority < '3'
                                                   AND o_orderpriority IS NOT NULL) THEN 'nature_not_listed' END], lambda x: x IS NOT NULL) AS reasons,
         count(*) AS n_copies FROM read GROUP BY ALL)"""


def _quarantine(spark, sf):
    listed = table(spark, sf, "orders").where("o_orderstatus = 'F' AND o_orderpriority < '3'").select("o_orderpriority")
    return C.quarantine(dirty_payments(spark, sf), scratch_path(spark, "quarantine"), C.strict_rules(), {"nature": listed})


@register("b22_quarantine_rows", QUARANTINE_SQL + """
SELECT record_id, n_copies, array_to_string(reasons, ';') AS reasons FROM tagged WHERE len(reasons) > 0""")
def b22_rows(spark, sf):
    """The data-quality stream: every rejected row with all its reasons."""
    rejected = _quarantine(spark, sf)[1]
    return rejected.select("record_id", "n_copies", F.array_join("reasons", ";").alias("reasons"))


@register("b22_quarantine_report", QUARANTINE_SQL + """
SELECT outcome, CAST(sum(n) AS BIGINT) AS n_rows FROM (
  SELECT CASE WHEN len(reasons) = 0 THEN 'accepted' ELSE 'rejected' END AS outcome, n_copies AS n FROM tagged
  UNION ALL SELECT 'duplicate', n_copies - 1 FROM tagged UNION ALL SELECT unnest(reasons), n_copies FROM tagged) GROUP BY 1""")
def b22_report(spark, sf):
    return C.quarantine_report(*_quarantine(spark, sf))


# ---------------------------------------------------------------- stored baseline
PAY_NUMBERS = ["amount", "number_of_payments"]


def _bins_sql(rows: str, cols) -> str:
    """Statistics of ``rows`` by the same bins, from one table instead of merged batches."""
    long = "\n  UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM {rows}" for c in cols)
    size = f"floor(ln(abs(v)) / {math.log(B.BIN_RATIO)!r}) + 40000"
    deciles = ", ".join(f"round(min_by(b, CASE WHEN upto >= 0.{i}::DOUBLE * n - 1e-9 THEN upto END), 6) AS p{i}0" for i in range(1, 10))
    return f"""
l AS ({long}),
k AS (SELECT col, CASE WHEN v = 0 THEN 0 WHEN v > 0 THEN {size} ELSE -({size}) END AS bin, avg(v) AS b, count(*) AS c
      FROM l WHERE v IS NOT NULL GROUP BY 1, 2),
u AS (SELECT col, b, sum(c) OVER (PARTITION BY col ORDER BY bin) AS upto, sum(c) OVER (PARTITION BY col) AS n FROM k),
d AS (SELECT col, {deciles} FROM u GROUP BY col),
s AS (SELECT col, count(v) AS count, count(*) - count(v) AS missing, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
             round(min(v), 6) AS min, round(max(v), 6) AS max FROM l GROUP BY col)
SELECT s.col AS "column", s.* EXCLUDE (col), d.* EXCLUDE (col) FROM s LEFT JOIN d ON s.col = d.col"""


@register("g20_stored_baseline", "WITH " + _bins_sql("payments", PAY_NUMBERS).strip())
def g20_stored(spark, sf):
    """A baseline kept in two batches, the first written by a failed attempt (a part
    of its rows) and then again in full; statistics come from the state alone."""
    p = payments(spark, sf, ["date_of_payment", *PAY_NUMBERS, *CODES])
    early, late = _batches(p)
    late = p.where(F.col("date_of_payment").isNull()).unionByName(late)
    path = scratch_path(spark, "baseline")
    for rows, batch in ((early.where("number_of_payments > 10"), "early"), (late, "late"), (early, "early")):
        B.store_batch(rows, path, batch, PAY_NUMBERS, CODES)
    return rounded(B.merged_stats(B.read_state(spark, path)))


_EARLY = f"date_of_payment < TIMESTAMP '{CUT}'"


@register("g20_constraints", f"""
WITH e AS (SELECT * FROM payments WHERE {_EARLY})
""" + "\nUNION ALL ".join([f"""SELECT '{c}' AS "column", 'number' AS kind, round(count({c}) / count(*), 6) AS completeness, min({c}) >= 0 AS is_non_negative,
       round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, 0 AS n_categories FROM e""" for c in PAY_NUMBERS]
    + [f"""SELECT '{c}', 'text', round(count({c}) / count(*), 6), false, NULL, NULL, count(DISTINCT {c}) FROM e""" for c in CODES]))
def g20_constraints(spark, sf):
    return rounded(B.constraints(_early_state(spark, sf))).fillna({"is_non_negative": False, "n_categories": 0})


def _early_state(spark, sf):
    early, _ = _batches(payments(spark, sf, ["date_of_payment", *PAY_NUMBERS, *CODES]))
    path = scratch_path(spark, "baseline")
    B.store_batch(early, path, "early", PAY_NUMBERS, CODES)
    return B.read_state(spark, path)


@register("g24_constraint_violations", "WITH " + DIRTY_SQL + f""",
e AS (SELECT * FROM payments WHERE {_EARLY}),
now AS (SELECT number AS amount, payments_read AS number_of_payments FROM read),
""" + "pairs AS (" + "\nUNION ALL ".join(f"""SELECT '{c}' AS col, (SELECT count({c}) / count(*) FROM e) AS eshare, (SELECT min({c}) FROM e) AS emin,
       (SELECT max({c}) FROM e) AS emax, count({c}) / count(*) AS share, min({c}) AS lo, max({c}) AS hi FROM now""" for c in PAY_NUMBERS) + """),
codes AS (SELECT 'nature' AS col, (SELECT count(nature) / count(*) FROM e) AS eshare, count(nature) / count(*) AS share FROM read
          UNION ALL SELECT 'form', (SELECT count(form) / count(*) FROM e), count(form) / count(*) FROM read)
SELECT col AS "column", 'completeness' AS "check", round(eshare, 6) AS expected, round(share, 6) AS actual FROM pairs WHERE share < eshare
UNION ALL SELECT col, 'completeness', round(eshare, 6), round(share, 6) FROM codes WHERE share < eshare
UNION ALL SELECT col, 'non_negative', 0, round(lo, 6) FROM pairs WHERE emin >= 0 AND lo < 0
UNION ALL SELECT col, 'below_min', round(emin, 6), round(lo, 6) FROM pairs WHERE lo < emin
UNION ALL SELECT col, 'above_max', round(emax, 6), round(hi, 6) FROM pairs WHERE hi > emax
UNION ALL SELECT 'form', 'new_category', 0, count(*) FROM dirty WHERE form IS NOT NULL AND form || '*' NOT IN (SELECT form FROM e WHERE form IS NOT NULL) HAVING count(*) > 0
UNION ALL SELECT 'recipient_type', 'missing_column', 1, 0
UNION ALL SELECT 'ownership_indicator', 'extra_column', 0, 1""")
def g24_violations(spark, sf):
    """A dirty batch against the constraints of the stored early one: signs not yet
    corrected, gaps, a renamed code, a column gone and one added."""
    raw = dirty_payments(spark, sf)
    now = raw.select(C.lenient_double("amount").alias("amount"), C.lenient_double("number_of_payments").alias("number_of_payments"),
                     F.concat("form", F.lit("*")).alias("form"), "nature", "ownership_indicator")
    base = _early_state(spark, sf)
    state = B.batch_state(now, PAY_NUMBERS, [*CODES, "ownership_indicator"])
    return rounded(B.violations(B.constraints(base), base, state))


@register("st1_intake_state", "WITH " + _bins_sql("events", ["value"]).strip(), payments=False)
def st1_state(spark, sf):
    """The intake stores the state of every micro-batch; all of them add up to the
    statistics of all events."""
    src, state = scratch_path(spark, "capture"), scratch_path(spark, "state")
    ST.capture_lines(table(spark, sf, "events")).repartition(8).write.mode("overwrite").text(src)
    ST.run_intake(spark, src, scratch_path(spark, "intake"), scratch_path(spark, "stream-ckpt"), ST.EVENT_RECORD,
                  files_per_batch=3, drift_cols=["value"], category_cols=["event_type"], state_dir=state)
    return rounded(B.merged_stats(B.read_state(spark, state)))
