"""The stored baseline, quarantine and the cleaning path against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.stats import lenient_double
from ledgerlens.operators import baseline as B
from ledgerlens.operators import clean as C
from ledgerlens.operators import monitor as MON
from ledgerlens.streaming import intake as ST

SCHEMA = "x double, flat double, code string"


def _rows(seed, n):
    r = np.random.default_rng(seed)
    x = [None if i % 17 == 0 else float("nan") if i % 19 == 0 else float("inf") if i % 23 == 0 else 0.0 if i % 29 == 0
         else float(v) for i, v in enumerate(r.normal(0, 1000, n))]
    return [(v, 1e9, None if i % 5 == 0 else f"c{i % 3}") for i, v in enumerate(x)]


def _values(rows, k=0):
    return np.array([r[k] for r in rows if r[k] is not None and math.isfinite(r[k])])


def test_batches_add_up_and_a_retry_replaces(spark, tmp_path):
    path, parts = str(tmp_path / "state"), [_rows(1, 900), _rows(2, 50), _rows(3, 1)]
    B.store_batch(spark.createDataFrame(parts[0][:300], SCHEMA), path, 0, ["x", "flat"], ["code"])   # an attempt that failed half way
    for i, rows in enumerate(parts):
        B.store_batch(spark.createDataFrame(rows, SCHEMA), path, i, ["x", "flat"], ["code"])
    B.store_batch(spark.createDataFrame([], SCHEMA), path, "empty", ["x", "flat"], ["code"])
    every = sum(parts, [])
    got = {r["column"]: r for r in B.merged_stats(B.read_state(spark, path)).collect()}
    v = _values(every)
    r = got["x"]
    assert (r["count"], r["missing"]) == (len(v), len(every) - len(v))
    assert [r["mean"], r["std"], r["min"], r["max"]] == pytest.approx([v.mean(), v.std(ddof=1), v.min(), v.max()])
    for i in range(1, 10):
        exact = np.sort(v)[math.ceil(len(v) * i / 10 - 1e-9) - 1]
        assert r[f"p{i}0"] == pytest.approx(exact, rel=0.02, abs=1e-12)
    assert got["flat"]["std"] == 0 and got["flat"]["p50"] == 1e9          # nothing cancels far from zero
    one = B.merged_stats(B.read_state(spark, path, [1])).where("column = 'x'").first()
    assert one["count"] == len(_values(parts[1]))
    assert B.merged_stats(B.read_state(spark, path, ["empty"])).count() == 0
    # drop-in for the exact statistics
    drift = MON.feature_drift(B.merged_stats(B.read_state(spark, path)), B.merged_stats(B.batch_state(spark.createDataFrame(every, SCHEMA), ["x", "flat"])))
    assert all(abs(r["relative_change"]) < 1e-9 for r in drift.collect())


def test_bins_keep_the_order(spark):
    xs = [-1e300, -5.0, -4.0, -1e-300, 0.0, 5e-324, 1e-300, 0.5, 1.0, 1.03, 7.0, 1e308]
    bins = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(B.log_bin(F.col("x"))).collect()]
    assert bins == sorted(bins) and len(set(bins)) == len(bins)
    assert spark.range(1).select(B.log_bin(F.lit(None).cast("double"))).first()[0] is None


def test_constraints_and_violations(spark):
    base = B.batch_state(spark.createDataFrame([(1.0, 5.0, "a"), (2.0, 6.0, "b")], SCHEMA), ["x", "flat"], ["code"])
    c = {r["column"]: r for r in B.constraints(base).collect()}
    assert (c["x"]["completeness"], c["x"]["is_non_negative"], c["x"]["min"], c["x"]["max"], c["x"]["n_categories"]) == (1.0, True, 1.0, 2.0, None)
    assert (c["code"]["kind"], c["code"]["n_categories"], c["code"]["min"]) == ("text", 2, None)
    now = spark.createDataFrame([(-1.0, "a", "z", 1.0), (None, None, "z", 2.0), (9.0, "a", "b", 3.0), (1.5, "a", None, 4.0)],
                                "x double, flat string, code string, more double")
    state = B.batch_state(now, ["x", "more"], ["flat", "code"])
    got = {(r["column"], r["check"]): (r["expected"], r["actual"]) for r in B.violations(B.constraints(base), base, state).collect()}
    assert got == {("x", "completeness"): (1.0, 0.75), ("x", "non_negative"): (0.0, -1.0), ("x", "below_min"): (1.0, -1.0),
                   ("x", "above_max"): (2.0, 9.0), ("flat", "kind"): (1.0, 0.0), ("code", "completeness"): (1.0, 0.75),
                   ("code", "new_category"): (0.0, 2.0), ("more", "extra_column"): (0.0, 1.0)}
    assert B.violations(B.constraints(base), base, base).count() == 0
    gone = B.violations(B.constraints(base), base, B.batch_state(now.select("more"), ["x", "more"], ["code"])).collect()
    assert {(r["column"], r["check"]) for r in gone} == {("x", "missing_column"), ("flat", "missing_column"), ("code", "missing_column"), ("more", "extra_column")}
    only_missing = B.batch_state(spark.createDataFrame([(None, 5.0, "a")], SCHEMA), ["x", "flat"], ["code"])
    assert [(r["column"], r["check"]) for r in B.violations(B.constraints(base), base, only_missing).collect()] == [("x", "completeness")]
    assert B.merged_stats(only_missing).where("column = 'x'").select("count", "missing", "mean", "p50").first() == (0, 1, None, None)


def test_intake_checks_each_batch_against_the_stored_baseline(spark, tmp_path):
    kept, state, src = (str(tmp_path / n) for n in ("kept", "state", "in"))
    B.store_batch(spark.createDataFrame([(1.0, "view"), (3.0, "view")], "value double, event_type string"), kept, "first", ["value"], ["event_type"])

    def capture(rows):
        ST.capture_lines(spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts string")).coalesce(1).write.mode("append").text(src)

    def run():
        return ST.run_intake(spark, src, str(tmp_path / "out"), str(tmp_path / "ckpt"), ST.EVENT_RECORD, drift_cols=["value"],
                             category_cols=["event_type"], state_dir=state, baseline_dir=kept)

    capture([(1, 1, "view", 2.0, "t"), (2, 1, "view", 2.0, "t")])
    first = run()
    assert first["violations"].count() == 0 and [r["relative_change"] for r in first["drift"].collect()] == [0.0]
    capture([(3, 1, "click", -4.0, "t"), (4, 1, "view", 2.0, "t")])
    second = run()
    assert {(r["column"], r["check"]) for r in second["violations"].collect()} == {
        ("value", "non_negative"), ("value", "below_min"), ("event_type", "new_category")}
    assert {r["batch"] for r in second["violations"].collect()} == {1} and second["drift"].where("drift_alarm").count() == 1
    total = B.merged_stats(B.read_state(spark, state)).first()
    assert (total["count"], total["mean"], total["min"], total["max"]) == (4, 0.5, -4.0, 2.0)
    with pytest.raises(ValueError, match="differ"):
        ST.run_intake(spark, src, str(tmp_path / "o2"), str(tmp_path / "c2"), ST.EVENT_RECORD, state_dir=kept, baseline_dir=kept)


RAW = "id string, recipient_id string, amount string, date_of_payment string, number_of_payments string, nature string"


def test_quarantine_loses_no_row(spark, tmp_path):
    rows = [("1", "r", "5.0", "01/02/2020", "1", "ok"), ("1", "r", "5.0", "01/02/2020", "1", "ok"), ("2", " ", "x", "2020-01-02", "two", "ok"),
            ("3", "r", None, None, None, None), ("4", "r", "0", "01/02/2020", "2.0", "odd"), ("4", "r", "0", "01/02/2020", "2.0", "odd"),
            ("5", None, "inf", "02/30/2020", "", "ok"), ("6", "r", "-3", "12/31/2020", None, "ok"), ("7", "r", "12d", "12/31/2020", "1", "ok")]
    df, listed = spark.createDataFrame(rows, RAW), spark.createDataFrame([("ok",), ("ok",), (None,)], "v string")
    good, bad = C.quarantine(df, str(tmp_path / "q"), C.strict_rules(), {"nature": listed})
    assert sorted((r["id"], r["n_copies"]) for r in good.collect()) == [("1", 2), ("6", 1)] and good.columns == [*df.columns, "n_copies"]
    assert {r["id"]: (r["n_copies"], r["reasons"]) for r in bad.collect()} == {
        "2": (1, ["amount_unreadable", "date_unreadable", "count_unreadable", "key_missing"]),
        "3": (1, ["amount_missing", "date_missing", "nature_not_listed"]), "4": (2, ["amount_zero", "nature_not_listed"]),
        "5": (1, ["amount_unreadable", "date_unreadable", "key_missing"]), "7": (1, ["amount_unreadable"])}
    report = {r["outcome"]: r["n_rows"] for r in C.quarantine_report(good, bad).collect()}
    assert (report["accepted"], report["rejected"], report["duplicate"], report["nature_not_listed"]) == (3, 6, 2, 3)
    assert report["accepted"] + report["rejected"] == len(rows)
    assert "PartitionFilters: [isnotnull(accepted" in good._jdf.queryExecution().toString()
    none, nothing = C.quarantine(df.limit(0), str(tmp_path / "empty"), C.strict_rules())
    assert none.count() == 0 and nothing.count() == 0
    with pytest.raises(ValueError, match="reserved"):
        C.quarantine(df.withColumn("reasons", F.lit(1)), str(tmp_path / "r"), {})


def test_whole_path_on_dirty_rows(spark):
    rows = [("1", "a", " 10 ", None, "1", "x", 1.0, None), ("2", None, "-20", "01/02/2020", "2.0", None, float("nan"), None),
            ("3", "a", "n/a", "bad", "two", "x", 3.0, "t"), ("4", "b", "0", "01/04/2020", None, "y", float("inf"), None),
            ("5", "b", "30", None, "1", "x", 2.0, None), ("5", "b", "30", None, "1", "x", 2.0, None)]
    df = spark.createDataFrame(rows, RAW + ", price double, note string")
    got = {r["id"]: r for r in C.clean_extract(df, ["id"], mode_cols=("nature",), clip=None).collect()}
    assert set(got) == {"1", "2", "3", "5"} and "note" not in got["1"]          # 4 has amount 0, note is nearly empty
    assert {i: r["amount"] for i, r in got.items()} == {"1": 10.0, "2": 20.0, "3": 20.0, "5": 30.0}     # median of 10 20 0 30 30
    assert {i: str(r["date_of_payment"])[:10] for i, r in got.items()} == {"1": "2020-01-02", "2": "2020-01-02", "3": "2020-01-02", "5": "2020-01-04"}
    assert {i: r["number_of_payments"] for i, r in got.items()} == {"1": 1, "2": 2, "3": 1, "5": 1}
    assert got["2"]["nature"] == "x" and got["2"]["recipient_id"] == "Unknown" and got["2"]["price"] == 2.0
    assert C.clean_extract(df.limit(0), ["id"], mode_cols=("nature",)).count() == 0


def test_numbers_with_a_suffix_are_no_numbers(spark):
    texts = ["1", " 2.5 ", "3d", "4F", "1e3", "0x1p3", "-7", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(lenient_double("t")).collect()]
    assert got[:5] == [1.0, 2.5, None, None, 1000.0] and got[6:] == [-7.0, None, None]
    assert spark.range(1).select(lenient_double(F.lit(2.5))).first()[0] == 2.5
    assert pd.to_numeric(pd.Series(["3d"]), errors="coerce").isna().all()
