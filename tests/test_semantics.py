"""Semantics traps of the reference, each against a hand-made frame."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ledgerlens.functions.stats import half_even, sample_kurtosis, sample_skewness, weekday_mon0
from ledgerlens.operators import clean as C
from ledgerlens.operators import evaluate as G
from ledgerlens.operators import features as D
from ledgerlens.operators import profile as P


def _df(spark, pdf, schema=None):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), schema)


def test_t3_corrected_moments(spark):
    x = pd.Series([1.0, 2.0, 4.0, 10.0, 3.5, 7.25])
    d = P.describe(_df(spark, pd.DataFrame({"x": x}), "x double"), ["x"]).collect()[0]
    assert abs(d["skewness"] - x.skew()) < 1e-12
    assert abs(d["kurtosis"] - x.kurt()) < 1e-12
    assert abs(d["std"] - x.std()) < 1e-12
    assert abs(d["p50"] - x.median()) < 1e-12


def test_t4_t5_group_keys_and_null_sums(spark):
    pdf = pd.DataFrame({"g": ["a", "a", None, "b"], "v": [1.0, 2.0, 5.0, None]})
    df = _df(spark, pdf, "g string, v double")
    dropped = {r["g"]: r for r in P.group_stats(df, "v", ["g"], ("count", "sum"), None).collect()}
    assert set(dropped) == {"a", "b"} and dropped["b"]["sum"] == 0.0 and dropped["b"]["count"] == 0
    kept = {r["g"] for r in P.group_stats(df, "v", ["g"], ("count",), None, dropna=False).collect()}
    assert kept == {"a", "b", None}


def test_t6_weekday_monday_zero(spark):
    df = spark.createDataFrame([("2024-02-19",), ("2024-02-25",)], "d string").select(F.to_date("d").alias("d"))
    assert [r[0] for r in df.select(weekday_mon0("d")).collect()] == [0, 6]


def test_t7_mode_smallest_among_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "c string")
    out = C.mode_fill(df, ["c"]).collect()
    assert {r["c"] for r in out} == {"a", "b"} and sum(r["c"] == "a" for r in out) == 5


def test_t9_right_closed_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.4,), (0.40001,), (0.5,), (1.0,)], "h double")
    got = [r[0] for r in df.select(D.split_bins(F.col("h"))).collect()]
    assert got == [None, "train", "test", "test", "production"]


def test_t10_numpy_rounding(spark):
    vals = [2.675, 0.125, 1.005, 58002.355, 0.375, -2.5, 12.345]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(half_even("x", 2)).collect()]
    assert got == [float(np.round(v, 2)) for v in vals]


def test_t11_t12_degenerate_scalers(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 2.0), (3, 5.0, 3.0)], "id long, flat double, x double")
    rs = {r["column"]: r for r in D.robust_scale_fit(df, ["flat", "x"]).collect()}
    assert rs["flat"]["scale"] == 1.0 and rs["x"]["center"] == 2.0 and rs["x"]["scale"] == 1.0
    mm = D.scale_apply(df, D.minmax_fit(df, ["flat", "x"]), ["flat", "x"]).orderBy("id").collect()
    assert [r["flat"] for r in mm] == [0.0, 0.0, 0.0] and [r["x"] for r in mm] == [0.0, 0.5, 1.0]


def test_t24_clip_keeps_nulls_and_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, 1000.0), (5, 2.0), (6, 3.0)],
                               "id long, x double")
    out = {r["id"]: r["x"] for r in C.tukey_clip(df, ["x"], 1.0).collect()}
    assert out[2] is None and out[3] is None and out[4] < 1000.0


def test_roc_auc_matches_pairwise_definition(spark):
    rng = np.random.default_rng(9)
    s = rng.integers(0, 20, 300).astype(float)
    y = (rng.random(300) < 0.3).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"s": s, "y": y}))
    got = G.roc_auc(df, "s", "y").collect()[0][0]
    pos, neg = s[y == 1], s[y == 0]
    exp = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(got - exp) < 1e-12
    roc = G.roc_points(df, "s", "y").orderBy(F.col("threshold").desc()).toPandas()
    assert roc["tpr"].is_monotonic_increasing and abs(roc["tpr"].iloc[-1] - 1.0) < 1e-12


def test_separation_guards(spark):
    df = spark.createDataFrame([(float(i), 0) for i in range(10)] + [(-5.0, 1)], "s double, f int")
    assert G.separation(df, "s", "f").collect()[0]["separation"] == 0.0          # too few flagged
    assert G.separation(df, "s", "f", min_group=1, contamination=0.05).collect()[0]["separation"] > 0


def test_before_after_and_derived(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, None)], "k long, v double")
    rows = {r["stage"]: r for r in P.before_after(df, C.drop_duplicates(df)).collect()}
    assert rows["before"]["duplicate_rows"] == 1 and rows["after"]["n_rows"] == 2
    agg = spark.createDataFrame([(3.0, 1.0, 10.0, 2, 1)], "amount_std double, amount_mean double, amount_sum double, "
                                                        "form_nunique long, nature_nunique long")
    d = D.derived_features(agg).collect()[0]
    assert d["amount_cv"] == 1.5 and abs(d["log_total_amount"] - np.log1p(10.0)) < 1e-12
