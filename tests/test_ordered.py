import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ledgerlens.functions.ordered import exact_quantiles, running, tie_average_rank


def _frame(spark, n=3000, groups=5, seed=1):
    rng = np.random.default_rng(seed)
    # a hot group holding most rows, some NULL values, repeated order keys avoided
    g = rng.choice(["a", "b", "c", "d", None], size=n, p=[0.6, 0.2, 0.1, 0.05, 0.05])
    pdf = pd.DataFrame({"g": g, "k": np.arange(n), "v": rng.normal(size=n).round(3)})
    pdf.loc[rng.choice(n, 200, replace=False), "v"] = np.nan
    return pdf, spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None))


def test_running_sum_max_last_grouped(spark):
    pdf, df = _frame(spark)
    key = pdf["g"].fillna("~")
    srt = pdf.assign(key=key).sort_values(["key", "k"])
    for how in ("sum", "max", "last"):
        out = running(df, ["k"], ["v"], ["g"], how=how, out_cols=["r"], num_partitions=13).toPandas()
        out = out.sort_values("k").set_index("k")["r"]
        grp = srt.groupby("key")["v"]
        exp = {"sum": grp.cumsum(), "max": grp.cummax().groupby(srt["key"]).ffill(), "last": grp.ffill()}[how]
        if how == "sum":
            exp = srt.assign(v=srt.v.fillna(0)).groupby("key")["v"].cumsum()
        exp = pd.Series(exp.values, index=srt["k"]).sort_index()
        np.testing.assert_allclose(out.values.astype(float), exp.values.astype(float), rtol=1e-9, equal_nan=True)


def test_running_exclusive(spark):
    pdf, df = _frame(spark, seed=2)
    out = running(df, ["k"], ["v"], ["g"], how="sum", out_cols=["r"], num_partitions=11, exclusive=True).toPandas()
    srt = pdf.assign(key=pdf["g"].fillna("~"), v0=pdf.v.fillna(0)).sort_values(["key", "k"])
    exp = srt.groupby("key")["v0"].cumsum() - srt["v0"]
    exp = pd.Series(exp.values, index=srt["k"]).sort_index()
    got = out.sort_values("k")["r"].values.astype(float)
    np.testing.assert_allclose(got, exp.values, atol=1e-9)
    outm = running(df, ["k"], ["v"], ["g"], how="max", out_cols=["r"], num_partitions=7, exclusive=True).toPandas()
    expm = srt.groupby("key")["v"].transform(lambda s: s.cummax().ffill().shift(1))
    expm = pd.Series(expm.values, index=srt["k"]).sort_index()
    np.testing.assert_allclose(outm.sort_values("k")["r"].values.astype(float), expm.values.astype(float), equal_nan=True)


def test_running_global_desc(spark):
    pdf, df = _frame(spark, seed=3)
    out = running(df, [F.col("k").desc()], ["v"], [], how="sum", out_cols=["r"], num_partitions=9).toPandas()
    srt = pdf.sort_values("k", ascending=False)
    exp = pd.Series(srt.v.fillna(0).cumsum().values, index=srt.k).sort_index()
    np.testing.assert_allclose(out.sort_values("k")["r"].values.astype(float), exp.values, atol=1e-9)


def test_exact_quantiles_match_numpy(spark):
    pdf, df = _frame(spark, seed=4)
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]
    out = exact_quantiles(df, "v", probs, ["g"], names=[f"p{i}" for i in range(len(probs))]).toPandas()
    for _, row in out.iterrows():
        sel = pdf["g"].isna() if row["g"] is None else (pdf["g"] == row["g"])
        vals = pdf.loc[sel, "v"].dropna().values
        exp = np.percentile(vals, [p * 100 for p in probs])
        np.testing.assert_allclose([row[f"p{i}"] for i in range(len(probs))], exp, rtol=1e-12, atol=1e-12)
    glob = exact_quantiles(df, "v", [0.5], names=["med"]).collect()[0]["med"]
    assert abs(glob - np.nanmedian(pdf.v.values)) < 1e-12


def test_tie_average_rank(spark):
    pdf = pd.DataFrame({"id": range(8), "s": [3.0, 1.0, 3.0, 2.0, 2.0, 2.0, 5.0, None]})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None))
    out = tie_average_rank(df, "s", out_col="r").toPandas().sort_values("id")
    exp = pdf["s"].rank(pct=True)
    np.testing.assert_allclose(out["r"].values.astype(float), exp.values, equal_nan=True)


def test_exact_quantiles_per_group_probability(spark):
    # a different quantile per group, given as a Column over the group key
    pdf, df = _frame(spark, seed=5)
    want = {"a": 0.05, "b": 0.5, "c": 0.9, "d": 0.999}
    p = F.create_map(*[x for g, q in want.items() for x in (F.lit(g), F.lit(q))])[F.col("g")]
    out = exact_quantiles(df.where(F.col("g").isNotNull()), "v", [p], ["g"], ["q"]).toPandas()
    assert set(out["g"]) == set(want)
    for _, row in out.iterrows():
        vals = pdf.loc[pdf["g"] == row["g"], "v"].dropna().values
        assert abs(row["q"] - np.percentile(vals, want[row["g"]] * 100)) < 1e-12


def test_quantiles_by_digits_count_and_move_no_rows(spark, monkeypatch):
    from ledgerlens.functions import ordered as O
    from ledgerlens.operators import clean as C

    rng = np.random.default_rng(9)
    n = 20_000
    pdf = pd.DataFrame({"a": rng.normal(size=n), "few": rng.integers(0, 3, n) * 1.0, "near": 1.6e9 + rng.random(n) * 1e-3, "none": np.nan,
                        "gaps": np.where(rng.random(n) < 0.3, np.nan, -1e6 * rng.lognormal(size=n)), "zero": rng.choice([0.0, -0.0, 5e-324, 2.0], n)})
    df = spark.createDataFrame(pdf).repartition(5)
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 1.0]
    for few, buckets in ((100_000, 1 << 20), (0, 1 << 8)):
        monkeypatch.setattr(O, "DIGIT_FEW", few)
        monkeypatch.setattr(O, "DIGIT_BUCKETS", buckets)
        got = O.wide_quantiles(df, list(pdf.columns), probs)
        assert got.pop("none") is None
        for c, values in got.items():
            v, at = np.sort(pdf[c].dropna()), [(pdf[c].count() - 1) * p for p in probs]
            assert values == [O._linear_value(v[int(np.floor(x))], v[int(np.ceil(x))], x - np.floor(x)) for x in at], c
            np.testing.assert_allclose(values, np.quantile(v, probs), rtol=1e-12)
    # the old way turned every value into a row
    def no_rows(*_):
        raise AssertionError("rows were unpivoted")
    monkeypatch.setattr("pyspark.sql.DataFrame.unpivot", no_rows)
    assert {r["column"] for r in C.column_quantiles(df, list(pdf.columns), [0.5], ["m"]).collect()} == set(pdf.columns) - {"none"}
