"""Group lookups: hot groups, null groups, both ways of travelling."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import skew
from ledgerlens.functions.ordered import exact_quantiles, tie_average_rank
from ledgerlens.operators import features as D


@pytest.fixture
def rows():
    rng = np.random.default_rng(8)
    n = 6000
    g = np.where(rng.random(n) < 0.35, "hot", rng.choice([f"g{i}" for i in range(400)] + [None], n).astype(object))
    return pd.DataFrame({"id": range(n), "g": g, "h": rng.integers(0, 3, n), "x": rng.lognormal(size=n).round(2)})


@pytest.mark.parametrize("limit", [0, 20_000])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_equals_a_merge(spark, rows, monkeypatch, limit, how):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "id long, g string, h long, x double").repartition(6)
    answers = df.where("g IS NULL OR g <> 'g7'").groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("top"))
    got = skew.group_lookup(df, answers, ["g", "h"], how).toPandas().set_index("id").sort_index()
    want = rows.assign(g=rows.g.fillna("-null-"))
    stat = want[want.g != "g7"].groupby(["g", "h"])["x"].agg(n="count", top="max").reset_index()
    want = want.merge(stat, on=["g", "h"], how=how).set_index("id").sort_index()
    assert got.columns.tolist() == ["g", "h", "x", "n", "top"] and len(got) == len(want)
    np.testing.assert_array_equal(got["n"].fillna(-1).to_numpy(float), want["n"].fillna(-1).to_numpy(float))
    np.testing.assert_array_equal(got["top"].fillna(-1).to_numpy(), want["top"].fillna(-1).to_numpy())


def test_a_hot_group_spreads_over_tasks(spark, rows, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame(rows.assign(g=np.where(np.arange(len(rows)) % 3 == 0, "hot", rows.g.fillna("-"))), "id long, g string, h long, x double")
        df = df.repartition(16, "id")
        out = skew.group_lookup(df, df.groupBy("g").agg(F.count(F.lit(1)).alias("n")), ["g"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "_run" in plan and "BroadcastHashJoin" not in plan
        hot = out.where("g = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"]
        assert hot.sum() > 2000 and len(hot) >= 8 and hot.max() < hot.sum() / 3
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("limit", [0, 20_000])
def test_operators_over_lookups(spark, rows, monkeypatch, limit):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "id long, g string, h long, x double").repartition(5)
    key = rows.g.fillna("-null-")
    q = {r["g"]: r["m"] for r in exact_quantiles(df, "x", [0.5], ["g"], ["m"]).collect()}
    for g, part in rows.x.groupby(key):
        assert q[None if g == "-null-" else g] == pytest.approx(np.median(part), rel=1e-12)
    p = tie_average_rank(df, "x").toPandas().set_index("id").sort_index()["pct_rank"]
    np.testing.assert_allclose(p, rows.x.rank(pct=True), rtol=1e-12)
    z = D.peer_scores(df, "x", ["g"]).toPandas().set_index("id").sort_index()
    np.testing.assert_allclose(z["peer_median"], rows.x.groupby(key).transform("median"), rtol=1e-12)
    f = D.frequency_encode(df, "g").toPandas().set_index("id").sort_index()["g_freq"]
    np.testing.assert_allclose(f, key.groupby(key).transform("count") / len(rows))


def test_selection_narrows_until_few_are_left(spark, monkeypatch):
    from ledgerlens.functions import ordered

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=30_000), np.full(20_000, 0.25), rng.lognormal(3, 4, 10_000)])
    df = spark.createDataFrame(pd.DataFrame({"x": x, "k": rng.choice(["a", "b"], len(x), p=[0.9, 0.1])})).repartition(4)
    probs = [0.0, 0.1, 0.4, 0.5, 0.9, 0.9999, 1.0]
    monkeypatch.setattr(ordered, "SELECT_ACCURACY", 50)          # brackets of an eighth of the rows at first
    for few in (1, 40, 1000):
        monkeypatch.setattr(ordered, "FEW", few)
        got = list(exact_quantiles(df, "x", probs, [], [f"q{i}" for i in range(7)]).first())
        np.testing.assert_allclose(got, np.quantile(x, probs), rtol=1e-12)
    pdf = df.toPandas()
    for r in exact_quantiles(df, "x", [0.25, 0.75], ["k"], ["a", "b"], bounded_groups=True).collect():
        np.testing.assert_allclose([r["a"], r["b"]], np.quantile(pdf.x[pdf.k == r["k"]], [0.25, 0.75]), rtol=1e-12)
    assert exact_quantiles(df.limit(0), "x", [0.5], [], ["m"]).first()["m"] is None
    assert exact_quantiles(df.limit(0), "x", [0.5], ["k"], ["m"], bounded_groups=True).collect() == []
