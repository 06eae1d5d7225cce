"""Values that once came out wrong, and plans that once did too much."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.ordered import exact_quantiles
from ledgerlens.operators import clean as C
from ledgerlens.operators import features as D
from ledgerlens.operators import forest as IF
from ledgerlens.sources import files as S
from ledgerlens.sources.tables import LINEITEM_COLS, payments, record_key

SF001 = "/root/testdata/sf0.001"


def test_quantiles_equal_numpy_at_every_size(spark):
    rng = np.random.default_rng(1)
    probs = [0.0, 0.001, 0.01, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
    for n in (1, 2, 3, 10, 1010, 70_000):
        for x in (rng.normal(size=n), rng.integers(0, 5, n).astype(float), np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n))):
            df = spark.createDataFrame(pd.DataFrame({"x": x}))
            got = exact_quantiles(df, "x", probs, [], [f"q{i}" for i in range(len(probs))]).first()
            np.testing.assert_allclose(list(got), np.quantile(x, probs), rtol=1e-12)


def test_grouped_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(["hot", "hot", "hot", "a", "b", None], 5000), "x": rng.lognormal(size=5000)})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, x double")
    for bounded in (False, True):
        got = {r["g"]: (r["lo"], r["md"]) for r in exact_quantiles(df, "x", [0.1, 0.5], ["g"], ["lo", "md"],
                                                                  bounded_groups=bounded).collect()}
        for g in ("hot", "a", "b", None):
            x = pdf.x[pdf.g.isna() if g is None else pdf.g == g]
            assert got[g] == pytest.approx(tuple(np.quantile(x, [0.1, 0.5])), rel=1e-12)


def test_every_tree_gets_its_rows(spark):
    df = spark.range(300_00).select(F.col("id"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    nodes = IF.unpack_nodes(IF.fit_forests(df, "id", ["a", "b"], [IF.ForestSpec(0, 120, 8)]))
    root = nodes.where("node = 0").agg(F.count(F.lit(1)), F.min("n_samples"), F.max("n_samples")).first()
    assert tuple(root) == (120, 8, 8)
    small = IF.unpack_nodes(IF.fit_forests(df.limit(50), "id", ["a", "b"], [IF.ForestSpec(0, 5, 256)]))
    assert [r["n_samples"] for r in small.where("node = 0").collect()] == [50] * 5
    with pytest.raises(ValueError):
        IF.ForestSpec(0, 5, 0.9).resolve(1_000_000)


def test_bootstrap_draws_from_the_whole_table():
    spec = IF.ForestSpec(0, 20, 256, 1.0, True).resolve(20_000)
    draws = [IF.draw_rows(spec, t, 20_000) for t in range(20)]
    assert all(len(d) == 256 and len(set(d.tolist())) > 245 for d in draws)
    assert min(map(min, draws)) < 200 and max(map(max, draws)) > 19_800
    plain = IF.ForestSpec(0, 20, 256).resolve(300)
    assert all(len(set(IF.draw_rows(plain, t, 300).tolist())) == 256 for t in range(20))


def test_fold_grid_is_whole():
    c = IF.grid_candidates(IF.FOLD_GRID)
    assert len(c) == 24 and {x["n_estimators"] for x in c} == {150, 250} and {x["contamination"] for x in c} == {0.03, 0.05, 0.07}
    assert len(IF.grid_candidates()) == 48


def test_history_deviation_of_large_amounts(spark):
    rows = [("r", f"2020-01-0{d}", a) for d, a in ((1, 1e9), (2, 1e9 + 0.1), (3, 1e9 + 0.05), (4, 5.0))]
    df = spark.createDataFrame(rows, "recipient_id string, d string, amount double").withColumn("date_of_payment", F.to_timestamp("d"))
    got = {r["d"][-1]: r["hist_pay_std"] for r in D.time_history(df).collect()}
    assert got["3"] == pytest.approx(np.std([1e9, 1e9 + 0.1], ddof=1), rel=1e-6)
    assert got["4"] == pytest.approx(np.std([1e9, 1e9 + 0.1, 1e9 + 0.05], ddof=1), rel=1e-6) and got["2"] is None


def test_row_key_keeps_missing_values_apart(spark):
    base = dict.fromkeys(LINEITEM_COLS, None) | {"l_orderkey": 1}
    schema = ", ".join(f"{c} {'double' if c in ('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax') else 'string'}" for c in LINEITEM_COLS)
    rows = [base | {"l_orderkey": "1", "l_tax": 0.04}, base | {"l_orderkey": "1", "l_discount": 0.04},
            base | {"l_orderkey": "1", "l_tax": 0.041}]
    df = spark.createDataFrame([tuple(r[c] for c in LINEITEM_COLS) for r in rows], schema)
    assert df.select(record_key(df).alias("k")).distinct().count() == 3


def test_counts_dates_and_numbers_from_dirty_text(spark):
    rows = [("2.0", " -5.5", "02/23/2024", " la "), ("x", "n/a", "13/45/2024", None), (None, "inf", None, "Tx"), ("7", "1e3", "01/02/2020", "")]
    df = spark.createDataFrame(rows, "number_of_payments string, amount string, date_of_payment string, recipient_state string")
    got = C.convert_types(df).collect()
    assert [r["number_of_payments"] for r in got] == [2, 1, 1, 7]
    assert [r["amount"] for r in got] == [5.5, None, None, 1000.0]
    assert [r["date_of_payment"] and str(r["date_of_payment"])[:10] for r in got] == ["2024-02-23", None, None, "2020-01-02"]
    assert got[0]["recipient_state"] == "LA"


def test_inf_and_sparse_columns(spark):
    df = spark.createDataFrame([(1.0, None), (float("inf"), None), (float("nan"), 2.0)], "a double, b double")
    assert [r["a"] for r in C.inf_to_null(df).collect()] == [1.0, None, None]
    assert C.drop_sparse_columns(df, ["a", "b"], 0.5) == []
    assert C.drop_sparse_columns(df.limit(1), ["a", "b"], 0.5) == ["a"]
    assert C.positive_only(df.na.drop(), "b").count() <= 1


def test_previous_amount_is_the_previous_row(spark):
    rows = [("r", 1, "2020-01-01", 5.0), ("r", 1, "2020-01-02", None), ("r", 1, "2020-01-03", 7.0)]
    df = spark.createDataFrame(rows, "recipient_id string, payer_id int, d string, amount double").withColumn(
        "date_of_payment", F.to_timestamp("d")).withColumn("record_id", F.col("d"))
    assert [r["prev_amount"] for r in D.relationship_features(df).orderBy("d").collect()] == [None, 5.0, None]


def test_text_columns_by_fragment(spark):
    df = spark.createDataFrame([], "program_year int, recipient_zip_code int, payer_id int, amount double, grid int")
    typed = dict(S.force_string(df.schema).jsonValue() and [(f.name, f.dataType.simpleString()) for f in S.force_string(df.schema)])
    assert typed == {"program_year": "int", "recipient_zip_code": "string", "payer_id": "string", "amount": "double", "grid": "int"}
    bad = {r["column"] for r in S.schema_violations(df).collect()}
    assert bad == {"recipient_zip_code", "payer_id", "grid"}


def test_dictionary_accessors(spark):
    rows = [("Total", "d" * 120, "number", None), ("Name", None, None, "c")]
    fields = spark.createDataFrame(rows, "name string, description string, type string, constraints string")
    assert S.dictionary_lookup(fields, name="total").count() == 0
    one = S.dictionary_lookup(fields, name="Name").first()
    assert (one["type"], one["description"]) == ("Unknown", "No description available")
    hit = S.dictionary_lookup(fields, keyword="NAM").first()
    assert hit["description"] == "..." and len(S.dictionary_lookup(fields, keyword="tot").first()["description"]) == 103


def test_payments_reads_only_what_is_needed(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(payments(spark, SF001, []).agg(F.count(F.lit(1))))
    two = plan(payments(spark, SF001, ["recipient_type", "amount"]).groupBy("recipient_type").agg(F.sum("amount")))
    assert two.count("Join ") == 2 and "Repartition" not in two


def test_intake_before_the_first_file(spark, tmp_path):
    from ledgerlens.streaming import intake as ST

    (tmp_path / "in").mkdir()
    out = ST.run_intake(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), ST.EVENT_RECORD)
    assert out["records"].count() == 0 and "event_type" in out["records"].columns
