import numpy as np
import pandas as pd

from ledgerlens.operators import clean as C


def test_prepare_matrix_equals_sequential_steps(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": range(400), "a": rng.lognormal(size=400), "b": rng.integers(0, 3, 400).astype(float)})
    pdf.loc[::17, "a"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id long, a double, b double")
    out, params = C.prepare_matrix(df, ["a", "b"], 3.0)
    # pandas reference: clip with quartiles, fill median, then robust-scale stats
    exp = pdf.copy()
    for c in ["a", "b"]:
        q1, q3 = exp[c].quantile(0.25), exp[c].quantile(0.75)
        exp[c] = exp[c].clip(q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1))
    exp = exp.fillna(exp[["a", "b"]].median())
    got = out.toPandas().sort_values("id")
    np.testing.assert_allclose(got[["a", "b"]].to_numpy(dtype=float), exp[["a", "b"]].to_numpy(), rtol=1e-12)
    p = {r["column"]: r for r in params.collect()}
    for c in ["a", "b"]:
        q1, med, q3 = exp[c].quantile([0.25, 0.5, 0.75])
        assert abs(p[c]["center"] - med) < 1e-12
        assert abs(p[c]["scale"] - ((q3 - q1) if q3 > q1 else 1.0)) < 1e-12


def test_dedup_keeps_latest(spark):
    df = spark.createDataFrame([(1, 5, 10.0), (1, 7, 3.0), (2, 1, 4.0), (2, 1, 9.0)], "k long, d long, v double")
    out = {r["k"]: (r["d"], r["v"]) for r in C.dedup_by_record(df, "k", "d").collect()}
    assert out == {1: (7, 3.0), 2: (1, 9.0)}


def test_indicator_and_types(spark):
    df = spark.createDataFrame([(" la ", "-5.5", "Yes", None), ("ny", "abc", "No Third Party Payment", "2")],
                               "recipient_state string, amount string, ind string, number_of_payments string")
    out = C.convert_types(df, date=None, indicators=["ind"]).collect()
    assert out[0]["recipient_state"] == "LA" and out[0]["amount"] == 5.5 and out[0]["ind"] == 1
    assert out[0]["number_of_payments"] == 1 and out[1]["number_of_payments"] == 2
    assert out[1]["amount"] is None and out[1]["ind"] == 0


def test_forward_backward_fill(spark):
    pdf = pd.DataFrame({"k": [3, 1, 2, 5, 4], "v": [None, None, 2.0, None, 4.0]})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k long, v double")
    got = C.forward_backward_fill(df, "v", ["k"]).toPandas().sort_values("k")["v"].tolist()
    assert got == [2.0, 2.0, 2.0, 4.0, 4.0]


def test_select_present_first_present_numeric_features(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 3)], "Recipient_ID long, amount double, state string, zip_code long")
    kept, missing = C.select_present(df, ["amount", "physician_specialty", "state"])
    assert kept.columns == ["amount", "state"] and missing == ["physician_specialty"]
    assert C.first_present(df, ["nope", "recipient_id"]) == "Recipient_ID"
    assert C.numeric_features(df) == ["amount"]


def test_clean_extract_moves_its_rows_twice(spark, monkeypatch):
    import pandas as pd

    from ledgerlens.functions import ordered as O

    n = 400
    day = ["13/45/2020" if i < 5 or i % 7 == 0 else f"03/{1 + i % 28:02d}/2021" for i in range(n)]
    pdf = pd.DataFrame({"id": [f"{i:04d}" for i in range(n)], "recipient_id": "r", "recipient_state": " ny ", "amount": [str(i % 50) for i in range(n)],
                        "date_of_payment": day, "number_of_payments": "2", "price": [float(i % 40) for i in range(n)]})
    df = spark.createDataFrame(pd.concat([pdf, pdf[::9]]))
    passes, plain = [], O.running
    monkeypatch.setattr(C, "running", lambda *a, **k: passes.append(1) or plain(*a, **k))
    out = C.clean_extract(df, ["id"], mode_cols=(), clip=(0.0, 0.5))
    assert len(passes) == 1                                  # forward fill; the backward fill needs no second ordered pass
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().toString()        # the distinct rows are written
    got = out.toPandas().sort_values("id")
    exp = pd.to_datetime(pdf["date_of_payment"], format="%m/%d/%Y", errors="coerce").ffill().bfill()
    keep = pdf["amount"] != "0"
    assert got["id"].tolist() == pdf["id"][keep].tolist()
    assert got["date_of_payment"].dt.strftime("%Y-%m-%d").tolist() == exp[keep].dt.strftime("%Y-%m-%d").tolist()
    assert got["price"].max() == float(pdf["price"][keep].quantile(0.5))


def test_fill_of_rows_before_a_groups_first_value(spark):
    rows = [("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("b", 1, None), ("b", 2, None), (None, 1, None), (None, 2, 7.0)]
    df = spark.createDataFrame(rows, "g string, k int, v double")
    got = {(r["g"], r["k"]): r["v"] for r in C.forward_backward_fill(df, "v", ["k"], ["g"]).collect()}
    assert got == {("a", 1): 5.0, ("a", 2): 5.0, ("a", 3): 5.0, ("b", 1): None, ("b", 2): None, (None, 1): 7.0, (None, 2): 7.0}
    assert C.forward_backward_fill(df.where("v IS NULL"), "v", ["k"]).where("v IS NOT NULL").count() == 0
