"""Hot keys: one group holds a third of the rows.  Each operator must give the
brute-force answer on such a frame, split over several partitions."""
import numpy as np
import pandas as pd

from ledgerlens.functions.stats import group_mode
from ledgerlens.operators import features as D


def _hot_frame(n=3000, seed=7):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 1 / 3, "HOT", np.array([f"k{i}" for i in rng.integers(0, 60, n)]))
    day = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 120, n), unit="D")
    amount = np.round(rng.gamma(2.0, 50.0, n), 2)
    amount[rng.random(n) < 0.05] = np.nan
    nature = np.array(["a", "b", "c", "d"])[rng.integers(0, 4, n)].astype(object)
    nature[rng.random(n) < 0.1] = None
    return pd.DataFrame({"record_id": np.arange(n), "recipient_id": key, "date_of_payment": day,
                         "amount": amount, "nature": nature})


def _spark_df(spark, pdf):
    schema = "record_id long, recipient_id string, date_of_payment timestamp, amount double, nature string"
    rows = [(int(r.record_id), r.recipient_id, r.date_of_payment.to_pydatetime(),
             None if pd.isna(r.amount) else float(r.amount), r.nature) for r in pdf.itertuples()]
    return spark.createDataFrame(rows, schema).repartition(6)


def test_group_mode_hot_group_matches_pandas(spark):
    pdf = _hot_frame()
    got = {r["recipient_id"]: r["m"] for r in
           group_mode(_spark_df(spark, pdf), ["recipient_id"], "nature", "m").collect()}
    want = {k: sorted(g.mode().tolist())[0] for k, g in pdf.groupby("recipient_id")["nature"] if g.notna().any()}
    assert got == want


def test_time_history_hot_recipient_matches_brute_force(spark):
    pdf = _hot_frame()
    out = D.time_history(_spark_df(spark, pdf)).toPandas().set_index("record_id").sort_index()
    day = pdf["date_of_payment"].dt.normalize()
    for rid in pdf["record_id"].to_numpy()[::37]:
        r = pdf.loc[rid]
        prev = pdf.loc[(pdf["recipient_id"] == r["recipient_id"]) & (day < day.loc[rid]), "amount"].dropna()
        got = out.loc[rid]
        assert got["hist_pay_count"] == len(prev)
        assert np.isclose(got["hist_pay_total"], prev.sum())
        if len(prev):
            assert np.isclose(got["hist_pay_avg"], prev.mean()) and np.isclose(got["hist_pay_max"], prev.max())
        if len(prev) > 1:
            assert np.isclose(got["hist_pay_std"], prev.std())


def test_rolling_sums_hot_recipient_matches_brute_force(spark):
    pdf = _hot_frame()
    out = D.rolling_sums(_spark_df(spark, pdf), days=30).toPandas()
    day = pdf["date_of_payment"].dt.normalize()
    for _, r in out[out["recipient_id"] == "HOT"].iterrows():
        d = pd.Timestamp(r["day"])
        w = pdf[(pdf["recipient_id"] == "HOT") & (day >= d - pd.Timedelta(days=30)) & (day <= d)]["amount"]
        assert r["n_payments_30d"] == w.notna().sum()
        assert np.isclose(r["total_amount_30d"], w.sum())
