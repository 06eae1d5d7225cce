"""External tables, reason-code mix and sudden changes against plain versions."""

import math
import statistics

import pandas as pd
import pytest

from ledgerlens.operators import features as D
from ledgerlens.operators import monitor as MON
from ledgerlens.sources import files as S

from test_skew import _hot_frame, _spark_df


def test_external_table_statements(spark, tmp_path):
    path = str(tmp_path / "it's a table")
    df = spark.createDataFrame([(1, "a,b", "x"), (2, None, "y")], "id long, `odd name` string, part string")
    df.write.partitionBy("part").option("header", True).csv(path)
    t = S.create_external_table(spark, "ext_pay", path, df.schema, "csv", ["part"], {"header": "true"})
    assert sorted(map(tuple, t.collect())) == [(1, "a,b", "x"), (2, None, "y")]
    assert ("ext_pay", False) in [tuple(r) for r in S.show_tables(spark, "ext_*").collect()]
    assert [tuple(r) for r in S.describe_table(spark, "ext_pay").collect()] == [
        ("id", "bigint", False), ("odd name", "string", False), ("part", "string", True)]
    df.limit(1).drop("part").write.option("header", True).csv(path + "/part=z")
    S.recover_partitions(spark, "ext_pay")
    assert [r[0] for r in S.show_partitions(spark, "ext_pay").collect()] == ["part=x", "part=y", "part=z"]
    assert spark.table("ext_pay").count() == 3
    assert "PartitionFilters: [isnotnull(part" in spark.table("ext_pay").where("part = 'z'")._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        S.create_external_table(spark, "ext_pay", path, df.schema, "csv", ["part"])
    S.create_external_table(spark, "ext_pay", path, df.schema, "csv", ["part"], {"header": "true"}, replace=True)
    S.drop_table(spark, "ext_pay")
    S.drop_table(spark, "ext_pay")
    assert S.show_tables(spark, "ext_pay").count() == 0 and spark.read.option("header", True).csv(path).count() == 3


def test_reason_mix(spark):
    schema = "reason_codes string"
    base = spark.createDataFrame([("a;b",), ("a",), ("",), (None,), ("a;a",)], schema)
    cur = spark.createDataFrame([("a;c",), ("c",), ("c;;",)], schema)
    mix = MON.mix_drift(base, cur)
    got = {r["code"]: r.asDict() for r in mix.collect()}
    assert {c: (r["baseline_rows"], r["current_rows"], r["status"]) for c, r in got.items()} == {
        "a": (3, 1, "both"), "b": (1, 0, "gone"), "(none)": (2, 0, "gone"), "c": (0, 3, "new")}
    p, q = [r["baseline_share"] for r in got.values()], [r["current_share"] for r in got.values()]
    assert sum(p) == pytest.approx(1) and sum(q) == pytest.approx(1)
    d = MON.mix_distance(mix).first()
    js = sum(x * math.log2(2 * x / (a + b)) for a, b in zip(p, q) for x in (a, b) if x > 0) / 2
    assert d["total_variation"] == pytest.approx(sum(abs(a - b) for a, b in zip(p, q)) / 2) and d["jensen_shannon"] == pytest.approx(math.sqrt(js))
    assert (d["n_new"], d["n_gone"], d["mix_alarm"]) == (1, 2, True)
    assert MON.mix_distance(MON.mix_drift(base, base)).first()["total_variation"] == 0
    none = MON.mix_distance(MON.mix_drift(base.limit(0), cur.limit(0))).first()
    assert (none["total_variation"], none["mix_alarm"]) == (0, False)
    assert MON.mix_distance(MON.mix_drift(base.limit(0), cur)).first()["total_variation"] == pytest.approx(0.5)


def test_sudden_changes_on_a_hot_key(spark):
    pdf = _hot_frame()
    late = pdf.date_of_payment >= "2024-03-01"
    pdf.loc[late & (pdf.recipient_id == "HOT"), "amount"] *= 3
    extra = pd.DataFrame({"record_id": [9001, 9002, 9003, 9004, 9005], "recipient_id": ["fresh", "flat", "flat", "flat", None],
                          "date_of_payment": pd.to_datetime(["2024-04-01", "2024-01-01", "2024-01-02", "2024-04-01", "2024-04-01"]),
                          "amount": [5.0, 7.0, 7.0, 900.0, 1.0], "nature": [None] * 5})
    pdf = pd.concat([pdf, extra], ignore_index=True)
    got = {r["recipient_id"]: r for r in D.sudden_changes(_spark_df(spark, pdf), "2024-03-01").collect()}
    rows = pdf.dropna(subset=["recipient_id", "amount"])
    daily = rows.groupby(["recipient_id", rows.date_of_payment.dt.date])["amount"].sum().round(2)
    since, seen = pd.Timestamp("2024-03-01").date(), 0
    for key, days in daily.groupby(level=0):
        xs = [(d, v) for (_, d), v in days.items()]
        before, after = [v for d, v in xs if d < since], [(d, v) for d, v in xs if d >= since]
        if not after:
            assert key not in got
            continue
        seen, r = seen + 1, got[key]
        assert (r["n_days"], r["base_days"]) == (len(after), len(before))
        if len(before) < 2 or statistics.stdev(before) == 0:
            assert r["up_max"] is None and r["down_max"] is None and r["up_since"] is None and r["down_since"] is None
            continue
        mean, sd, up, down, most, first = statistics.mean(before), statistics.stdev(before), 0.0, 0.0, [0.0, 0.0], [None, None]
        for d, v in after:
            up, down = max(0.0, up + (v - mean) / sd - 0.5), max(0.0, down - (v - mean) / sd - 0.5)
            for i, s in enumerate((up, down)):
                most[i] = max(most[i], s)
                if s > 5 and first[i] is None:
                    first[i] = d
        assert [r["up_max"], r["down_max"]] == pytest.approx(most, abs=1e-3) and [r["up_since"], r["down_since"]] == first, key
    assert seen == len(got) and got["HOT"]["up_since"] is not None and got["fresh"]["up_max"] is None and got["flat"]["up_max"] is None
    assert D.sudden_changes(_spark_df(spark, pdf.iloc[:0]), "2024-03-01").count() == 0
