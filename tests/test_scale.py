"""Steps that keep rows where they are, against the plain way."""

from pyspark.sql import functions as F

from ledgerlens.operators import features as D


def test_split_moves_no_rows_and_keeps_the_ranks(spark, monkeypatch):
    """The split is a comparison: same rows as the running count, no exchange."""
    df = spark.range(3000).select(F.concat(F.lit("r"), "id").alias("k"), (F.col("id") % 3).cast("string").alias("g")).repartition(7)
    for label in (None, "g"):
        for size in (0.2, 0.0, 1.0):
            got = D.exact_split(df, "k", size, 42, label)
            assert "Exchange range" not in got._jdf.queryExecution().executedPlan().toString()
            want = D._ranked_split(df, "k", size, 42, label, "is_train")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # copies of one key on both sides, and too many keys for the driver: by rank
    same = spark.range(10).select(F.lit("x").alias("k"))
    assert D.exact_split(same, "k", 0.3).agg(F.sum("is_train")).first()[0] == 7
    monkeypatch.setattr(D, "SPLIT_BUCKETS", 1)
    monkeypatch.setattr(D, "MOST_NEAR", 100)
    assert D.exact_split(df, "k", 0.2).agg(F.sum("is_train")).first()[0] == 2400


def test_history_of_hot_and_ordinary_recipients_agree(spark, monkeypatch):
    """Both ways give the same history; rows without recipient or date stay."""
    rows = [(i, None if i % 50 == 7 else i % 5 if i % 2 else 99, None if i % 40 == 3 else f"2024-01-{1 + i * 7 % 28:02d}", None if i % 11 == 0 else i * 1.5)
            for i in range(600)]
    df = spark.createDataFrame(rows, "record_id int, recipient_id int, d string, amount double").select(
        "record_id", "recipient_id", F.to_date("d").cast("timestamp").alias("date_of_payment"), "amount").repartition(5)

    def told(out):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in out.collect())
    want = told(D._history_by_day(df, "recipient_id", "date_of_payment", "amount"))
    assert len(want) == 600 and told(D.time_history(df)) == want
    monkeypatch.setattr(D, "HOT_ROWS", 0)
    monkeypatch.setattr(D, "HOT_SHARE", 0.3)
    assert D.hot_keys(df.where("recipient_id IS NOT NULL"), "recipient_id") == [99]
    assert told(D.time_history(df)) == want


def test_cleaned_payments_are_the_cleaned_view(spark, tmp_path):
    """Narrow build of the cleaned table against the cleaning of the whole view, with
    repeated and missing keys in every table."""
    from ledgerlens.operators import clean as C
    from ledgerlens.plans import flagship as P
    from ledgerlens.sources.tables import payments

    line = [(1, 1, 1, 1, 2.0, -5.0), (1, 1, 1, 1, 2.0, -5.0), (1, 2, 2, 2, 3.0, 7.0), (2, 1, 3, 1, None, 1.0), (3, 1, 1, 1, 1.0, 4.0),
            (None, 1, 1, 1, 1.0, 4.0), (4, None, None, 1, 1.0, 9.0), (4, 9, 1, 2, 1.0, 0.0), (9, 1, 1, 1, 1.0, 4.0), (5, 1, 1, 1, 1.0, 4.0)]
    spark.createDataFrame([(*r, 0.1, 0.2, "A" if r[0] != 2 else None, "F", None if r[0] == 5 else "1997-01-02") for r in line],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string, d string").withColumn(
        "l_shipdate", F.col("d").cast("timestamp_ntz")).drop("d").write.parquet(str(tmp_path / "lineitem.parquet"))
    tables = {"orders": ([(1, 1, "1-URGENT"), (1, 1, "1-URGENT"), (1, 2, "5-LOW"), (2, 3, None), (3, None, "x"), (4, 1, "y"), (5, 1, "z"), (None, 1, "n")],
                         "o_orderkey long, o_custkey long, o_orderpriority string"),
              "customer": ([(1, 1, "A"), (1, 2, "A"), (2, None, "B"), (2, None, "B"), (None, 1, "C")], "c_custkey long, c_nationkey int, c_mktsegment string"),
              "nation": ([(1, "france "), (2, "FRANCE"), (1, "PERU")], "n_nationkey int, n_name string"),
              "part": ([(1, "p"), (1, "p"), (1, "q"), (2, None)], "p_partkey long, p_type string"),
              "supplier": ([(1, "s"), (1, "t"), (1, "t"), (2, "u"), (3, None), (3, "v")], "s_suppkey long, s_name string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = P.with_record_id(P.cleaned_payments(spark, str(tmp_path)))
    want = C.drop_invalid(C.convert_types(payments(spark, str(tmp_path))), record_key="recipient_id").drop("payer_name", "form").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 20


def test_offsets_from_a_guess_are_exact(spark, monkeypatch):
    """The offset is read off one scan where the guessed bins hold it, and off a second
    where they do not; both are the quantile of all training scores."""
    import numpy as np
    import pandas as pd

    from ledgerlens.operators import forest as IF

    rng = np.random.default_rng(11)
    pdf = pd.DataFrame(rng.normal(size=(4000, 3)), columns=["a", "b", "c"])
    pdf["id"] = np.arange(len(pdf))
    df = spark.createDataFrame(pdf).repartition(4)
    store = IF.fit_forests(df, "id", ["a", "b", "c"], specs := [IF.ForestSpec(0, 12, 64)])
    raw = IF.raw_scores(df, "id", store, ["a", "b", "c"], specs[0]).toPandas()["raw_score_12"].to_numpy()
    conts, looks = [0.03, 0.05, 0.5], []
    monkeypatch.setattr(IF, "GUESS_ROWS", 1000)
    plain = IF._look
    monkeypatch.setattr(IF, "_look", lambda *a: looks.append(1) or plain(*a))
    around = IF._bins_around
    for scans in (1, 2):                                         # a fair guess, and one that misses
        looks.clear()
        if scans == 2:
            monkeypatch.setattr(IF, "_bins_around", lambda h, s, exact: around(h, s, exact) if exact else np.array([5]))
        slots = IF.evaluate_groups(df, [df.where("id < 900")], ["a", "b", "c"], store, [IF.Group(specs[0], 12, conts)])[0]
        assert len(looks) == scans
        for c, slot in zip(conts, slots):
            o = np.quantile(raw, c)
            assert abs(slot.offset - o) < 1e-12 and slot.normal[0].n + slot.anomaly[0].n == 900
