import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import forest as IF


def _outliers(spark, n=1000, k=10, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    far = rng.normal(size=(k, 3)) * 0.5 + 8.0
    pdf = pd.DataFrame(np.vstack([x, far]), columns=["a", "b", "c"])
    pdf["id"] = np.arange(len(pdf))
    return pdf, spark.createDataFrame(pdf)


def test_planted_outliers_rank_top(spark):
    pdf, df = _outliers(spark)
    m = IF.fit(df, "id", ["a", "b", "c"], n_trees=100, contamination=0.01)
    s = IF.score(m, df, "id").toPandas()
    top = set(s.sort_values("raw_score").head(10)["id"])
    assert top == set(range(1000, 1010))
    assert 0.005 <= s["is_anomaly"].mean() <= 0.02
    assert m.offset == pytest.approx(np.quantile(s["raw_score"], 0.01), rel=1e-12)


def test_packed_walk_matches_the_node_table(spark):
    """Every row down every tree of the unpacked node table, node by node."""
    pdf, df = _outliers(spark, n=300, k=3, seed=1)
    m = IF.fit(df, "id", ["a", "b", "c"], n_trees=20)
    nodes = {k: g.set_index("node") for k, g in m.nodes.toPandas().groupby("tree")}
    x = pdf[["a", "b", "c"]].to_numpy()
    counts = [1, 7, 20]
    fast = IF.walk(x, IF.packed(m.store, m.spec, 20), counts)
    for i in range(0, len(x), 37):
        paths = []
        for t in range(20):
            n = nodes[t]
            node = 0
            while n.at[node, "feature"] >= 0:
                node = n.at[node, "left"] if x[i, n.at[node, "feature"]] <= n.at[node, "threshold"] else n.at[node, "right"]
            paths.append(n.at[node, "path"])
        assert fast[i] == pytest.approx([sum(paths[:k]) for k in counts], rel=1e-12)


def test_trees_are_isolation_trees(spark):
    """Sizes add up, splits lie inside the node's range, leaves carry depth + c(n)."""
    rng = np.random.default_rng(7)
    for x in (rng.normal(size=(64, 4)), np.repeat(rng.normal(size=(4, 4)), 16, axis=0), np.zeros((32, 4)), rng.normal(size=(1, 4)),
              np.nextafter(1.0, [[1], [2], [1], [2]] * np.ones((4, 4)))):
        depth = IF.ForestSpec(0, 1, len(x)).resolve(len(x)).depth
        feature, threshold, path, sizes = IF.grow(x, np.random.default_rng(1), np.array([0, 2, 3]), depth)
        rows = {0: np.arange(len(x))}
        for at in range(len(sizes)):
            mine = rows.get(at, np.zeros(0, int))
            assert sizes[at] == len(mine)
            level = int(math.log2(at + 1))
            if at < len(feature) and feature[at] >= 0:
                v = x[mine, feature[at]]
                assert v.min() <= threshold[at] < v.max() and feature[at] in (0, 2, 3) and len(mine) > 1
                rows[2 * at + 1], rows[2 * at + 2] = mine[v <= threshold[at]], mine[v > threshold[at]]
            elif len(mine):
                assert level == depth or len(mine) == 1 or (x[mine][:, [0, 2, 3]] == x[mine[0], [0, 2, 3]]).all()
                first = ((at + 1) << (depth - level)) - (1 << depth)
                want = level + IF.average_path_length([len(mine)])[0]
                assert (path[first:first + (1 << (depth - level))] == want).all()


def test_same_seed_same_nodes_whatever_the_way_rows_travel(spark, monkeypatch):
    _, df = _outliers(spark, n=500, k=5, seed=2)
    df = df.repartition(5, "id")
    specs = lambda: [IF.ForestSpec(0, 10), IF.ForestSpec(1, 6, 64, 0.7, True)]

    def nodes():
        return IF.unpack_nodes(IF.fit_forests(df, "id", ["a", "b", "c"], specs())).orderBy("forest", "tree", "node").toPandas()
    a = nodes()
    pd.testing.assert_frame_equal(a, nodes())
    monkeypatch.setattr(IF, "SHIP_BYTES", 0)                     # rows shuffled by tree instead of broadcast
    pd.testing.assert_frame_equal(a, nodes())
    monkeypatch.setattr(IF, "PASS_DRAWS", 2600)                  # a pass for each forest
    pd.testing.assert_frame_equal(a, nodes())
    assert a.groupby(["forest", "tree"])["n_samples"].first().groupby("forest").max().tolist() == [256, 64]


def test_fit_never_exchanges_the_feature_matrix(spark):
    _, df = _outliers(spark, n=500, k=5, seed=2)
    written = IF.cut_lineage(df.select("a", "b", "c"))
    files, base = IF._numbered_files(written)
    plan = IF._drawn(written, ["a", "b", "c"], np.arange(3), files, base)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_drawn_rows_are_the_numbered_rows(spark):
    pdf, df = _outliers(spark, n=300, k=3, seed=4)
    written = IF.cut_lineage(df.repartition(6).select("a", "b", "c"))
    files, base = IF._numbered_files(written)
    assert base[-1] == 303 and len(files) == 6
    got = IF._drawn(written, ["a", "b", "c"], np.arange(303), files, base).toPandas().sort_values("number")
    assert got["number"].tolist() == list(range(303))
    rows = {tuple(np.frombuffer(x, "<f8")) for x in got["x"]}
    assert rows == {tuple(r) for r in pdf[["a", "b", "c"]].to_numpy()}
    few = IF._drawn(written, ["a", "b", "c"], np.array([5, 17, 300]), files, base).toPandas().set_index("number")["x"]
    whole = got.set_index("number")["x"]
    assert sorted(few.index) == [5, 17, 300] and all(few[i] == whole[i] for i in few.index)


def test_stability_matches_numpy(spark):
    _, df = _outliers(spark, n=400, k=6, seed=5)
    df = df.withColumn("is_train", (F.col("id") % 4 != 0).cast("int"))
    m = IF.fit(df.where("is_train = 1"), "id", ["a", "b", "c"], n_trees=30, contamination=0.05)
    raw = IF.raw_scores(df, "id", m.store, m.features, m.spec, [10, 30], ["is_train"]).toPandas()
    for r in IF.stability(m, df, "id", (10, 30, 200)).collect():
        off = np.quantile(raw.loc[raw.is_train == 1, f"raw_score_{r.n_trees}"], 0.05)
        d = raw.loc[raw.is_train == r.is_train, f"raw_score_{r.n_trees}"] - off
        assert (r.n_rows, r.n_flagged) == (len(d), (d < 0).sum())
        assert (r.mean_score, r.std_score) == (pytest.approx(d.mean(), rel=1e-9), pytest.approx(d.std(ddof=0), rel=1e-9))


def test_offsets_with_ties_and_wide_gaps(spark):
    """Scores with many ties, and positions that fall between two far values."""
    pdf = pd.DataFrame({"a": [0.0] * 50 + [1.0] * 45 + [9.0] * 5, "b": 0.0, "id": range(100)})
    df = spark.createDataFrame(pdf).repartition(3)
    store = IF.fit_forests(df, "id", ["a", "b"], specs := [IF.ForestSpec(0, 15, 32)])
    conts = [0.01, 0.049, 0.05, 0.0499, 0.495, 0.5, 0.93]
    raw = IF.raw_scores(df, "id", store, ["a", "b"], specs[0]).toPandas()["raw_score_15"].to_numpy()
    for c, slot in zip(conts, IF.evaluate_groups(df, [df], ["a", "b"], store, [IF.Group(specs[0], 15, conts)])[0]):
        o = np.quantile(raw, c)
        assert slot.offset == pytest.approx(o, rel=1e-12)
        d = raw - slot.offset
        assert (slot.normal[0].n, slot.anomaly[0].n) == ((d >= 0).sum(), (d < 0).sum())
        if slot.anomaly[0].n:
            assert slot.anomaly[0].mean == pytest.approx(d[d < 0].mean(), rel=1e-9, abs=1e-12)


def test_average_path_length():
    c = IF.average_path_length([1, 2, 256])
    assert c[0] == 0 and c[1] == 1.0
    assert abs(c[2] - (2 * (np.log(255) + IF.EULER_GAMMA) - 2 * 255 / 256)) < 1e-12


def _fkey(c):
    return (c["max_samples"], float(c["max_features"]), bool(c["bootstrap"]))


@pytest.mark.parametrize("store_bytes", [1 << 28, 60_000])
def test_search_matches_brute_force(spark, monkeypatch, store_bytes):
    monkeypatch.setattr(IF, "STORE_BYTES", store_bytes)          # all forests in one pass, or one a pass
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    x[:12] += 6.0
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["k"] = [f"r{i:04d}" for i in range(len(pdf))]
    df = spark.createDataFrame(pdf).repartition(4)
    cols = ["a", "b", "c"]
    tr, va = df.where(F.col("k") < "r0400"), df.where(F.col("k") >= "r0400")
    cands = [dict(candidate=0, n_estimators=20, contamination=0.05, max_samples=64, max_features=1.0, bootstrap=False),
             dict(candidate=1, n_estimators=10, contamination=0.10, max_samples=64, max_features=1.0, bootstrap=False),
             dict(candidate=2, n_estimators=15, contamination=0.08, max_samples=128, max_features=0.67, bootstrap=True),
             dict(candidate=3, n_estimators=20, contamination=0.08, max_samples=64, max_features=1.0, bootstrap=False)]
    got = {r["candidate"]: r for r in IF.search(tr, va, "k", cols, cands, min_group=3).collect()}
    # the same seeded forests, scored and judged row by row in NumPy
    fkeys = sorted({_fkey(c) for c in cands}, key=str)
    specs = [IF.ForestSpec(i, max(c["n_estimators"] for c in cands if _fkey(c) == fk), fk[0], fk[1], fk[2], 42)
             for i, fk in enumerate(fkeys)]
    nodes = IF.fit_forests(tr, "k", cols, specs)
    for c in cands:
        spec, k = specs[fkeys.index(_fkey(c))], c["n_estimators"]
        raw_tr = IF.raw_scores(tr, "k", nodes, cols, spec, [k]).toPandas()[f"raw_score_{k}"].to_numpy()
        raw_va = IF.raw_scores(va, "k", nodes, cols, spec, [k]).toPandas()[f"raw_score_{k}"].to_numpy()
        d = raw_va - np.quantile(raw_tr, c["contamination"])
        normal, anomal = d[d >= 0], d[d < 0]
        assert got[c["candidate"]]["flagged_rate"] == pytest.approx(len(anomal) / len(d))
        assert got[c["candidate"]]["fit_seconds"] > 0
        pooled = np.sqrt((normal.std() ** 2 + anomal.std() ** 2) / 2)
        if len(normal) >= 3 and len(anomal) >= 3 and pooled >= 1e-6:
            sep = (normal.mean() - anomal.mean()) / pooled - 2 * abs(len(anomal) / len(d) - c["contamination"])
            assert got[c["candidate"]]["score"] == pytest.approx(sep, rel=1e-9)
        else:
            assert got[c["candidate"]]["score"] == float("-inf")


def test_judged_table_may_be_empty(spark):
    _, df = _outliers(spark, n=200, k=2, seed=6)
    cands = [dict(candidate=0, n_estimators=5, contamination=0.1, max_samples=32, max_features=1.0, bootstrap=False)]
    row = IF.search(df, df.limit(0), "id", ["a", "b", "c"], cands).first()
    assert row["score"] == float("-inf") and row["flagged_rate"] is None


def _one_by_one(x, forest, counts):
    """Every row alone down every tree of a packed forest."""
    depth, feature, threshold, path = forest
    out = np.zeros((len(x), len(counts)))
    for r, row in enumerate(x):
        total = 0.0
        for t in range(counts[-1]):
            at = 0
            for _ in range(depth):
                at = 2 * at + (1 if row[max(feature[t, at], 0)] <= threshold[t, at] else 2)
            total += path[t, at - feature.shape[1]]
            if t + 1 in counts:
                out[r, counts.index(t + 1)] = total
    return out


def test_walk_by_places_is_exact(monkeypatch):
    """Ties, NaN, infinities, several chunks, trees deeper and shallower than their masks."""
    rng = np.random.default_rng(3)
    for psi, d in ((1, 2), (2, 3), (9, 3), (300, 5), (2048, 4)):
        x = rng.normal(size=(2100, d)).round(1)
        spec = IF.ForestSpec(0, 4, psi).resolve(len(x))
        trees = [IF.grow(x[IF.draw_rows(spec, t, len(x))], np.random.default_rng(t), np.arange(d), spec.depth) for t in range(4)]
        forest = (spec.depth, *[np.stack([t[i] for t in trees]) for i in range(3)])
        odd = np.vstack([x[:40], np.full((1, d), np.nan), np.full((1, d), np.inf), np.full((1, d), -np.inf), np.where(x[:9] > 0, np.nan, x[:9])])
        for chunk, masks, lookup in ((IF.CHUNK, IF.MASKS, IF.LOOKUP), (7, 1, 3), (16, 64, 5)):
            monkeypatch.setattr(IF, "CHUNK", chunk)
            monkeypatch.setattr(IF, "MASKS", masks)
            monkeypatch.setattr(IF, "LOOKUP", lookup)
            for rows in (odd, odd[:1], odd[:0]):
                assert np.array_equal(IF.walk(rows, forest, [1, 4]), _one_by_one(rows, forest, [1, 4]))
        monkeypatch.undo()


def test_rows_are_ordered_once_for_all_forests(spark, monkeypatch):
    """A pass over several forests sorts its rows once, in batches larger than Arrow's."""
    import pyarrow as pa

    pdf, df = _outliers(spark, n=200, k=2)
    specs = [IF.ForestSpec(f, 3, 16) for f in range(3)]
    store = IF.fit_forests(df, "id", ["a", "b", "c"], specs)
    (_, _, scores), = IF._group_scores(store, [IF.Group(s, 3, [0.1]) for s in specs])
    calls, plain = [], IF.ordered
    monkeypatch.setattr(IF, "ordered", lambda x: calls.append(len(x)) or plain(x))
    x = pdf[["a", "b", "c"]].to_numpy()
    assert scores(x).shape == (202, 3) and calls == [202]
    small = [pa.record_batch({"v": list(range(i, i + 5))}) for i in range(0, 50, 5)]
    monkeypatch.setattr(IF, "CHUNK", 20)
    merged = list(IF._batched(iter(small)))
    assert [len(b) for b in merged] == [20, 20, 10] and sum((b["v"].to_pylist() for b in merged), []) == list(range(50))


def test_large_tables_number_hashes_and_write_no_features(spark, monkeypatch):
    """More rows than draws, drawn from most hash ranges: the same trees as from the
    ranked ranges, keys and hashes that repeat included, and no feature is written."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(size=(1500, 3)), columns=["a", "b", "c"])
    pdf["id"] = np.arange(1500) % 1100                           # 400 keys come twice
    pdf.loc[:20, "id"], pdf.loc[1490:, ["a", "b", "c"]] = np.nan, pdf.loc[390:399, ["a", "b", "c"]].to_numpy()
    df = spark.createDataFrame(pdf).repartition(5)
    specs = lambda: [IF.ForestSpec(0, 8, 64), IF.ForestSpec(1, 6, 64, 0.7, True)]

    def nodes():
        return IF.unpack_nodes(IF.fit_forests(df, "id", ["a", "b", "c"], specs())).orderBy("forest", "tree", "node").toPandas()

    monkeypatch.setattr(IF, "DENSE", 1.0)
    ranked = nodes()
    written, plain = [], IF.cut_lineage
    monkeypatch.setattr(IF, "cut_lineage", lambda t: written.append(t.columns) or plain(t))
    monkeypatch.setattr(IF, "DENSE", 0.0)
    pd.testing.assert_frame_equal(ranked, nodes())
    assert written == [["_h", "_first", "_c"], IF.STORE_SCHEMA.fieldNames()]
    monkeypatch.setattr(IF, "SHIP_BYTES", 0)
    monkeypatch.setattr(IF, "PASS_DRAWS", 600)
    pd.testing.assert_frame_equal(ranked, nodes())
