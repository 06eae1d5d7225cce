"""Nearest neighbours and the local outlier factor against all pairs."""

import numpy as np
import pytest

from ledgerlens.operators import density
from ledgerlens.operators.density import CutTree, local_density


def _brute(x, k):
    d = np.zeros((len(x), len(x)))
    for i in range(x.shape[1]):
        d += (x[:, i, None] - x[None, :, i]) ** 2
    d = np.sqrt(d)
    near = []
    for i in range(len(x)):
        others = [j for j in range(len(x)) if j != i]
        near.append(sorted(others, key=lambda j: (d[i, j], *x[j]))[:k])
    kd = np.array([d[i, n[-1]] for i, n in enumerate(near)])
    lrd = np.array([1 / (np.mean([max(kd[j], d[i, j]) for j in n]) + 1e-10) for i, n in enumerate(near)])
    return kd, np.array([lrd[n].mean() / lrd[i] for i, n in enumerate(near)])


@pytest.mark.parametrize("leaf,visits", [(8, 40), (64, 8192), (4096, 8192)])
def test_equals_all_pairs(spark, monkeypatch, leaf, visits):
    monkeypatch.setattr(density, "VISITS", visits)
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(0, 1, (150, 2)), r.normal(30, 0.1, (60, 2)), np.tile([[5.0, 5.0]], (100, 1)),    # a third in one place
                        r.integers(0, 4, (40, 2)).astype(float), [[200.0, -200.0], [-0.0, 0.0]]])
    kd, lof = _brute(x, 7)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, a double, b double").repartition(5)
    got = {row["id"]: row for row in local_density(df, ["a", "b"], 7, leaf).collect()}
    assert len(got) == len(x)
    assert [got[i]["k_distance"] for i in range(len(x))] == pytest.approx(list(kd))
    assert [got[i]["lof"] for i in range(len(x))] == pytest.approx(list(lof))
    assert got[350]["lof"] > 10


def test_odd_tables(spark):
    schema = "id long, a double, x string"
    rows = [(1, 1.0, "p"), (2, None, "q"), (3, float("nan"), None), (4, 2.0, "p"), (5, 4.0, "p")]
    got = {r["id"]: r for r in local_density(spark.createDataFrame(rows, schema), ["a"], 5).collect()}
    assert got[2]["lof"] is None and got[3]["k_distance"] is None and got[1]["x"] == "p"
    kd, lof = _brute(np.array([[1.0], [2.0], [4.0]]), 5)                     # fewer than k others: all of them
    assert [got[i]["lof"] for i in (1, 4, 5)] == pytest.approx(list(lof)) and got[1]["k_distance"] == kd[0]
    assert local_density(spark.createDataFrame(rows[:1], schema), ["a"]).first()["lof"] is None
    assert local_density(spark.createDataFrame([], schema), ["a"]).count() == 0


def test_balls_touch_every_leaf_they_reach():
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 3))
    tree = CutTree(x[::4], 4)
    leaf, radius = tree.leaf(x), r.uniform(0, 1.5, len(x))
    touched = {(int(i), at) for at, rows in tree.touched(x, radius) for i in rows}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert all((i, leaf[j]) in touched for i in range(len(x)) for j in range(len(x)) if d[i, j] <= radius[i])
    assert len(touched) < len(x) * tree.leaves
