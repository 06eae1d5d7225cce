"""Toxicity: features and weights by hand, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from ledgerlens.llm import toxicity as tox
from ledgerlens.llm.queries import QUERIES

from .conftest import SF, docs_frame

BIG = "/root/testdata/sf0.1"


def grams(text):
    t = f" {' '.join(text.lower().split())} "
    return {t[i:i + n] for n in range(tox.SHORTEST, tox.LONGEST + 1) for i in range(len(t) - n + 1)} if text.split() else set()


def test_features_are_the_ngrams(monkeypatch):
    for text in ("A  bad\tday", "x", "Ünï cödé 😀 ok", "abc " * 40):
        assert len(tox.distinct_features(text)) == len(grams(text))
    assert not len(tox.distinct_features(None)) and not len(tox.distinct_features(" \n"))
    text = "some words over and over, with a border in between " * 9
    want = tox.distinct_features(text)
    monkeypatch.setattr(tox, "WINDOW", 16)
    assert (tox.distinct_features(text) == want).all()


def test_ratios_and_score_by_hand(llm):
    good = ["a fine day to walk", "the river runs to the sea", "a fine river", "walk to the sea"] * 3
    bad = ["you rotten fool", "a rotten day", "rotten to the core", "what a rotten river"] * 3
    rows = [(i, t) for i, t in enumerate(good + bad)]
    labels = llm.createDataFrame([(i, int(i >= len(good)), "x") for i, _ in rows], "doc_id long, toxic int, text string")
    docs = docs_frame(llm, rows)
    model = tox.train(docs, labels, min_texts=2, min_z=1.0)
    used = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    n1 = sum(i >= len(good) for i in used)
    n0 = len(used) - n1
    c1 = sum("rotten" in rows[i][1] for i in used if i >= len(good))
    place = model.place[tox.distinct_features("rotten")]
    want = np.log((c1 + 1) / (n1 + 2)) - np.log(1 / (n0 + 2))
    inner = [p for p in place if p >= 0]
    assert inner and np.isclose(model.ratio[inner], want).any()
    own = model.own("a rotten sea")
    x = model.ratio[own] / np.linalg.norm(model.ratio[own])
    assert model.score("a rotten sea") == pytest.approx(1 / (1 + np.exp(-(x @ model.weight[own] + model.bias))))
    assert model.score("rotten fool") > 0.5 > model.score("walk to the river")


def test_regression_is_at_its_optimum():
    rng = np.random.default_rng(3)
    ratio = rng.normal(size=6)
    rows = [(int(rng.random() < 0.4), np.sort(rng.choice(6, 3, replace=False))) for _ in range(60)]
    w, b = tox._regress(rows, ratio, (1.0, 2.0), steps=4000)

    def loss(w, b):
        out = 0.05 * (w ** 2).sum()
        for y, x in rows:
            v = ratio[x] / np.linalg.norm(ratio[x])
            z = v @ w[x] + b
            out += (2.0 if y else 1.0) * (np.logaddexp(0, z) - y * z)
        return out
    best = loss(w, b)
    for i in range(7):
        for d in (-1e-2, 1e-2):
            step = np.eye(7)[i] * d
            assert loss(w + step[:6], b + step[6]) >= best - 1e-6


def test_odd_rows(llm):
    labels = llm.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    docs = docs_frame(llm, [(1, "vile " * 3), (1, "vile"), (2, "kind"), (None, None), (3, ""), (3, ""), (4, " \n")])
    out = tox.score_toxicity(docs, tox.train(docs, labels, min_texts=1, min_z=0.0)).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert len({r.score for r in out if r.doc_id in (None, 3, 4)}) == 1
    none = tox.train(docs.limit(0), labels.limit(0))
    assert {r.score for r in tox.score_toxicity(docs, none).collect()} == {0.5}
    assert tox.score_toxicity(docs.limit(0), none).collect() == []
    long = docs_frame(llm, [(9, "word " * 300_000 + "vile")])
    assert tox.score_toxicity(long, none).count() == 1


def test_held_out_accuracy(llm):
    """Never seen labels: at least 0.97 by rank, few clean documents marked."""
    out = QUERIES["op11_toxicity"](llm, BIG).toPandas().set_index("doc_id")
    assert len(out) == pq.read_metadata(f"{BIG}/documents.parquet").num_rows
    label = pq.read_table(f"{BIG}/labels.parquet").to_pandas().set_index("doc_id")["toxic"]
    held = [i for i in label.index if zlib.crc32(str(i).encode()) % 4 == 2]
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.index]).all()
    y, s, p = label[held].to_numpy(), out.loc[held, "score"], out.loc[held, "predicted"].to_numpy()
    rank = s.rank().to_numpy()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    print("auc", auc, "recall", p[y == 1].mean(), "false", p[y == 0].mean())
    assert auc > 0.97 and p[y == 1].mean() > 0.85 and p[y == 0].mean() < 0.01


def test_small_table(llm):
    assert QUERIES["op11_toxicity"](llm, SF).count() == 1000
