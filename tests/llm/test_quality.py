"""The line field: marginals against enumeration, held-out accuracy, edges."""

import itertools
import zlib

import numpy as np
import pyarrow.parquet as pq

from ledgerlens.llm.common import table
from ledgerlens.llm.quality import (BINS, STATS, Field, fit_field, forward_backward, keep_good, line_stats, score_quality,
                                    score_texts, train, unary)
from ledgerlens.llm.queries import QUERIES

from .conftest import docs_frame

SF = "/root/testdata/sf0.1"


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    field = Field(rng.normal(size=(3, STATS, BINS)) * 0.3, rng.normal(size=2), 0.1, rng.normal(size=(2, 2)))
    sizes = np.array([4, 1, 6, 2])
    starts = np.cumsum(sizes) - sizes
    bins = np.stack([rng.integers(0, 3, STATS) for _ in range(sizes.sum())]).astype(np.int8)
    u = unary(field, bins, starts)
    good, pairs, z = forward_backward(u, field.trans, starts, sizes)
    want_pairs, want_z, cols = np.zeros((2, 2)), 0.0, np.arange(STATS)
    for s, n in zip(starts, sizes):
        ux = []
        for t in range(n):
            x = field.bias + field.tables[0][cols, bins[s + t]].sum()
            x += field.tables[1][cols, bins[s + t - 1]].sum() if t else field.edge[0]
            x += field.tables[2][cols, bins[s + t + 1]].sum() if t < n - 1 else field.edge[1]
            ux.append(x)
        assert np.allclose(ux, u[s:s + n])
        total, marg, pr = 0.0, np.zeros(n), np.zeros((2, 2))
        for ys in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(x * y for x, y in zip(ux, ys)) + sum(field.trans[a, b] for a, b in zip(ys, ys[1:])))
            total += w
            marg += w * np.array(ys)
            for a, b in zip(ys, ys[1:]):
                pr[a, b] += w
        assert np.allclose(good[s:s + n], marg / total)
        want_pairs += pr / total
        want_z += np.log(total)
    assert np.allclose(pairs, want_pairs) and np.isclose(z, want_z)


def test_held_out_accuracy(llm):
    got = {r["doc_id"]: r for r in QUERIES["op2_quality_crf"](llm, SF).collect()}
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id"])["doc_id"].to_pylist()
    assert len(got) == len(docs)
    right = []
    for r in pq.read_table(f"{SF}/labels.parquet").to_pylist():
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= g["score"] <= 1
        assert g["predicted"] == int(g["score"] >= 0.3)
        if g["held_out"]:
            right.append((r["quality"], g["predicted"], g["score"]))
    assert sum(y == p for y, p, _ in right) >= 0.99 * len(right)
    low = [s for y, _, s in right if y == 0]
    high = [s for y, _, s in right if y == 1]
    assert np.mean([a < b for a in low for b in high]) > 0.995


def test_labels_of_the_held_out_fold_are_not_used(llm):
    docs, labels = table(llm, SF.replace("0.1", "0.01"), "documents"), table(llm, SF.replace("0.1", "0.01"), "labels")
    a = train(docs, labels)
    from pyspark.sql import functions as F

    from ledgerlens.llm.quality import held_out
    b = train(docs, labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert np.array_equal(a.tables, b.tables) and np.array_equal(a.trans, b.trans)


def test_rows_and_edges(llm):
    rows = [(1, None), (1, ""), (2, "\n \n"), (None, "Plain words here, and more.\nA second line."), (3, "x " * 60_000)]
    field = train(docs_frame(llm, rows), llm.createDataFrame([], "doc_id long, quality int"))
    got = score_quality(docs_frame(llm, rows), field, carry=("run", "keep")).collect()
    assert len(got) == 5 and sorted(r["score"] for r in got) == [0, 0, 0, 0.5, 0.5]
    assert score_quality(docs_frame(llm, []), field).count() == 0
    kept = keep_good(docs_frame(llm, rows), field)
    assert kept.columns == docs_frame(llm, rows).columns and kept.count() == 2
    assert [len(line_stats(t)[0]) for _, t in rows] == [0, 0, 0, 2, 1]
    junk, fine = "AB!! CD!! EF!!\nGH!! IJ!!", "Some plain text, of words.\nAnother line, too."
    field = fit_field([(line_stats(junk)[0], 0), (line_stats(fine)[0], 1)] * 5)
    (bad, good), _ = score_texts(field, [junk, fine])
    assert bad < 0.1 and good > 0.9
