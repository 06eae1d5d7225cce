"""Stupid-backoff scores against a plain-Python version and the SQL."""

import collections
import math

import duckdb
import numpy as np
import pytest

from ledgerlens.llm.lm_score import _pack, _pack_sorted, _unpack, _unpack_sorted, lm_scores
from ledgerlens.llm.queries import ORACLES, QUERIES

from .conftest import SF, docs_frame


def by_hand(texts, order=3):
    docs = [(t or "").encode().split() for t in texts]
    grams = lambda w: collections.Counter(tuple(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    own = [grams(w) for w in docs]
    total = sum(own, collections.Counter())
    n_all = sum(map(len, docs))
    out = []
    for w, mine in zip(docs, own):
        c = lambda g: total[g] - mine[g]  # noqa: E731, B023
        n, logs = n_all - len(w), 0.0
        for i in range(len(w)):
            for k, o in enumerate(range(min(order, i + 1), 0, -1)):
                g = tuple(w[i - o + 1:i + 1])
                if c(g) > 0:
                    logs += math.log10(0.4 ** k * c(g) / (c(g[:-1]) if o > 1 else n))
                    break
            else:
                logs += math.log10(0.4 ** min(order - 1, i) / (n + 1))
        out.append((len(w), logs))
    return out


def same(got, texts, order=3):
    for r, (n, logs) in zip(got, by_hand(texts, order)):
        assert r["n_words"] == n and r["log10_sum"] == pytest.approx(logs, abs=2e-4 + 1e-9 * abs(logs))
        assert r["score"] is None if n == 0 else r["score"] == pytest.approx(logs / n, abs=1e-4)


def test_query_against_sql(llm):
    got = {r["doc_id"]: r.asDict() for r in QUERIES["op9_lm_scores"](llm, SF).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLES["op9_lm_scores"]).fetchall()
    assert len(want) == len(got)
    assert {r[0]: r[1:] for r in want} == {i: (r["n_words"], r["log10_sum"], r["score"]) for i, r in got.items()}


def test_small_chunks_against_hand(llm, documents):
    texts = [d["text"] for d in documents[:60]] + [None, "", "one", "a b a b", "a b a b", "zz " * 5000, "a b zz"]
    rows = list(enumerate(texts))
    for order, words in ((3, 40), (2, 10**6), (1, 500)):
        got = lm_scores(docs_frame(llm, rows, 5), order=order, chunk_words=words).collect()
        same(sorted(got, key=lambda r: r["doc_id"]), texts, order)


def test_rows_and_packing(llm):
    got = lm_scores(docs_frame(llm, [(None, "x y"), (1, "x y"), (1, "x y"), (2, None)])).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "2", "None"] and lm_scores(docs_frame(llm, [])).count() == 0
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert np.array_equal(_unpack_sorted(_pack_sorted(keys)), keys)
    for x in ([], [1, 2, 2**32 + 5], [7] * 10):
        assert _unpack(_pack(np.array(x, np.int64))).tolist() == x
