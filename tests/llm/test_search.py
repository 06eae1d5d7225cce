"""Best-position search against the SQL and brute force."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from ledgerlens.llm import search as se
from ledgerlens.llm.queries import ORACLES, QUERIES

from .conftest import SF, docs_frame

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(TERM, (text or "").translate(LOWER))


def brute(docs, queries, k):
    words = [terms(t) for _, t in docs]
    n_docs, n_words = sum(bool(w) for w in words), sum(map(len, words))
    tfs = [Counter(w) for w in words]
    df = Counter(t for c in tfs for t in c)
    out = []
    for qid, text in queries:
        found = []
        for i, (doc_id, _) in enumerate(docs):
            m = 25 + 75 * len(words[i]) * n_docs // max(n_words, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tfs[i][t] // (1000 * tfs[i][t] + 8 * m))
                        for t in terms(text) if tfs[i][t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        found.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(qid, rank, d, -s) for rank, (s, _, d) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def queries_frame(spark, rows):
    return spark.createDataFrame([(i, t, 5, 1) for i, t in rows], "item_id long, text string, score int, doc_id int")


def collect(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture
def corpus():
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(60)]
    p = 1 / np.arange(1, 61)
    p /= p.sum()
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 60), p=p))) for i in range(300)]
    docs += [(1000 + i, "w3 w3 w50 same text") for i in range(150)]           # a third of the rows are copies: ties
    docs += [(7, "w1 W2 again"), (None, "w59 w58 W57"), (2000, None), (2001, ""), (2002, "!? .,"), (5, "w5 " * 3000), (2003, "Éte été ÉTÉ w9_w9-w8")]
    asked = [(0, "w1 w50 w59"), (1, "W3"), (2, None), (3, "unknown words"), (4, "w59 w58 w57 w57 w57"), (4, "été w9"), (5, " ".join(words)),
             (None, "same"), (6, "")]
    return docs, asked


@pytest.mark.parametrize("shard,block,step", [(1 << 16, 512, 16), (20, 2, 1), (64, 3, 4)])
def test_brute_force(llm, corpus, monkeypatch, shard, block, step):
    docs, asked = corpus
    monkeypatch.setattr(se, "SHARD_DOCS", shard)
    monkeypatch.setattr(se, "BLOCK_QUERIES", block)
    monkeypatch.setattr(se, "FIRST_STEP", step)
    got = collect(se.search(docs_frame(llm, docs, 4), queries_frame(llm, asked), 10))
    assert got == brute(docs, asked, 10)


def test_empty_tables(llm, corpus):
    docs, asked = corpus
    assert collect(se.search(docs_frame(llm, docs).limit(0), queries_frame(llm, asked))) == []
    none = se.search(docs_frame(llm, docs[:5]), queries_frame(llm, asked).limit(0))
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.collect() == []


def shard_of(rows, n_terms, n=None):
    """A shard from (term, tf) lists, documents of equal length."""
    sizes = np.array([len(r) for r in rows])
    term = np.array([t for r in rows for t, _ in sorted(r)], np.int32)
    tf = np.array([f for r in rows for _, f in sorted(r)], np.int64)
    return se.Shard.build(sizes, term, tf, np.full(len(rows), 10) if n is None else n, len(rows), 10 * len(rows), n_terms)


def test_stops_early_and_not_at_equality():
    rows = [[(0, 50 - i // 20), (1, 1 + i % 3)] for i in range(1000)]
    shard, order = shard_of(rows, 2), np.arange(1000)
    docs, scores, looked = se.best_positions(shard, np.array([0, 1]), np.array([900, 10]), 5, order)
    full = 900 * shard.impact[0::2] + 10 * shard.impact[1::2]
    want = np.lexsort((order, -full))[:5]
    assert docs.tolist() == want.tolist() and scores.tolist() == full[want].tolist() and looked < 300
    same = shard_of([[(0, 1)]] * 400, 1)                         # all equal: the smallest in order must be found
    backwards = np.arange(400)[::-1].copy()
    docs, _, looked = se.best_positions(same, np.array([0]), np.array([5]), 3, backwards)
    assert docs.tolist() == [399, 398, 397] and looked == 400


def test_very_long_documents_do_not_overflow():
    n = np.array([10**13, 10, 10])
    shard = se.Shard.build(np.array([1, 1, 1]), np.zeros(3, np.int32), np.array([10**6, 1, 1]), n, 10**6, 10**13, 1)
    assert shard.impact.tolist()[0] == 10**9 * 10**6 // (1000 * 10**6 + 8 * (25 + 75 * 10**6))


def test_query_against_sql(llm):
    got = collect(QUERIES["op12_lexical_search"](llm, SF))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({ORACLES['op12_lexical_search']})").fetchall()
    assert got == sorted(want, key=str) and len(got) > 300
