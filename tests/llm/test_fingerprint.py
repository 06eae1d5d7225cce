"""Bottom-k sketches against brute force."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm.fingerprint import containment, distinct_shingles, fingerprint_neighbours, merge, resemblance, sketch
from ledgerlens.llm.queries import QUERIES

from .conftest import SF, docs_frame


def shingles(t):
    w = (t or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edit(a, b):
    h = len(a) // 2
    return a[:len(a) - h] + b[:h]


def test_query_against_brute_force(llm, documents):
    got = {r["doc_id"]: r for r in QUERIES["op6_fingerprints"](llm, SF).collect()}
    docs = sorted(documents, key=lambda d: d["doc_id"])
    assert len(got) == len(docs)
    off, prints = [], {}
    for d, nxt in zip(docs, docs[1:] + docs[:1]):
        t, u, r = d["text"] or "", nxt["text"] or "", got[d["doc_id"]]
        e = edit(t, u)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        off += [abs(r["near_edited"] - jaccard(t, e)), abs(r["near_next"] - jaccard(t, u))]
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        n = len(shingles(t))
        assert len(base64.b64decode(r["fingerprint"])) == 8 * min(n, 128)
        assert r["distinct_shingles"] == n if n < 128 else abs(r["distinct_shingles"] / n - 1) < 0.5
    assert max(off) < 0.25 and sum(off) / len(off) < 0.02


def test_merge_and_estimates(llm):
    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    df = llm.createDataFrame([(a, b, " ".join(words[:2004]), "", None)], "a string, b string, ab string, e string, z string")
    s = {c: sketch(F.coalesce(F.col(c), F.lit(""))) for c in df.columns}
    part = sketch(F.lit(" ".join(words[1000:2000])))
    r = df.select(
        resemblance(s["a"], s["b"]).alias("j"), containment(part, s["a"]).alias("c"), distinct_shingles(s["a"]).alias("n"),
        (merge(s["a"], sketch(F.lit(" ".join(words[1996:2004])))) == s["ab"]).alias("same"),
        resemblance(s["e"], s["z"]).alias("empty"), resemblance(s["a"], s["e"]).alias("none"), F.size(s["e"]).alias("size")).first()
    assert r["j"] == pytest.approx(1 / 3, abs=0.13) and r["c"] > 0.8 and r["n"] == pytest.approx(1996, rel=0.3)
    assert r["same"] and (r["empty"], r["none"], r["size"]) == (1.0, 0.0, 0)


def test_ties_nulls_and_single_rows(llm):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve é"
    rows = [(1, a), (1, a), (1, a), (2, b), (5, None), (None, "q"), (None, "q"), (9, " \t")]
    got = [(r["doc_id"], r["edited_sha256"], r["near_next"]) for r in fingerprint_neighbours(docs_frame(llm, rows)).collect()]
    assert len(got) == len(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ones = sorted(x[1:] for x in got if x[0] == 1)
    assert ones == sorted([(sha(edit(a, a)), 1.0)] * 2 + [(sha(edit(a, b)), 0.0)])
    assert [x[1] for x in got if x[0] == 9] == [sha(" q"[:1])] or [x[1] for x in got if x[0] == 9] == [sha(edit(" \t", "q"))]
    assert sorted(x[2] for x in got if x[0] is None) == [0.0, 1.0]
    alone = fingerprint_neighbours(docs_frame(llm, [(4, a), (4, a)])).collect()
    assert [(r["edited_sha256"], r["near_next"]) for r in alone] == [(sha(edit(a, a)), 1.0)] * 2
    assert fingerprint_neighbours(docs_frame(llm, [])).count() == 0
