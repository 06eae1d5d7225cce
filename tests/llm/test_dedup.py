"""Exact dedup and SimHash near-dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash

from ledgerlens.llm.exact_dedup import exact_dedup, keep_first
from ledgerlens.llm.simhash import close_lanes, _planes, fingerprint, file_under_keys, near_dedup, local_stars
from ledgerlens.llm.queries import QUERIES

from .conftest import SF, docs_frame


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_query_against_brute_force(llm, documents):
    got = {r["doc_id"]: r for r in QUERIES["op7_exact_dedup"](llm, SF).collect()}
    groups = {}
    for d in documents:
        groups.setdefault(norm(d["text"]), []).append(d["doc_id"])
    assert len(got) == len(documents)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (min(ids), len(ids), i == min(ids))
            assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_exact_edges(llm):
    rows = [(5, "a  b"), (3, "a\tb"), (3, "a b"), (None, "a b"), (7, None), (8, ""), (9, " "), (None, "z"), (None, "z")]
    for fan_in in (2, 16):
        got = exact_dedup(docs_frame(llm, rows, 7), fan_in=fan_in).collect()
        assert len(got) == len(rows)
        ab = [r for r in got if r["group_size"] == 4]
        assert len(ab) == 4 and {r["keep_id"] for r in ab} == {3} and sum(r["kept"] for r in ab) == 1
        assert {(r["doc_id"], r["keep_id"]) for r in got if r["group_size"] == 2 and r["doc_id"]} == {(7, 7), (8, 7)}
        assert sum(r["kept"] for r in got if r["doc_id"] is None and r["group_size"] == 2) == 1
    kept = keep_first(docs_frame(llm, rows, 7))
    assert kept.columns == docs_frame(llm, rows).columns and kept.count() == 4
    assert exact_dedup(docs_frame(llm, [])).count() == 0


def slow_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps, radius=2):
    """fps: {doc_id: fingerprint}"""
    ids = sorted(fps)
    f = np.array([fps[i] for i in ids], np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids)):
        near = np.flatnonzero(np.unpackbits((f ^ f[i]).view(np.uint8).reshape(-1, 8), axis=1).sum(1) <= radius)
        for j in near:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_simhash_query_against_brute_force(llm, documents):
    got = {r["doc_id"]: r for r in QUERIES["op4_simhash_near_dedup"](llm, SF).collect()}
    fps = {d["doc_id"]: slow_fingerprint(d["text"]) for d in documents}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == slow_components(fps)


def test_fingerprint_edges():
    assert fingerprint(None) == fingerprint(" \n") == 0
    for t in ("a", "A b", "a b c", "É ü Z z", "x " * 70_000):
        assert fingerprint(t) == slow_fingerprint(t)


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3).astype(np.uint64)
    fps = np.array([b ^ sum(np.uint64(1) << np.uint64(x) for x in rng.choice(64, rng.integers(0, 6), False))
                    if True else b for b in np.repeat(base, 64)], np.uint64)
    lanes = np.full(3, ~np.uint64(0))
    lanes[2] = np.uint64(5)
    q, block = np.repeat(fps, 3), np.tile(np.arange(3), len(fps))
    for radius in (1, 2, 3, 5):
        items, masks = close_lanes(q, _planes(fps), block, lanes, radius)
        got = {(int(i), x) for i, m in zip(items, masks) for x in range(64) if int(m) >> x & 1}
        want = {(i, x) for i in range(len(q)) for x in range(64)
                if bin(int(q[i]) ^ int(fps[block[i] * 64 + x])).count("1") <= radius and int(lanes[block[i]]) >> x & 1}
        assert got == want


def test_hot_keys_are_refiled_without_losing_links(llm):
    rng = random.Random(3)
    center = rng.getrandbits(64)
    fps = {center}
    while len(fps) < 400:                                # one dense group, and others far away
        x = rng.choice(sorted(fps))
        fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps |= {rng.getrandbits(64) for _ in range(100)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = llm.createDataFrame([(f,) for f in signed], "fp long")
    want = slow_components({f: f for f in fps})
    from ledgerlens.llm.simhash import links
    from ledgerlens.llm.components import connected_components
    for split in (4096, 8):
        cc = {r["node"] & (2**64 - 1): r["root"] for r in
              connected_components(links(file_under_keys(df, split_above=split), 2, batch_rows=50)).collect()}
        groups = {}
        for f in fps:
            groups.setdefault(cc.get(f, f), set()).add(f)
        brute = {}
        for f, r in want.items():
            brute.setdefault(r, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_convergence_check_over_many_edges(llm):
    """More edges than a sum of 40-bit hashes in a long can take."""
    from pyspark.sql import functions as F

    from ledgerlens.llm.components import _state
    edges = llm.range(20_000_000).select((F.col("id") + 1).alias("a"), F.lit(0).cast("long").alias("b"))
    state = _state(edges)
    assert state["n"] == 20_000_000 and state == _state(edges.repartition(5)) != _state(edges.where("a <> 7"))
    assert _state(edges.limit(0))["n"] == 0 and state != _state(edges.select("a", F.when(F.col("a") == 7, 1).otherwise(0).cast("long").alias("b")))


def test_near_dedup_edges(llm):
    rows = [(4, None), (2, " "), (2, " "), (None, "a b c d"), (9, "a b c d"), (8, "A B c d")]
    got = [tuple(r) for r in near_dedup(docs_frame(llm, rows)).collect()]
    assert len(got) == 6
    assert {x[2] for x in got if x[1] == "0" * 16} == {2} and {x[2] for x in got if x[1] != "0" * 16} == {8}
    assert near_dedup(docs_frame(llm, [])).count() == 0
    a, b = local_stars(np.array([0, 0, 1]), np.array([7, 6, 1], np.uint64), 2)
    assert (a.tolist(), b.tolist()) == ([7], [6])
