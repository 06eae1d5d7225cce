"""Collocations by dynamic itemset counting against the SQL and brute force."""

import collections
import re

import duckdb
import numpy as np
import pytest

from ledgerlens.llm import collocations as dic
from ledgerlens.llm.queries import ORACLES, QUERIES

from .conftest import SF


def brute(rows, longest, least, cover):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    cands = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = set()
    for (lang, p), a in cands.items():
        inside = [b for (m, q), b in cands.items() if m == lang and len(q) > len(p)
                  and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= cover * a for b in inside):
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                             for k in range(1, len(p)))
        out.add((lang, " ".join(p), a, l, r, n[lang], score))
    return out


def frame(spark, rows, parts=4):
    data = [(i, lang, text, 7, "x") for i, (lang, text) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, lang string, text string, level int, phrase string").repartition(parts)


def got(df):
    return {(r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


ODD = [("en", "New York, new york. New\tYork  city! NEW YORK city; in New York city"), (None, "a b a b a b a b"),
       ("und", "a b. a b"), ("en", None), ("en", ""), ("fr", "Été à la mer. été à la MER été à la mer"),
       ("en", " new york  x"), ("de", "z " * 40), ("en", ".,;:!?")]


@pytest.mark.parametrize("longest,least,shards", [(3, 2, 3), (4, 2, 2), (2, 3, 1), (3, 1, 4)])
def test_brute_force(llm, longest, least, shards):
    rng = np.random.default_rng(5)
    rows = ODD * 2 + [("en", " ".join(rng.choice(list("abcdefg") + ["b."], 30, p=[.3, .2, .15, .1, .1, .05, .05, .05]))) for _ in range(40)]
    rows += [("en", "the same text again, the same text again")] * 30          # one text holds a third of the rows
    df = dic.collocations(frame(llm, rows), longest, least, 50, None, shards)
    assert got(df) == brute(rows, longest, least, 50)


def test_ranks_and_ties(llm):
    rows = [("en", "b c. a b. x y"), ("en", "a b. b c. x y")] * 3
    out = dic.collocations(frame(llm, rows), 2, 6, 50, 2, 3).orderBy("rank").collect()
    assert [(r.rank, r.phrase, r.a) for r in out] == [(1, "x y", 6), (2, "a b", 6)]


def test_empty_table(llm):
    assert dic.collocations(frame(llm, rows=ODD).limit(0)).collect() == []


def test_small_chunks_and_windows(llm, monkeypatch):
    text = ("one two three, " * 50 + "x" * 5000 + " end. ").encode()
    want = dic.word_keys(text, "en")
    monkeypatch.setattr(dic, "WINDOW", 64)
    dic._POWERS.clear()
    have = dic.word_keys(text, "en")
    dic._POWERS.clear()
    assert all((a == b).all() for a, b in zip(want, have))
    assert len(set(want[0].tolist())) == 5
    monkeypatch.setattr(dic, "CHUNK_WORDS", 20)
    parts = list(dic._cut(text))
    assert b"".join(parts) == text and len(parts) > 3 and all(p[-1:] in b"., " for p in parts)


def test_a_late_phrase_is_counted_a_whole_cycle(llm):
    """A pair whose words reach the threshold in the last shard only."""
    rows = [("en", f"common filler {i % 5}") for i in range(200)] + [("en", "rare pair here")] * 10
    out = got(dic.collocations(frame(llm, rows), 3, 10, 101, None, 3))
    assert out == brute(rows, 3, 10, 101)


def test_query_against_sql(llm):
    have = {tuple(r.asDict()[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in QUERIES["op13_collocations"](llm, SF).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({ORACLES['op13_collocations']})").fetchall()
    assert have == set(want) and len(want) > 100


def _packed_frame(spark, level, keys, pieces, parts):
    rows = [(level, bytearray(k), bytearray(c)) for k, c in (dic._packed(*np.unique(k, return_counts=True)) for k in np.array_split(keys, pieces))]
    return spark.createDataFrame(rows, dic.PACKED).repartition(parts)


def test_exact_sums_move_packed_ranges(llm):
    """Counted keys travel packed, some rows a task and range, and are summed exactly."""
    keys = np.random.default_rng(2).integers(0, 1 << 64, 20_000, dtype=np.uint64)
    keys = np.concatenate([keys] + [keys[:300]] * 9)
    full = llm.sparkContext.broadcast([b"", b"\xff" * (1 << dic.PHRASE_BITS - 3)])
    dealt = _packed_frame(llm, 2, keys, 40, 4).mapInArrow(dic._by_range(full), "level byte, range int, keys binary, counts binary")
    rows = dealt.groupBy("range").count().collect()
    assert len(rows) == 1 << dic.RANGE_BITS and max(r["count"] for r in rows) <= 4
    got = dealt.groupBy("level", "range").applyInArrow(dic._range_sums(10), "level byte, k long, a long").collect()
    assert {(r.level, r.k % (1 << 64), r.a) for r in got} == {(2, int(k), 10) for k in keys[:300]}


def test_a_task_sends_a_block_of_counters_once(llm, monkeypatch):
    monkeypatch.setattr(dic, "SUM_KEYS", 4096)                   # several sums a task
    keys = np.random.default_rng(3).integers(0, 1 << 64, 30_000, dtype=np.uint64)
    packed = _packed_frame(llm, 2, np.concatenate([keys, keys]), 30, 3).localCheckpoint()
    want = np.minimum(np.bincount(dic._buckets(keys, 2), minlength=1 << dic.PHRASE_BITS) * 2, dic.NEVER - 1)
    blocks = packed.mapInArrow(dic._count_blocks, "level byte, block int, part int, counts binary").groupBy("block", "part").count()
    assert {r["count"] for r in blocks.collect()} == {1}
    for fan_in in (128, 2):                                      # one round, two rounds
        monkeypatch.setattr(dic, "FAN_IN", fan_in)
        have = np.zeros(1 << dic.PHRASE_BITS, np.int64)
        for _, base, counts in dic._hashed_counts(packed):
            have[base:base + dic.BLOCK] += counts
        assert (have == want).all()
