"""Mixing: targets, exact totals, permutation, drawn slots; the query's taken
words are checked against the SQL."""

import collections

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut_lineage, table
from ledgerlens.llm.mixing import draw_slots, mix_plan, mix_sources, mixed_documents, source_targets, word_sizes
from ledgerlens.llm.queries import ORACLES, QUERIES

from .conftest import SF


def targets_by_hand(sizes):
    """Share by weight, cap, share the excess again until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        room = total - sum(capped.values())
        share = {s: room * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return {**share, **capped}
        capped |= {s: 3.0 * sizes[s] for s in above}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, -1, 5) for i, t, s in rows],
                                 "doc_id long, text string, source string, n_chars long, size int").repartition(4)


def test_query_against_sql_and_targets(llm):
    got = [r.asDict() for r in QUERIES["op1_mix_sources"](llm, SF).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLES["op1_mix_sources"]).df().to_dict("records")
    assert sorted(map(str, ({k: r[k] for k in sorted(r)} for r in got))) == sorted(
        map(str, ({k: r[k] for k in sorted(r)} for r in want)))
    src = dict(con.execute("SELECT doc_id, source FROM documents").fetchall())
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        size[src[r["doc_id"]]] += r["size"]
        taken[src[r["doc_id"]]] += r["taken"]
        target[src[r["doc_id"]]] = r["target"]
    for s, t in targets_by_hand(size).items():
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 0.5


def test_caps_nulls_ties_and_empty(llm):
    rows = [(i, "w " * 5, "a") for i in range(3)] + [(i, "x y\tz\n" * 700, "b") for i in range(10, 60)]
    rows += [(None, "q " * 30, None), (None, None, None), (7, "", "empty"), (7, None, "empty"), (8, "one", "c"), (8, "one", "c")]
    got = mix_sources(frame(llm, rows), block=16, per_shard=8).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets_by_hand(sizes)
    by_size = collections.defaultdict(int)
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        by_size[r["source_size"]] += r["taken"]
    for s, t in want.items():
        assert by_size[sizes[s]] == pytest.approx(t, abs=0.51)
    again = mix_sources(frame(llm, rows).repartition(7), block=16, per_shard=8).collect()
    key = lambda r: str((r["doc_id"], r["size"], r["taken"]))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mix_sources(frame(llm, [])).count() == 0
    assert mix_sources(frame(llm, [(1, None, None)])).first()["taken"] == 0


def test_slots_are_filled_by_permutations(llm):
    src = cut_lineage(source_targets(word_sizes(table(llm, SF, "documents")), 64, 7))
    slots = draw_slots(src, 256, 64, 7, group=300).collect()
    total = sum(r["n"] for r in src.collect())
    assert sorted(r["slot"] for r in slots) == list(range(total))
    for s in src.collect():
        mine = [r for r in slots if r["sk"] == s["sk"]]
        assert len(mine) == s["n"]
        for e in {r["epoch"] for r in mine}:
            blocks = [r["block"] for r in mine if r["epoch"] == e]
            assert len(set(blocks)) == len(blocks) and min(blocks) >= 0 and max(blocks) < s["nb"]
            assert e == max(r["epoch"] for r in mine) or len(blocks) == s["nb"]
    # the counts of a shard follow the target weights as a multinomial draw does
    big = max(src.collect(), key=lambda r: r["n"])
    shards = collections.Counter(r["shard"] for r in slots if r["sk"] == big["sk"])
    p = big["n"] / total
    for shard in range(total // 256):
        assert abs(shards[shard] - 256 * p) < 5 * (256 * p * (1 - p)) ** 0.5
    assert len(set(shards[s] for s in range(total // 256))) > 1


def test_mixed_documents_hold_the_words_taken(llm):
    docs = table(llm, SF, "documents")
    mixed = mixed_documents(docs)
    assert mixed.dtypes == docs.dtypes
    n = lambda df: {r["source"]: r["w"] for r in df.groupBy("source").agg(
        F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("w")).collect()}
    plan = mix_plan(word_sizes(docs)).groupBy("source").agg(F.sum(F.col("hi") - F.col("lo")).alias("w"))
    assert n(mixed) == {r["source"]: r["w"] for r in plan.collect() if r["w"]}
    whole = mixed.join(docs, "doc_id").where(mixed["text"] == docs["text"]).count()
    assert whole > 300 and mixed.where("n_chars <> length(text)").count() == 0
