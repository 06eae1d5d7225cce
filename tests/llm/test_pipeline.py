"""The pipeline against a brute-force version of its stages."""

import collections
import gc
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm.bpe import read_ranks
from ledgerlens.llm.common import cut_lineage, table
from ledgerlens.llm.queries import QUERIES
from ledgerlens.llm.quality import score_texts, train
from ledgerlens.session import scratch_tables

from .conftest import SF, docs_frame
from .test_dedup import norm, slow_components, slow_fingerprint
from .test_mixing import targets_by_hand


def test_stages_against_brute_force(llm, documents):
    docs = table(llm, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "simhash near-dedup", "mixing sources", "byte-level bpe"]
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(llm, docs, SF))
        got[name] = docs.collect()
        if name != "byte-level bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    field = train(table(llm, SF, "documents"), table(llm, SF, "labels"))
    score, _ = score_texts(field, [d["text"] for d in documents])
    good = {d["doc_id"]: d["text"] for d, s in zip(documents, score) if s >= 0.3}
    assert {r["doc_id"]: r["text"] for r in got["quality classifier"]} == good
    least = {}
    for i, t in sorted(good.items()):
        least.setdefault(norm(t), i)
    assert {r["doc_id"] for r in got["exact dedup"]} == set(least.values())
    comp = slow_components({i: slow_fingerprint(good[i]) for i in least.values()})
    near = {i for i, c in comp.items() if i == c}
    assert {r["doc_id"]: r["text"] for r in got["simhash near-dedup"]} == {i: good[i] for i in near}
    source = {d["doc_id"]: d["source"] for d in documents}
    sizes, taken = collections.Counter(), collections.Counter()
    for i in near:
        sizes[source[i]] += len(good[i].split())
    for r in got["mixing sources"]:
        taken[r["source"]] += len(r["text"].split())
        assert norm(r["text"]) in norm(good[r["doc_id"]]) or len(r["text"]) < len(good[r["doc_id"]])
    for s, t in targets_by_hand(sizes).items():
        assert abs(taken[s] - t) <= 0.51
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                            mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))
    want = sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest(), enc.encode_ordinary(r["text"]))
                  for r in got["mixing sources"])
    assert sorted((r["doc_id"], r["decoded_sha256"], r["ids"]) for r in got["byte-level bpe"]) == want
    assert all(r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
               for r in got["byte-level bpe"])
    ran = QUERIES["pipeline"](llm, SF).collect()
    assert sorted(map(str, ran)) == sorted(map(str, got["byte-level bpe"]))


def test_stages_on_odd_rows(llm):
    rows = [(1, None), (1, ""), (None, "Same words, twice over.\nAnd a line."), (7, "Same words, twice over.\nAnd a line."),
            (7, "Same words, twice over.\nAnd a line."), (9, "long text " * 20_000)]
    for some in (rows, []):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(llm, docs_frame(llm, some), SF)
            n = out.count()
            want = {"exact dedup": 3, "simhash near-dedup": 3, "byte-level bpe": 6}.get(name, n)
            assert n == (want if some else 0)
            if name != "byte-level bpe":
                assert out.columns == docs_frame(llm, []).columns


def test_columns_of_any_name_pass(llm):
    rows = [(1, "Same words, twice over."), (2, "Same words, twice over."), (3, "other words " * 700), (4, "")]
    names = ["_uid", "_size", "_WORDS", "_parts", "_all", "_cut", "uid", "size", "root", "lo", "hi", "epoch"]
    docs = docs_frame(llm, rows)
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.concat(F.lit(f"{i}-"), F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(llm, docs, SF))
        got = docs.collect()
        assert docs.columns == docs_frame(llm, []).columns + names and got, name
        assert all(r[n] == f"{i}-{r['doc_id']}" for r in got for i, n in enumerate(names)), name
    assert {r["doc_id"] for r in got} <= {1, 3}


def test_stages_built_before_the_first_is_written(llm):
    rows = [(i, f"words of text number {i % 7} and more of it") for i in range(20)]
    stages = dict(corpus_pipeline.STAGES)
    docs = docs_frame(llm, rows)
    one, two = stages["exact dedup"](llm, docs, SF), stages["simhash near-dedup"](llm, docs, SF)
    three = stages["byte-level bpe"](llm, stages["mixing sources"](llm, one, SF), SF)
    four = stages["exact dedup"](llm, docs, SF)
    assert one.count() == four.count() == 7 and two.count() <= 7 and {r["doc_id"] for r in three.collect()} <= set(range(7))
    made = scratch_tables(llm)
    del one, two, three, four
    gc.collect()
    stages["byte-level bpe"](llm, docs, SF)
    assert len(scratch_tables(llm)) < len(made)
