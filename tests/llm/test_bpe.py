"""Byte-level BPE: equal to the rank library, exact round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from ledgerlens.llm.bpe import ByteBpe, bpe_encode, read_ranks, serialise_model
from ledgerlens.llm.queries import QUERIES

from .conftest import SF, docs_frame

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(PATH)


@pytest.fixture(scope="module")
def rank_library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_equals_rank_library(llm, documents, rank_library):
    got = {r["doc_id"]: r for r in QUERIES["op10_byte_bpe"](llm, SF).collect()}
    assert len(got) == len(documents)
    for d in documents:
        ids = rank_library.encode_ordinary(d["text"] or "")
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_odd_texts(ranks, rank_library):
    rng = random.Random(2)
    odd = [chr(c) for c in [*range(0, 300), 0x3000, 0x2028, 0x200B, 0xFEFF, 0x1F600, 0x4E2D, 0x661, 0x2162, 0x301, 0x10FFFF]]
    odd += ["<|endoftext|>", "<unk>", "▁", "'s", " the", "  ", "\n\n"]
    bpe = ByteBpe(ranks, P.PATTERN, keep=50)                      # the cache is emptied often
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(12))) for _ in range(3000)]
    for t in [*texts, "a" * 5000, " " * 4000, "é" * 2000, "中文" * 1000, ""]:
        raw = bpe.encode(t)
        assert np.frombuffer(raw, "<u4").tolist() == rank_library.encode_ordinary(t)
        assert bpe.decode(raw) == t.encode()


def test_vocabulary_is_checked():
    with pytest.raises(ValueError):
        serialise_model({b"a": 0})
    with pytest.raises(ValueError):
        serialise_model({bytes([b]): b + 1 for b in range(256)})


def test_rows_kept(llm):
    rows = [(1, None), (1, ""), (None, "x y"), (2, "long " * 30_000)]
    got = bpe_encode(docs_frame(llm, rows), PATH, P.PATTERN, carry=("source",)).collect()
    assert sorted(len(r["ids"]) == r["n_tokens"] for r in got) == [True] * 4
    assert sum(r["n_tokens"] == 0 for r in got) == 2 and got[0]["source"] == "s"
    assert bpe_encode(docs_frame(llm, []), PATH, P.PATTERN).count() == 0
