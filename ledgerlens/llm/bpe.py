"""Byte-level BPE encoding and decoding through a sentencepiece model.

The model is not trained: it is serialised directly from a rank vocabulary.
Every byte string of the vocabulary becomes a piece by mapping each byte to one
printable character, with score = -rank, so sentencepiece's merge order (best
score first, leftmost on ties) is the rank order.  Normalisation is the
identity: no dummy prefix, no white-space escaping, no folding.

A text is cut into pre-tokens; each is encoded on its own; one that is itself
in the vocabulary is that token, as in the rank library.  Decoding maps ids to
their byte strings.  Texts are read whole, in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def byte_chars() -> list[str]:
    """One printable, non-blank character for each byte: itself where it is one
    in Latin-1, else the next free one from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: int | bytes | np.float32) -> bytes:
    """One protocol-buffer field: varint, 32-bit float or length-delimited."""
    if isinstance(value, np.float32):
        return _varint(number << 3 | 5) + value.tobytes()
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece i is the token of rank i; the unknown
    piece, which the format wants, comes last."""
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary must hold every single byte")
    chars = byte_chars()
    normal, unknown, bpe = 1, 2, 2                                    # piece types; model type
    pieces = [_field(1, _field(1, "".join(chars[b] for b in t).encode()) + _field(2, np.float32(-r)) + _field(3, normal))
              for r, t in enumerate(by_rank)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, np.float32(0)) + _field(3, unknown)))
    trainer = _field(2, _field(3, bpe) + _field(4, len(pieces)))
    normalizer = _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return b"".join(pieces) + trainer + normalizer


class ByteBpe:
    """Encoder and decoder for one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes | None = None, keep: int = 300_000):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model or serialise_model(ranks))
        self.find = regex.compile(pattern).findall
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.ranks, self.keep = ranks, keep
        self.table = {b: c for b, c in enumerate(byte_chars())}
        self.memo: dict[str, bytes] = {}               # pre-token -> its ids as little-endian uint32

    def _learn(self, news: list[str]) -> None:
        if len(self.memo) + len(news) > self.keep:     # a cache, emptied when full
            self.memo.clear()
        hard = []
        for t in news:
            whole = self.ranks.get(t.encode("utf-8"))
            if whole is None:
                hard.append(t)
            else:
                self.memo[t] = whole.to_bytes(4, "little")
        mapped = [t.encode("utf-8").decode("latin-1").translate(self.table) for t in hard]
        for t, ids in zip(hard, self.sp.encode(mapped, out_type=int, num_threads=1)):
            self.memo[t] = np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        parts = self.find(text or "")
        try:
            return b"".join(map(self.memo.__getitem__, parts))
        except KeyError:
            self._learn([t for t in set(parts) if t not in self.memo])
        if all(map(self.memo.__contains__, parts)):
            return b"".join(map(self.memo.__getitem__, parts))
        self._learn(list(set(parts)))                  # the cache was emptied meanwhile
        return b"".join(map(self.memo.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
               carry: tuple[str, ...] = (), with_ids: bool = True) -> DataFrame:
    """doc_id, the ``carry`` columns, n_tokens, ids_sha256, decoded_sha256 and,
    with ``with_ids``, the ids themselves, for every row (null text: no ids).

    ``path`` is the rank file, read once on the driver; its ranks and the
    serialised model (a fixed vocabulary of some 10^4-10^5 entries, about 2 MB)
    go to the workers by broadcast."""
    spark = docs.sparkSession
    ranks = read_ranks(path)
    shared = spark.sparkContext.broadcast((ranks, serialise_model(ranks), pattern))
    names = ["doc_id", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model, cut = shared.value
        bpe = ByteBpe(words, cut, model)
        for b in batches:
            n, ids_sha, text_sha, ids = [], [], [], []
            for t in b.column(len(names)).to_pylist():
                raw = bpe.encode(t)
                n.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(raw)).hexdigest())
                ids.append(raw if with_ids else b"")
            out = [*b.columns[:len(names)], pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
            if with_ids:
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                out.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), flat))
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema.fields])

    small = docs.select(F.col(id_col).alias("doc_id"), *carry, F.col(text_col).cast("string").alias("_text"))
    from pyspark.sql import types as T

    schema = T.StructType([*small.schema.fields[:len(names)], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
                           *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    return small.mapInArrow(run, schema)
