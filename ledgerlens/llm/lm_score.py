"""Stupid-backoff language-model scores, computed as two joins by hash.

A word's score is the relative frequency of the longest n-gram that ends in it
and occurs elsewhere, times 0.4 for every order given up:

    S(w | context) = c(context w) / c(context)   if c(context w) > 0
                   = 0.4 * S(w | shorter context) else;  S(w) = c(w) / N

Counts come from the whole corpus without the document itself, so no document
vouches for its own text.  A word that occurs nowhere else scores 1 / (N + 1).

The relations are n-gram counts (hash, count), partitioned by hash, and the
documents' exploded n-grams (document, position, hash).  Both travel packed: a
chunk of documents sends each of its distinct hashes once, with its count, to
the partition of that hash (pre-aggregation, so a very common n-gram is one
entry per chunk); a partition adds up the counts of its hashes over all chunks
and answers every chunk (the join); a chunk turns the answers into scores and
sums them per document.  Hashes have 60 bits; a chunk is bounded in words, a
partition by the number of partitions, which follows the input's size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import input_bytes
from ledgerlens.session import shuffle_partitions

BACKOFF = 0.4
#: hash under which the number of words is counted
WORDS_KEY = np.uint64(0)
#: bits of an n-gram's hash
HASH_BITS = 60
_MASK = np.uint64((1 << HASH_BITS) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of a pair of hashes (a multiply-xorshift finaliser)."""
    x = a * _ODD + b
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, number of each word in order, words per text)."""
    import xxhash

    vocabulary = _Vocabulary()
    number = vocabulary.__getitem__
    parts, sizes = [], []
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").split()       # bytes: ASCII blanks only
        parts.append(np.fromiter(map(number, words), np.uint32, len(words)))
        sizes.append(len(words))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in vocabulary), np.uint64, len(vocabulary))
    return hashes, np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array(sizes, np.int64)


def ngram_hashes(hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order the hash of the n-gram ending at every word; n-grams that
    would start before their document are marked by the words' key."""
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(ids)) - starts
    word = hashes[ids] & _MASK if len(ids) else np.zeros(0, np.uint64)
    out = [word]
    for n in range(2, order + 1):
        longer = np.zeros(len(ids), np.uint64)
        if len(ids) > 1:
            longer[1:] = _mix(out[-1][:-1], word[1:]) & _MASK
        longer[place < n - 1] = WORDS_KEY
        out.append(longer)
    return out


def distinct_counts(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of all orders with their counts; the words' key
    comes first and counts the words."""
    found, counts = np.unique(np.concatenate([[WORDS_KEY], *keys]), return_counts=True)
    counts[0] = len(keys[0])
    return found, counts


def _squeeze(numbers: np.ndarray) -> bytes:
    """Fixed-width numbers with their byte planes apart (high planes are mostly
    empty), compressed."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T)
    body = pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)
    return bytes([numbers.itemsize]) + len(numbers).to_bytes(8, "little") + body


def _unsqueeze(raw: bytes) -> np.ndarray:
    width, n = raw[0], int.from_bytes(raw[1:9], "little")
    body = pa.Codec("zstd").decompress(raw[9:], decompressed_size=width * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(width, n).T).view(f"<u{width}")[:, 0]


def _pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences."""
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unsqueeze(raw), dtype=np.uint64)


def _pack(numbers: np.ndarray) -> bytes:
    return _squeeze(numbers.astype("<u4" if not len(numbers) or numbers.max() < 1 << 32 else "<u8"))


def _unpack(raw: bytes) -> np.ndarray:
    return _unsqueeze(raw)


def chunk_mark(hashes: np.ndarray, ids: np.ndarray) -> int:
    """A digest of a chunk's words in order: both readers of a chunk must agree."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes() + ids.tobytes())).view(np.int64))


def score_chunk(hashes, ids, sizes, order: int, found: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Sum of log10 scores per document, from the corpus counts of the chunk's
    distinct hashes."""
    keys = ngram_hashes(hashes, ids, sizes, order)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    elsewhere = []
    for k in keys:
        rank = np.argsort(k, kind="stable")                    # by hash, then by document
        ks, ds = k[rank], doc[rank]
        new = np.ones(len(ks), bool)
        new[1:] = ks[1:] != ks[:-1]
        gram = np.flatnonzero(new)
        new[1:] |= ds[1:] != ds[:-1]
        pair = np.flatnonzero(new)
        own, every = np.diff(np.append(pair, len(ks))), np.diff(np.append(gram, len(ks)))
        c = np.empty(len(ks), np.int64)
        c[rank] = np.repeat(total[np.searchsorted(found, ks[gram])], every) - np.repeat(own, own)
        c[k == WORDS_KEY] = 0
        elsewhere.append(c)
    words = (total[0] - sizes)[doc]
    first = elsewhere[0]
    s = np.where(first > 0, np.log10(np.maximum(first, 1)) - np.log10(np.maximum(words, 1)), -np.log10(words + 1.0))
    for n in range(2, order + 1):
        context = np.zeros(len(ids), np.int64)
        context[1:] = elsewhere[n - 2][:-1]
        seen = elsewhere[n - 1] > 0
        ratio = np.log10(np.maximum(elsewhere[n - 1], 1)) - np.log10(np.maximum(context, 1))
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        s = np.where(seen, ratio, np.where(place >= n - 1, s + np.log10(BACKOFF), s))
    return np.bincount(doc, s, len(sizes)) if len(ids) else np.zeros(len(sizes))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, chunk_words: int = 1_250_000,
              partition_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, log10_sum, score (log10_sum / n_words, 4 decimals; null
    for a text without words) for every row.

    The corpus is the whole table, every row a document of its own: exact copies
    vouch for each other.  Null texts are empty."""
    spark = docs.sparkSession
    # the scan's own partition number: the task's differs between the two readers below
    small = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        F.spark_partition_id().alias("at"))
    kind = small.schema["doc_id"].dataType
    wanted = max(8, shuffle_partitions(spark), input_bytes(docs) // partition_bytes)
    bits = max(3, int(wanted - 1).bit_length())

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
        """Whole documents of a scan partition, about ``chunk_words`` words each."""
        number, ids, texts, words = -1, [], [], 0
        for b in batches:
            if number < 0 and b.num_rows:
                number = b.column(2)[0].as_py() << 24
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                words += len(t) // 6 + 1 if t else 1
                if words >= chunk_words:
                    yield number, ids, texts
                    number, ids, texts, words = number + 1, [], [], 0
        if ids:
            yield number, ids, texts

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, texts in chunks(batches):
            hashes, words, sizes = word_ids(texts)
            found, counts = distinct_counts(ngram_hashes(hashes, words, sizes, order))
            mark = chunk_mark(hashes, words)
            part = (found >> np.uint64(HASH_BITS - bits)).astype(np.int64)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            for lo in range(0, len(cut) - 1, 64):
                spans = [(cut[i], cut[i + 1]) for i in range(lo, min(lo + 64, len(cut) - 1))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part[a]) for a, _ in spans], pa.int64()), pa.array([number] * len(spans), pa.int64()),
                     pa.array([mark] * len(spans), pa.int64()), pa.array([_pack_sorted(found[a:b]) for a, b in spans], pa.binary()),
                     pa.array([_pack(counts[a:b]) for a, b in spans], pa.binary())], names=["part", "chunk", "mark", "keys", "counts"])

    def add_up(group: pa.Table) -> pa.Table:
        keys = [_unpack_sorted(k) for k in group.column("keys").to_pylist()]
        ends = np.cumsum([len(k) for k in keys])
        counts = np.concatenate([_unpack(c) for c in group.column("counts").to_pylist()]).astype(np.int64)
        found, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, counts, len(found)).astype(np.int64)
        # what the other chunks hold: mostly nothing, so it packs well
        back = np.split(total[which] - counts, ends[:-1])
        return pa.table({"chunk": group.column("chunk"), "part": group.column("part"), "mark": group.column("mark"),
                         "body": pa.array([_pack(x) for x in back], pa.binary())})

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, texts in chunks(batches):
            hashes, words, sizes = word_ids(texts)
            body = pickle.dumps((ids, hashes, _pack(words), sizes))
            mark = chunk_mark(hashes, words)
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (number, -1, mark)),
                                              pa.array([body], pa.binary())], names=["chunk", "part", "mark", "body"])

    def score(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("part").to_pylist(), group.column("body").to_pylist()))
        if rows[0][0] != -1 or len(set(group.column("mark").to_pylist())) != 1:
            raise ValueError("the two scans dealt the documents differently; run the query again")
        ids, hashes, words, sizes = pickle.loads(rows[0][1])
        words = _unpack(words).astype(np.uint32)
        found, counts = distinct_counts(ngram_hashes(hashes, words, sizes, order))
        others = np.concatenate([_unpack(body) for _, body in rows[1:]]).astype(np.int64)
        if len(others) != len(found):
            raise ValueError("a chunk's answers do not match its n-grams")
        total = others + counts
        sums = score_chunk(hashes, words, sizes, order, found, total)
        mean = np.where(sizes > 0, np.rint(sums / np.maximum(sizes, 1) * 1e4) / 1e4, np.nan)
        return pa.table({"doc_id": pa.array(ids, arrow_kind), "n_words": pa.array(sizes), "log10_sum": pa.array(np.rint(sums * 1e4) / 1e4),
                         "score": pa.array(mean, mask=sizes == 0)})

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(kind)
    asked = small.mapInArrow(ask, "part long, chunk long, mark long, keys binary, counts binary")
    answers = asked.groupBy("part").applyInArrow(add_up, "chunk long, part long, mark long, body binary")
    rows = answers.unionByName(small.mapInArrow(home, "chunk long, part long, mark long, body binary"))
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()),
                           T.StructField("log10_sum", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return rows.groupBy("chunk").applyInArrow(score, schema)


def lm_oracle(order: int = 3) -> str:
    """DuckDB SQL of the same scores, on n-grams as strings."""
    grams = ["w"] + [None] * (order - 1)
    for n in range(2, order + 1):
        grams[n - 1] = " || ' ' || ".join([f"lag(w, {k}) OVER p" for k in range(n - 1, 0, -1)] + ["w"])
    cols = ", ".join(f"{g} AS g{n}" for n, g in enumerate(grams, 1))
    total = ", ".join(f"t{n} AS (SELECT g{n} AS g, count(*) AS c FROM x WHERE g{n} IS NOT NULL GROUP BY 1), "
                      f"o{n} AS (SELECT uid, g{n} AS g, count(*) AS c FROM x WHERE g{n} IS NOT NULL GROUP BY 1, 2)"
                      for n in range(1, order + 1))
    joins = " ".join(f"LEFT JOIN t{n} ON t{n}.g = x.g{n} LEFT JOIN o{n} ON o{n}.uid = x.uid AND o{n}.g = x.g{n}"
                     for n in range(1, order + 1))
    e = ", ".join(f"coalesce(t{n}.c - o{n}.c, 0) AS e{n}" for n in range(1, order + 1))
    lagged = ", ".join(f"coalesce(lag(e{n}) OVER (PARTITION BY uid ORDER BY i), 0) AS b{n}" for n in range(1, order + 1))
    s = "CASE WHEN e1 > 0 THEN log10(e1) - log10(greatest(n_all - n_own, 1)) ELSE -log10(n_all - n_own + 1.0) END"
    for n in range(2, order + 1):
        s = f"CASE WHEN e{n} > 0 THEN log10(e{n}) - log10(b{n - 1}) WHEN i >= {n} THEN {s} + log10({BACKOFF}::DOUBLE) ELSE {s} END"
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS uid, doc_id,
       regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
y AS (SELECT uid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
x AS MATERIALIZED (SELECT uid, i, {cols} FROM y WINDOW p AS (PARTITION BY uid ORDER BY i)),
{total},
e AS (SELECT x.uid, i, {e} FROM x {joins}),
b AS (SELECT *, {lagged}, count(*) OVER () AS n_all, count(*) OVER (PARTITION BY uid) AS n_own FROM e),
s AS (SELECT uid, sum({s}) AS total FROM b GROUP BY uid)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce(total, 0), 4) AS log10_sum,
       CASE WHEN len(ws) > 0 THEN round(total / len(ws), 4) END AS score
FROM d LEFT JOIN s USING (uid)
"""
