"""Phrase collocations by dynamic itemset counting.

The corpus is dealt into ``shards`` by a hash of the text and scanned in cycles,
one shard a step, while phrases of all lengths are counted side by side.  Single
words are counted from the first step.  A longer phrase becomes active at the
end of the step in which both its subphrases (without its last, without its
first word) have reached the threshold; it is then counted in the next
``shards`` steps, one full cycle, so its count is exact although it started in
the middle of a cycle.  Scanning ends when no phrase has an open cycle, after
three cycles at most for phrases of three words.

Whether a phrase is active must be known inside the scanning tasks, whose memory
is bounded.  Counts so far are therefore kept a second time in hashed counters
of a fixed size (one byte a bucket, broadcast): a bucket reaches the threshold no
later than any phrase in it, so activation may come early but never fails, and
every phrase of a bucket starts and ends with it.  Exact counts per phrase decide
what is kept: the packed counts are dealt by key range, and a range is summed up at once.

Inside the scans a phrase is a 64-bit key made of its language and words.  Last,
the keys that reached the threshold are named from the texts; a key found with
two names (two phrases with one hash) or with none makes the query fail.  Which parts a phrase has,
scores and the removal of covered phrases are joins over the named phrases.

A null text is empty, a null language ``und``; other columns are not read.
Repeated rows count again.  An empty table gives no rows.  Texts are read whole;
a text longer than ``WINDOW`` bytes is cut at a border of pieces.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut_lineage, text_of
from ledgerlens.session import drop_scratch, scratch_tables

#: bytes hashed at a time, words counted at a time, keys summed up at a time
WINDOW, CHUNK_WORDS, SUM_KEYS = 1 << 18, 500_000, 500_000
#: log2 of the hashed counters: of single words, of longer phrases
WORD_BITS, PHRASE_BITS = 22, 23
BLOCK = 1 << 18
#: tasks whose counts of a block are summed up at once
FAN_IN = 128
#: log2 of the key ranges of a length, each summed up exactly by itself
RANGE_BITS = 9
NEVER = 255

_DELIMITERS = b".,;:!?\x0a\x0b\x0c\x0d"
_KIND = np.zeros(256, np.uint8)                      # 0 word, 1 blank, 2 delimiter
_KIND[[0x20, 0x09]] = 1
_KIND[list(_DELIMITERS)] = 2
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BASE = 0x5851F42D4C957F2D - 2                       # odd, 3 mod 8
_DIGIT = np.random.default_rng(13).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_DIGIT = _DIGIT[np.frombuffer(_LOWER, np.uint8)]     # both cases of a letter alike
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    size = WINDOW if n <= WINDOW else 1 << (n - 1).bit_length()
    if size not in _POWERS:
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inverse):
            steps = np.full(size + 1, b, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[size] = tuple(out)
    return _POWERS[size]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def _append(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Key of a phrase followed by one more word."""
    return _mix(keys * np.uint64(0xC2B2AE3D27D4EB4F) + words)


def word_keys(data: bytes, lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, whether a piece starts there, first byte, end) of the words."""
    buf = np.frombuffer(data, np.uint8)
    kind = _KIND[buf]
    word = np.zeros(len(buf) + 2, bool)
    word[1:-1] = kind == 0
    start, end = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, bool), start, end
    piece = np.searchsorted(np.flatnonzero(kind == 2), start)
    first = np.concatenate([[True], piece[1:] != piece[:-1]])
    keys, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        lo = start[at]
        to = max(at + 1, int(np.searchsorted(end, lo + WINDOW, "right")))
        part = buf[lo:end[to - 1]]
        power, inverse = _powers(len(part) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_DIGIT[part] * power[:len(part)], dtype=np.uint64)])
        s, e = start[at:to] - lo, end[at:to] - lo
        keys[at:to] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        at = to
    return _mix(keys + np.uint64(xxhash.xxh64_intdigest(lang.encode()))), first, start, end


def bucket_bits(level: int) -> int:
    return WORD_BITS if level == 1 else PHRASE_BITS


def _buckets(keys: np.ndarray, level: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bucket_bits(level))).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, texts of it) in bounded pieces; columns are language, text."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist()):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= 6 * CHUNK_WORDS:
                yield from ((k, b"\n".join(v)) for k, v in held.items())
                held, size = {}, 0
    yield from ((k, b"\n".join(v)) for k, v in held.items())


def _cut(data: bytes) -> Iterator[bytes]:
    """``data`` in parts of about ``CHUNK_WORDS`` words, cut behind delimiters only."""
    most, at = 6 * CHUNK_WORDS, 0
    while len(data) - at > 2 * most:
        tail = data[at + most:]
        near = [i for i in (tail.find(bytes([d])) for d in _DELIMITERS) if i >= 0]
        if not near:
            break
        to = at + most + min(near) + 1
        yield data[at:to]
        at = to
    yield data[at:] if at else data


def _levels(keys: np.ndarray, first: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, keys, positions) of the phrases of every length within pieces."""
    yield 1, keys, np.arange(len(keys))
    at, phrase = np.arange(len(keys)), keys
    for n in range(2, longest + 1):
        ok = at + n - 1 < len(keys)
        ok[ok] = ~first[at[ok] + n - 1]
        at = at[ok]
        phrase = _append(phrase[ok], keys[at + n - 1])
        yield n, phrase, at


#: keys of one packed row
PACK = 1 << 12
PACKED = "level byte, keys binary, counts binary"


def _packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted distinct keys and their counts: differences byte plane by byte plane,
    so the files' compression finds the empty planes."""
    steps, c = np.diff(keys, prepend=np.uint64(0)).astype("<u8"), counts.astype("<u4")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes(), c.view(np.uint8).reshape(-1, 4).T.tobytes()


def _pack(level: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted distinct keys and their counts in rows of ``PACK``."""
    for lo in range(0, len(keys), 64 * PACK):
        rows = [_packed(keys[at:at + PACK], counts[at:at + PACK]) for at in range(lo, min(lo + 64 * PACK, len(keys)), PACK)]
        yield pa.RecordBatch.from_arrays([pa.array([level] * len(rows), pa.int8()), pa.array([k for k, _ in rows], pa.binary()),
                                          pa.array([c for _, c in rows], pa.binary())], names=["level", "keys", "counts"])


def _unpack(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps = np.ascontiguousarray(np.frombuffer(keys, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64), np.ascontiguousarray(np.frombuffer(counts, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for b in batches:
        for level, keys, counts in zip(*[c.to_pylist() for c in b.columns]):
            yield level, *_unpack(keys, counts)


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _scan(rows: DataFrame, step: int, shards: int, longest: int, starts) -> DataFrame:
    """Packed (level, keys, counts) of the phrases that are counted in this step.
    ``starts``: for each length but the longest the step in which a bucket
    reached the threshold."""
    def run(batches):
        act = starts.value
        for lang, text in ((lang, part) for lang, data in _chunks(batches) for part in _cut(data)):
            keys, first, _, _ = word_keys(text, lang)
            shorter = None                                       # start of the phrase one word shorter, by position
            for n, phrase, at in _levels(keys, first, longest):
                if n == 1:
                    live = phrase if step <= shards else phrase[:0]
                else:
                    since = np.maximum(shorter[at], shorter[at + 1])     # both subphrases
                    live = phrase[(since < step) & (since >= step - shards)]
                if n < longest:
                    shorter = np.full(len(keys) + 1, NEVER, np.uint8)
                    shorter[at] = np.frombuffer(act[n - 1], np.uint8)[_buckets(phrase, n)]
                yield from _pack(n, *np.unique(live, return_counts=True))
            del keys, first, phrase, at, live, shorter
            _give_back()

    return rows.mapInArrow(run, PACKED)


def _block(at: np.ndarray, counts: np.ndarray) -> bytes:
    """Counts of a block by place: four bytes of place and one of count each, or
    one byte for every place where that is shorter."""
    counts = np.minimum(counts, NEVER - 1).astype(np.uint8)
    if 5 * len(at) < BLOCK:
        return at.astype("<u4").tobytes() + counts.tobytes()
    out = np.zeros(BLOCK, np.uint8)
    out[at] = counts
    return out.tobytes()


def _add_block(out: np.ndarray, packed: bytes) -> None:
    if len(packed) == BLOCK:
        out += np.frombuffer(packed, np.uint8)
    else:
        n = len(packed) // 5
        out[np.frombuffer(packed, "<u4", n)] += np.frombuffer(packed, np.uint8, n, 4 * n)


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(level, block, part, counts): one task's packed counts as hashed counts, each
    block once."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() % FAN_IN
    held: dict[int, list] = {}
    sums: dict[int, np.ndarray] = {}

    def add(level):
        at, c = _sum(*zip(*held.pop(level)))
        at = at.astype(np.int64)
        mine = sums.setdefault(level, np.zeros(1 << bucket_bits(level), np.uint8))
        mine[at] = np.minimum(c + mine[at], NEVER - 1)

    for level, keys, counts in _unpacked(batches):
        mine = held.setdefault(level, [])
        mine.append((_buckets(keys, level).astype(np.uint64), counts))
        if len(mine) * PACK >= SUM_KEYS:
            add(level)
    for level in list(held):
        add(level)
    for level, mine in sums.items():
        for block, counts in enumerate(mine.reshape(-1, BLOCK)):
            at = np.flatnonzero(counts)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([level], pa.int8()), pa.array([block], pa.int32()), pa.array([part], pa.int32()),
                     pa.array([_block(at, counts[at])], pa.binary())], names=["level", "block", "part", "counts"])
    del sums
    _give_back()


def _merge_blocks(t: pa.Table) -> pa.Table:
    out = np.zeros(BLOCK, np.int32)
    for packed in t["counts"].to_pylist():
        _add_block(out, packed)
    at = np.flatnonzero(out)
    return pa.table({c: t[c].slice(0, 1) for c in ("level", "block", "part")} | {"counts": pa.array([_block(at, out[at])], pa.binary())})


def _hashed_counts(packed: DataFrame) -> Iterator[tuple[int, int, np.ndarray]]:
    """(level, first bucket, counts of a block): summed in two rounds if there are
    more than ``FAN_IN`` tasks, so no group holds more than that many blocks in the
    last one.  What reaches the driver is bounded by the size of the counters."""
    schema = "level byte, block int, part int, counts binary"
    some = packed.mapInArrow(_count_blocks, schema)
    if packed.rdd.getNumPartitions() > FAN_IN:
        some = some.groupBy("level", "block", "part").applyInArrow(_merge_blocks, schema)
    for r in some.groupBy("level", "block").applyInArrow(_merge_blocks, schema).collect():
        out = np.zeros(BLOCK, np.int32)
        _add_block(out, bytes(r["counts"]))
        yield r["level"], r["block"] * BLOCK, out


def _add_counts(packed: DataFrame, totals: dict[int, np.ndarray]) -> None:
    """Add a step's counts to the hashed counters, which stop at ``NEVER`` - 1."""
    for level, base, counts in _hashed_counts(packed):
        part = totals[level][base:base + BLOCK]
        part[:] = np.minimum(part + counts, NEVER - 1)


def _open(starts: np.ndarray, step: int, shards: int) -> bool:
    """Whether a phrase that one of these buckets starts is counted in ``step`` or later."""
    return bool(((starts != NEVER) & (starts >= step - shards)).any())


def _give_back() -> None:
    """Return freed memory to the system: Python workers live on after a task, and
    what the C library keeps for them counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)       # glibc only
    if trim:
        trim(0)


@contextmanager
def _small_batches(spark, records: int = 400):
    """Texts go to the Python workers ``records`` at a time while this holds, so
    neither side keeps megabytes of texts beside the counts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(records))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def count_phrases(rows: DataFrame, longest: int, least: int, shards: int) -> DataFrame:
    """(level, k, lang, phrase, a, n): every phrase of up to ``longest`` words found
    ``least`` times or more in its language, named; ``rows`` holds lang, text.
    ``n`` is the language's number of words."""
    if least >= NEVER or not 2 <= longest or not 1 <= shards:
        raise ValueError(f"least must be under {NEVER}, longest 2 or more, shards 1 or more")
    spark = rows.sparkSession
    levels = range(1, longest + 1)
    totals = {n: np.zeros(1 << bucket_bits(n), np.uint8) for n in levels}
    starts = {n: np.full(1 << bucket_bits(n), NEVER, np.uint8) for n in levels if n < longest}
    shard = F.pmod(F.xxhash64("text"), F.lit(shards))
    tasks = max(1, -(-rows.rdd.getNumPartitions() // shards))    # a shard's rows come from all input partitions
    before = set(scratch_tables(spark))
    steps, step = [], 0
    while step < shards or any(_open(s, step + 1, shards) for s in starts.values()):
        step += 1
        known = spark.sparkContext.broadcast([starts[n].tobytes() for n in levels if n < longest])
        mine = rows.where(shard == (step - 1) % shards).coalesce(tasks)
        steps.append(cut_lineage(_scan(mine, step, shards, longest, known)))
        known.destroy()
        _add_counts(steps[-1], totals)
        for n, s in starts.items():
            s[(s == NEVER) & (totals[n] >= least)] = step
    # a phrase whose bucket stayed under the threshold cannot have reached it
    full = spark.sparkContext.broadcast([np.packbits(totals[n] >= least).tobytes() for n in levels])
    counts = steps[0]
    for s in steps[1:]:
        counts = counts.unionByName(s)
    written = [p for p in scratch_tables(spark) if p not in before]
    dealt = counts.mapInArrow(_by_range(full), "level byte, range int, keys binary, counts binary")
    exact = cut_lineage(dealt.groupBy("level", "range").applyInArrow(_range_sums(least), "level byte, k long, a long"))
    drop_scratch(spark, written)                                 # the steps are summed up in ``exact``
    full.destroy()
    named, sizes = _named_keys(rows, exact, longest, levels)
    lang_n = sizes.groupBy("lang").agg(F.sum("c").alias("n"))
    one = named.groupBy("level", "k", "lang", "phrase").agg(F.lit(1).alias("one"))
    out = exact.join(one, ["level", "k"], "left").groupBy("level", "k", "a").agg(
        F.min(F.struct("lang", "phrase")).alias("p"), F.count("one").alias("names"))
    wrong = F.raise_error(F.concat(F.col("names").cast("string"), F.lit(" phrases share a key"))).cast("string")
    out = out.select("level", "p.lang", F.when(F.col("names") == 1, F.col("p.phrase")).otherwise(wrong).alias("phrase"), "a")
    return out.join(F.broadcast(lang_n) if _few(lang_n) else lang_n, "lang")


#: shares of the rows (of 16) that the rounds of naming read
ROUNDS = ((0, 1), (1, 4), (4, 16))


def _named_keys(rows: DataFrame, exact: DataFrame, longest: int, levels) -> tuple[DataFrame, DataFrame]:
    """Names (level, lang, k, phrase) of all keys of ``exact``, and (lang, c): words.
    A first scan reads a sixteenth of the rows and names most keys; the next ones
    read the rest and name what has no name yet."""
    spark = rows.sparkSession
    share = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(16))
    names, missing = [], exact
    for lo, hi in ROUNDS:
        found = {n: np.zeros(1 << bucket_bits(n), bool) for n in levels}
        for level, base, counts in _hashed_counts(missing.select("level", "k").mapInArrow(_pack_keys, PACKED)):
            found[level][base:base + BLOCK] = counts > 0
        hit = spark.sparkContext.broadcast([np.packbits(found[n]).tobytes() for n in levels])
        names.append(cut_lineage(_names(rows.where((share >= lo) & (share < hi)), longest, hit)))
        hit.destroy()
        missing = cut_lineage(missing.join(names[-1].where("level > 0").select("level", "k").distinct(), ["level", "k"], "left_anti"))
    every = names[0]
    for n in names[1:]:
        every = every.unionByName(n)
    keyed = every.where("level > 0").select("level", "lang", "k", "phrase")
    return keyed.join(exact.select("level", "k"), ["level", "k"], "left_semi"), every.where("level = 0")


def _pack_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        level, keys = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
        for n in np.unique(level).tolist():
            yield from _pack(n, *np.unique(keys[level == n], return_counts=True))


def _few(langs: DataFrame, most: int = 10_000) -> bool:
    return langs.limit(most + 1).count() <= most


def _by_range(full):
    """The keys of full buckets, summed up within a task and packed by key range."""
    def run(batches):
        held: dict[int, list] = {}
        size = 0

        def emit():
            for n, mine in held.items():
                k, c = _sum(*zip(*mine))
                part = (k >> np.uint64(64 - RANGE_BITS)).astype(np.int32)
                ends = np.flatnonzero(np.diff(part, append=-1)) + 1
                rows = [_packed(k[lo:hi], c[lo:hi]) for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist())]
                for at in range(0, len(rows), 128):
                    some = rows[at:at + 128]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([n] * len(some), pa.int8()), pa.array(part[ends[at:at + 128] - 1]), pa.array([r[0] for r in some], pa.binary()),
                         pa.array([r[1] for r in some], pa.binary())], names=["level", "range", "keys", "counts"])
            held.clear()

        for n, keys, counts in _unpacked(batches):
            keep = _is_full(full.value[n - 1], keys, n)
            held.setdefault(n, []).append((keys[keep], counts[keep]))
            size += int(keep.sum())
            if size >= SUM_KEYS:
                yield from emit()
                size = 0
        yield from emit()
        _give_back()
    return run


def _range_sums(least: int):
    """The keys of a range that were counted ``least`` times or more."""
    def run(t: pa.Table) -> pa.Table:
        k, c = _sum(*zip(*map(_unpack, t["keys"].to_pylist(), t["counts"].to_pylist())))
        keep = c >= least
        level = pa.array(np.full(int(keep.sum()), t["level"][0].as_py(), np.int8))
        return pa.table({"level": level, "k": pa.array(k[keep].view(np.int64)), "a": pa.array(c[keep])})
    return run


def _is_full(bits: bytes, keys: np.ndarray, level: int) -> np.ndarray:
    at = _buckets(keys, level)
    return (np.frombuffer(bits, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _names(rows: DataFrame, longest: int, full) -> DataFrame:
    """(level, lang, k, phrase, c): a name of every key whose bucket is full, and
    at level 0 the words of a language."""
    def run(batches):
        bits = full.value
        for lang, text in ((lang, part) for lang, data in _chunks(batches) for part in _cut(data)):
            keys, first, start, end = word_keys(text, lang)
            text = text.translate(_LOWER)
            yield _named(0, lang, np.zeros(1, np.uint64), [""], [len(keys)])
            for n, phrase, at in _levels(keys, first, longest):
                ok = _is_full(bits[n - 1], phrase, n)
                found, where = np.unique(phrase[ok], return_index=True)
                at = at[ok][where]
                names = [b" ".join(filter(None, text[s:e].replace(b"\t", b" ").split(b" "))).decode()
                         for s, e in zip(start[at].tolist(), end[at + n - 1].tolist())]
                if names:
                    yield _named(n, lang, found, names, np.zeros(len(names), np.int64))
            _give_back()

    return rows.mapInArrow(run, "level byte, lang string, k long, phrase string, c long")


def _named(level: int, lang: str, keys: np.ndarray, names: list[str], counts) -> pa.RecordBatch:
    n = len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, level, np.int8)), pa.array([lang] * n, pa.string()), pa.array(keys.view(np.int64)),
         pa.array(names, pa.string()), pa.array(np.asarray(counts, np.int64))], names=["level", "lang", "k", "phrase", "c"])


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, cover: int = 50, top: int | None = 2000,
                 shards: int = 3, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Collocations of ``docs``: lang, rank, phrase, a, l, r, n, score.

    A candidate (2 to ``longest`` words, ``least`` occurrences) is cut where its
    score floor(1,000,000 a a / (l r)) is lowest, the first such cut.  It goes if a
    longer candidate that contains it has ``cover`` per cent of its occurrences.
    ``top`` rows a language by score and a descending, then phrase (None: all,
    rank null)."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    with _small_batches(docs.sparkSession):
        found = cut_lineage(count_phrases(rows, longest, least, shards))
    words = F.split("phrase", " ")
    parts = found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cands = found.where("level > 1").withColumn("w", words)

    def text(frm, count):
        return F.array_join(F.slice("w", frm, count), " ")

    size = F.size("w")
    cuts = cands.select("lang", "level", "phrase", "a", "n", "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.select("lang", "level", "phrase", "a", "n", "cut", text(1, F.col("cut")).alias("head"),
                       text(F.col("cut") + 1, size - F.col("cut")).alias("tail"))
    cuts = (cuts.join(parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
            .join(parts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]))
    score = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)))"
                   " div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")       # decimals: products pass 64 bits
    best = cuts.withColumn("score", score).groupBy("lang", "level", "phrase", "a", "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    # every phrase inside a candidate that is shorter than it
    inner = cands.where("level > 2").select("lang", F.col("a").alias("over"), "w", F.explode(F.sequence(F.lit(2), size - 1)).alias("len"))
    inner = inner.select("lang", "over", "w", "len", F.explode(F.sequence(F.lit(1), size - F.col("len") + 1)).alias("at"))
    cover_by = inner.select("lang", text(F.col("at"), F.col("len")).alias("phrase"), "over").groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    kept = (best.join(cover_by, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("over") < F.lit(cover) * F.col("a"), F.lit(True)))
            .select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score"))
    if top is None:
        return kept.select("lang", F.lit(None).cast("int").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # two levels: a language's candidates are first cut to ``top`` in 64 parts
    part = Window.partitionBy("lang", "salt").orderBy(*order)
    few = (kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(part))
           .where(F.col("rank") <= top).drop("rank", "salt"))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
