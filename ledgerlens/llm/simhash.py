"""SimHash near-dedup with a bit-sliced comparison.

1. Every whole text becomes a 64-bit fingerprint: bit i is set when more than
   half of the XXH64 hashes of its word shingles have it set.
2. Distinct fingerprints within ``radius`` bits share at least
   ``blocks - radius`` of ``blocks`` equal bit blocks, so each one is filed
   under every combination of that many blocks; two that are close meet under
   at least one key.  A key with more than ``split_above`` fingerprints is
   refiled by the same rule on its remaining bits, which bounds a key's
   distinct fingerprints by 2^(bits left) - 65,536 with the defaults - however
   large a group of near copies is.
3. Under a key, fingerprints stand in blocks of 64 as vertical bit planes.  For
   each fingerprint the 64 distances to a block grow together: a carry-save
   counter takes one difference plane after the other, and a block is abandoned
   once all of its lanes exceed the radius.
4. Links found under a key are united there; only a star per local component
   leaves the task, so pairs within a group are never emitted.  Components of
   the stars come from distributed star contraction.

Exact copies share a fingerprint and count once from step 2 on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut_lineage, lookup_by_run
from ledgerlens.llm.components import connected_components

BITS = 64
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Fingerprint of one text (null or no word: 0).  A-Z are lower-cased, words
    are runs of anything but ASCII white space; a text of fewer than ``shingle``
    words is one shingle."""
    import xxhash

    # bytes.lower() and bytes.split() know ASCII only, as the definition asks
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return 0
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:n - shingle] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1:].tolist())]
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(len(hashes), 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(raw), 65_535):              # whole text, in steps that fit 16-bit sums
        ones += np.unpackbits(raw[at:at + 65_535], axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, uid_col: str | None = None) -> DataFrame:
    """(run, uid, doc_id, fp) for every row, written once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["uid", "doc_id", "fp"])

    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    uid = F.col(uid_col) if uid_col else F.monotonically_increasing_id()
    small = docs.select(uid.alias("uid"), F.col(id_col).alias("doc_id"),
                        F.col(text_col).cast("string").alias("text"))
    out = small.mapInArrow(run, f"uid long, doc_id {kind}, fp long")
    return cut_lineage(out.withColumn("run", F.spark_partition_id()))


def _bit_blocks(free: list[int], blocks: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(free), blocks)]


def _key(combo: tuple[int, ...], parts: list[list[int]], tag: int):
    """Key of one combination of equal blocks: its bits, packed, under a tag."""
    mask = sum(1 << b for i in combo for b in parts[i])
    mask -= 1 << 64 if mask >= 1 << 63 else 0
    return F.struct(F.lit(tag).cast("long").alias("tag"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits"))


def file_under_keys(fps: DataFrame, radius: int = 2, blocks: int = 4, split_above: int = 4096) -> DataFrame:
    """(tag, bits, fp) rows for every key that holds two fingerprints or more."""
    same = blocks - radius
    if radius < 1 or same < 1:
        raise ValueError("radius must be 1 at least and below the number of blocks")
    first = _bit_blocks(list(range(BITS)), blocks)
    combos = list(combinations(range(blocks), same))

    def counted(df: DataFrame) -> DataFrame:
        n = df.groupBy("tag", "bits").count().where("count > 1")
        return df.join(n, ["tag", "bits"])

    level = counted(fps.select("fp", F.explode(F.array(*[_key(c, first, t) for t, c in enumerate(combos)])).alias("k"))
                    .select("k.*", "fp"))
    small = level.where(F.col("count") <= split_above).select("tag", "bits", "fp")
    again = []
    for t, c in enumerate(combos):
        held = [b for i in c for b in first[i]]
        parts = _bit_blocks([b for b in range(BITS) if b not in held], blocks)
        again += [(t, _key(c2, [*parts, held], 100 + t * len(combos) + t2))
                  for t2, c2 in enumerate([(*c2, blocks) for c2 in combinations(range(blocks), same)])]
    big = level.where(F.col("count") > split_above).select(F.col("tag").alias("t"), "fp")
    refiled = (big.select("fp", "t", F.explode(F.array(*[F.when(F.col("t") == t, k) for t, k in again])).alias("k"))
               .where("k is not null").select("k.*", "fp"))
    return small.unionByName(counted(refiled).select("tag", "bits", "fp"))


def _planes(fps: np.ndarray) -> np.ndarray:
    """(blocks, 64) words: word b of a block holds bit b of its 64 fingerprints."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").reshape(-1, 64, 8).copy().view("<u8")[:, :, 0]


def close_lanes(query: np.ndarray, planes: np.ndarray, block: np.ndarray, lanes: np.ndarray,
                radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit-sliced distances of item i: query[i] against the 64 lanes of block[i].

    Returns the items that still have a lane within the radius after all
    planes, and the masks of those lanes.  ``width`` counter words hold each
    lane's distance in binary; adding one difference plane is a ripple of
    carry-saves, and a lane stays ``over`` once it passed the radius."""
    width = int(radius + 1).bit_length()
    limit = radius + 1
    items = np.arange(len(query))
    count = [np.zeros(len(query), np.uint64) for _ in range(width)]
    over = ~lanes[block]
    for bit in range(BITS):
        want = np.uint64(0) - ((query[items] >> np.uint64(bit)) & np.uint64(1))     # all ones when the bit is set
        carry = planes[block[items], bit] ^ want
        for w in range(width):
            count[w], carry = count[w] ^ carry, count[w] & carry
        over = over | carry
        hit = np.full(len(items), ALL)
        for w in range(width):
            hit &= count[w] if limit >> w & 1 else ~count[w]
        over |= hit
        if bit % 8 == 7:
            alive = over != ALL
            if not alive.all():                                                     # abandon whole blocks
                items, over = items[alive], over[alive]
                count = [c[alive] for c in count]
                if len(items) == 0:
                    break
    return items, ~over


def local_stars(keys: np.ndarray, fps: np.ndarray, radius: int, chunk: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """Links inside whole key groups (rows sorted by key), as (fp, smallest fp of
    its local component) for every row that is not the smallest itself."""
    n = len(fps)
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    per = -(-size // 64)                                        # blocks of each group
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    rank = np.arange(n) - start[group]
    slot = (first[group] + rank // 64) * 64 + rank % 64         # place among padded blocks
    total = int(per.sum()) * 64
    padded, row_of = np.zeros(total, "<u8"), np.full(total, -1)
    padded[slot], row_of[slot] = fps, np.arange(n)
    planes = _planes(padded)
    lanes = np.packbits((row_of >= 0).reshape(-1, 64), axis=1, bitorder="little").copy().view("<u8")[:, 0]
    label = np.arange(n)
    for lo, hi in _spans(per[group], chunk):
        reps = per[group[lo:hi]]
        row = np.repeat(np.arange(lo, hi), reps)
        block = first[group[row]] + np.arange(len(row)) - np.repeat(np.cumsum(reps) - reps, reps)
        items, masks = close_lanes(fps[row], planes, block, lanes, radius)
        for at in range(0, len(items), chunk):
            bits = np.unpackbits(masks[at:at + chunk, None].view(np.uint8), axis=1, bitorder="little")
            i, lane = np.nonzero(bits)
            i = items[at:at + chunk][i]
            _unite(label, row[i], row_of[block[i] * 64 + lane])
    low = fps.copy()
    np.minimum.at(low, label, fps)
    star = low[label]
    other = star != fps
    return fps[other], star[other]


def _spans(weights: np.ndarray, chunk: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``chunk`` items."""
    upto, lo = np.cumsum(weights), 0
    while lo < len(weights):
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + chunk, "right")))
        yield lo, hi
        lo = hi


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the components of a[i] and b[i]; labels are row numbers."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def links(filed: DataFrame, radius: int, batch_rows: int = 200_000) -> DataFrame:
    """Star edges (a, b) of the components that the keys' groups hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def flush(tag, bits, fp):
            order = np.lexsort((fp, bits, tag))                 # groups are whole; order inside them is ours
            tag, bits, fp = tag[order], bits[order], fp[order]
            change = np.concatenate([[False], (tag[1:] != tag[:-1]) | (bits[1:] != bits[:-1])])
            a, b = local_stars(np.cumsum(change), fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for x in batches:
            held.append(tuple(np.asarray(x.column(i).to_numpy(zero_copy_only=False)) for i in range(3)))
            rows += x.num_rows
            if rows >= batch_rows:                              # all groups but the last are complete
                tag, bits, fp = (np.concatenate(c) for c in zip(*held))
                last = (tag == tag[-1]) & (bits == bits[-1])
                if not last.all():
                    yield flush(tag[~last], bits[~last], fp[~last])
                held, rows = [(tag[last], bits[last], fp[last])], int(last.sum())
        if rows:
            yield flush(*(np.concatenate(c) for c in zip(*held)))

    dealt = filed.repartition("tag", "bits").sortWithinPartitions("tag", "bits")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2,
                   blocks: int = 4, split_above: int = 4096, uid_col: str | None = None) -> DataFrame:
    """(run, uid, doc_id, fp, root, component_id) for every row: the smallest
    identifier reachable over links of at most ``radius`` differing bits.
    Empty texts have fingerprint 0 and link like any other; a component whose
    identifiers are all null has a null component_id; repeated rows each get
    their row."""
    rows = fingerprints(docs, id_col, text_col, shingle, uid_col)
    fps = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = links(file_under_keys(fps.select("fp"), radius, blocks, split_above), radius)
    roots = connected_components(edges)                                             # node, root
    named = fps.join(roots, fps["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return lookup_by_run(rows, ["fp"], named.select("fp", "root").join(least, "root").select("fp", "root", "component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return simhash_groups(docs, id_col, text_col, **how).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
