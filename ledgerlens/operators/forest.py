"""Isolation forest on Spark (survey §2.5 E1–E4, §2.6 G10–G12).

Fit
    A row's number is its rank by (hash of its key, key, features), whatever the
    partitions.  Every tree draws min(ψ, n) different numbers, or ψ with replacement
    under bootstrap: T·ψ numbers, bounded by the parameters.  Counts over ``BUCKETS``
    ranges of the hash tell the ranges that hold drawn rows; only the rows of these
    are exchanged and ranked, the feature matrix is neither written nor exchanged.
    Where these ranges hold a large share of the table, only the hashes are exchanged
    and numbered; the scan then knows a drawn row by its hash, and rows that share a
    drawn hash are ranked.  A table with no more rows than draws is written in rank
    order instead, and a row's number is its file's offset (files in name order, from
    one count per file) plus its position in the file.  The drawn rows are broadcast
    to the tree tasks while they stay under ``SHIP_BYTES``; above that they are
    shuffled by tree.

Store
    A tree is a complete binary tree of its depth limit (node i has the children
    2i + 1 and 2i + 2), kept as three packed arrays: feature, threshold, path
    length of every bottom leaf.  A node that ends early hands its path length
    to all leaves below it.  One row per tree; ``nodes`` unpacks the real nodes.

Score
    Packed forests are broadcast (``STORE_BYTES`` at most in one pass) and one
    scan walks every row down all trees of all of them.  The same pass can
    report any prefix of a forest's trees, which serves the tree-count study
    (E4) and every search candidate that shares a forest (G10/G11).

Search
    Nothing per (row, forest) is written.  Scores fall into ``BINS`` equal bins; a
    look at some ``GUESS_ROWS`` training rows guesses the bins around every order
    statistic.  One scan of training and validation rows returns the values inside
    these bins and count, sum and sum of squares of the rest, from which offsets and
    separation scores follow exactly.  The counts tell whether a statistic lies
    outside its guess; then the training rows are counted in all bins and the scan
    is done again with the right ones.

Semantics follow the published algorithm as implemented in scikit-learn:
``max_samples='auto'`` = min(256, n); depth limit ceil(log2 ψ); random
feature, threshold uniform in the node's range, ``x <= t`` goes left;
path = depth + c(leaf size); score_samples = −2^(−E[h]/c(ψ)); offset = the
contamination percentile of the training scores; decision = score − offset;
anomaly when decision < 0.  Random draws differ from scikit-learn's, so
scores agree in distribution, not bit for bit.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.stats import unit_hash
from ledgerlens.session import TASK_ROWS, cut_lineage, shuffle_partitions, sized_partitions

EULER_GAMMA = 0.5772156649015329
#: rows walked down the trees at a time (their places must fit 16 bits); splits of a
#: level up to which it is walked by masks of all rows; rows that look up their node at a time
CHUNK, MASKS, LOOKUP = 1 << 15, 8, 1 << 13
#: rows of a tree at most; a share of a large table would not fit one task
MAX_PSI = 1 << 16
#: draws handed to one scan, packed nodes of one scoring pass, drawn rows that are broadcast
PASS_DRAWS, STORE_BYTES, SHIP_BYTES = 1 << 23, 1 << 28, 1 << 26
#: ranges of the key's hash; share of the rows in ranges with drawn rows above which hashes are exchanged instead of rows
BUCKETS, DENSE = 1 << 20, 0.1
#: training rows looked at before the scan, and the guess's half width in standard errors of a rank
GUESS_ROWS, GUESS_WIDTH = 100_000, 5.0
#: bins of the score range -1..0
BINS = 1 << 16

STORE_SCHEMA = T.StructType([
    T.StructField("forest", T.IntegerType()), T.StructField("tree", T.IntegerType()),
    T.StructField("depth", T.IntegerType()), T.StructField("n_samples", T.IntegerType()),
    T.StructField("feature", T.BinaryType()), T.StructField("threshold", T.BinaryType()),
    T.StructField("path", T.BinaryType()), T.StructField("sizes", T.BinaryType()),
    T.StructField("seconds", T.DoubleType()),
])
NODE_SCHEMA = T.StructType([
    T.StructField("forest", T.IntegerType()), T.StructField("tree", T.IntegerType()),
    T.StructField("node", T.IntegerType()), T.StructField("feature", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()), T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()), T.StructField("path", T.DoubleType()),
    T.StructField("n_samples", T.IntegerType()),
])


def average_path_length(n) -> np.ndarray:
    """c(n): expected path length of an unsuccessful BST search."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


@dataclass
class ForestSpec:
    """One forest: ``n_trees`` trees on ``max_samples`` rows each."""
    forest: int = 0
    n_trees: int = 200
    max_samples: int | str = "auto"
    max_features: float = 1.0
    bootstrap: bool = False
    seed: int = 42
    psi: int = field(default=0, init=False)
    rows: int = field(default=0, init=False)                 # of the table it was fitted on

    def resolve(self, n_rows: int) -> "ForestSpec":
        self.rows = n_rows
        if self.max_samples == "auto":
            psi = min(256, n_rows)
        elif isinstance(self.max_samples, float) and self.max_samples <= 1.0:
            psi = int(self.max_samples * n_rows)
        else:
            psi = min(int(self.max_samples), n_rows)
        if psi > MAX_PSI:
            raise ValueError(f"max_samples gives {psi} rows a tree; {MAX_PSI} at most")
        self.psi = max(psi, 1)
        if self.store_bytes > STORE_BYTES or self.n_trees * self.psi > PASS_DRAWS:
            raise ValueError(f"{self.n_trees} trees of {self.psi} rows are more than one pass holds")
        return self

    @property
    def depth(self) -> int:
        return int(math.ceil(math.log2(max(self.psi, 2))))

    @property
    def store_bytes(self) -> int:
        return self.n_trees * (18 << self.depth)


# ---------------------------------------------------------------- draws
def _numbered_files(written: DataFrame) -> tuple[list[str], np.ndarray]:
    """The files of a written table in name order and the number of their first
    row; the last entry is the number of rows."""
    rows = written.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted((r["f"], r["n"]) for r in rows)
    return [f for f, _ in rows], np.concatenate([[0], np.cumsum([n for _, n in rows])]).astype(np.int64)


def draw_rows(spec: ForestSpec, tree: int, n_rows: int) -> np.ndarray:
    """The row numbers of a tree: min(ψ, n) different ones, or ψ independent
    ones under bootstrap."""
    rng = np.random.default_rng([spec.seed, spec.forest, tree, 0])
    return (rng.integers(0, n_rows, spec.psi) if spec.bootstrap
            else rng.choice(n_rows, spec.psi, replace=False, shuffle=False))


def _drawn(written: DataFrame, features: Sequence[str], numbers: np.ndarray, files: list[str], base: np.ndarray) -> DataFrame:
    """(number, x): the rows with these numbers (sorted, distinct), in one scan
    without an exchange.  x: the features as packed doubles."""
    bc = written.sparkSession.sparkContext.broadcast((dict(zip(files, base.tolist())), numbers))
    d = len(features)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, wanted = bc.value
        for b in batches:
            name = b.column(0).dictionary_encode()
            number = np.array([start[f] for f in name.dictionary.to_pylist()])[name.indices.to_numpy()] + b.column(1).to_numpy()
            at = np.searchsorted(wanted, number)
            keep = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == number)
            if len(keep):
                x = np.stack([b.column(2 + i).to_numpy(zero_copy_only=False)[keep] for i in range(d)], axis=1).astype("<f8")
                yield pa.RecordBatch.from_arrays([pa.array(number[keep]), pa.array([r.tobytes() for r in x], pa.binary())],
                                                 names=["number", "x"])

    rows = written.select(F.col("_metadata.file_name").alias("_f"), F.col("_metadata.row_index").alias("_r"),
                          *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    return rows.mapInArrow(pick, "number long, x binary")


# ---------------------------------------------------------------- trees
def grow(x: np.ndarray, rng: np.random.Generator, feats: np.ndarray, depth: int
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grow one isolation tree level by level: (feature, threshold) of the 2^depth − 1
    inner places, the path length of the 2^depth leaves and the number of rows of
    every place.  All nodes of a level are split at once."""
    inner = (1 << depth) - 1
    feature, threshold = np.full(inner, -1, np.int16), np.full(inner, np.inf)
    path, sizes = np.zeros(inner + 1), np.zeros(2 * inner + 1, np.int32)
    xs, place = x[:, feats], np.zeros(len(x), np.int64)

    def end(places: np.ndarray, n: np.ndarray, level: int) -> None:
        span = 1 << (depth - level)                          # leaves below a place of this level
        first = (places + 1) * span - (1 << depth)
        at = (first[:, None] + np.arange(span)).ravel()
        path[at] = np.repeat(level + average_path_length(n), span)

    for level in range(depth + 1):
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        n = np.diff(np.append(starts, len(place)))
        here = place[starts]
        sizes[here] = n
        if level == depth:
            end(here, n, level)
            break
        lo, hi = np.minimum.reduceat(xs, starts, axis=0), np.maximum.reduceat(xs, starts, axis=0)
        usable = hi > lo
        count = usable.sum(1)
        split = (n > 1) & (count > 0)
        end(here[~split], n[~split], level)
        if not split.any():
            break
        u = rng.random((2, len(here)))
        nth = np.minimum((u[0] * count).astype(np.int64), count - 1)
        j = (np.cumsum(usable, axis=1) > nth[:, None]).argmax(1)
        at = np.arange(len(here))
        low, high = lo[at, j], hi[at, j]
        cut = np.minimum(low + u[1] * (high - low), np.nextafter(high, low))
        feature[here[split]], threshold[here[split]] = feats[j[split]], cut[split]
        group = np.repeat(at, n)
        live = split[group]
        right = ~(xs[np.arange(len(xs)), j[group]] <= cut[group])
        place = (2 * place + 1 + right)[live]
        order = np.argsort(place, kind="stable")
        xs, place = xs[live][order], place[order]
    return feature, threshold, path, sizes


def _tree_row(spec: ForestSpec, tree: int, x: np.ndarray) -> tuple:
    """One packed tree from its ψ rows, in the order they were drawn."""
    if len(x) != spec.psi:
        raise ValueError(f"tree {tree} of forest {spec.forest} got {len(x)} of {spec.psi} rows")
    began = time.perf_counter()
    rng = np.random.default_rng([spec.seed, spec.forest, tree, 1])
    d = x.shape[1]
    k = max(1, int(spec.max_features * d)) if isinstance(spec.max_features, float) else int(spec.max_features)
    feats = np.sort(rng.choice(d, size=min(k, d), replace=False))
    feature, threshold, path, sizes = grow(x, rng, feats, spec.depth)
    return (spec.forest, tree, spec.depth, len(x), feature.astype("<i2").tobytes(), threshold.astype("<f8").tobytes(),
            path.astype("<f8").tobytes(), sizes.astype("<i4").tobytes(), time.perf_counter() - began)


def _trees(spark, specs: Sequence[ForestSpec]) -> DataFrame:
    """(forest, tree), dealt out evenly."""
    ids = spark.createDataFrame([(s.forest, s.n_trees) for s in specs], "forest int, n int").select(
        "forest", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("tree"))
    return ids.repartition(max(shuffle_partitions(spark), 8))


def _ranked(hashed: DataFrame, features: Sequence[str], numbers: np.ndarray, groups: np.ndarray, first: np.ndarray, by: str = "_b") -> DataFrame:
    """(number, x) like ``_drawn``, from the rows whose ``by`` (range or hash) is of the
    groups that hold these numbers; ``first`` is the number of a group's first row."""
    spark, d = hashed.sparkSession, len(features)
    at = np.unique(np.searchsorted(first, numbers, "right") - 1)
    near = spark.createDataFrame(pa.table({by: groups[at], "_first": first[at]}))
    asked = spark.createDataFrame(pa.table({"number": numbers}))
    w = Window.partitionBy(by).orderBy("_h", "_k", *[f"_x{i}" for i in range(d)])            # some 1 / BUCKETS of the rows
    rows = hashed.join(F.broadcast(near), by).withColumn("number", F.col("_first") + F.row_number().over(w) - 1)
    rows = rows.join(F.broadcast(asked), "number", "left_semi")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, 1).astype("<f8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["number", "x"])

    return rows.select("number", *[f"_x{i}" for i in range(d)]).mapInArrow(pack, "number long, x binary")


def _numbered_hashes(hashed: DataFrame, buckets: np.ndarray, first: np.ndarray) -> DataFrame:
    """(_h, _first, _c): the distinct hashes with the number of their first row and their
    rows.  Written: the hashes alone are exchanged, 8 bytes a row and no feature."""
    spark = hashed.sparkSession
    spread = hashed.select("_b", "_h").repartition(max(shuffle_partitions(spark), -(-int(first[-1]) // TASK_ROWS)), "_b")
    w = Window.partitionBy("_b").orderBy("_h").rowsBetween(Window.unboundedPreceding, Window.currentRow)     # some 1 / BUCKETS of the rows
    counts = spread.groupBy("_b", "_h").agg(F.count(F.lit(1)).alias("_c")).select("_b", "_h", "_c", (F.sum("_c").over(w) - F.col("_c")).alias("_at"))
    bc = spark.sparkContext.broadcast((buckets, first))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, first = bc.value
        for b in batches:
            start = first[np.searchsorted(buckets, b.column(0).to_numpy())] + b.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(start), b.column(2)], names=["_h", "_first", "_c"])

    return cut_lineage(counts.mapInArrow(number, "_h double, _first long, _c long"))


def _by_hash(hashed: DataFrame, features: Sequence[str], numbers: np.ndarray, numbered: DataFrame) -> DataFrame:
    """(number, x) like ``_drawn``: the scan keeps the rows whose hash is a drawn one's;
    only rows that share their hash with others are exchanged and ranked."""
    spark, d = hashed.sparkSession, len(features)
    asked = spark.sparkContext.broadcast(numbers)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start = b.column(1).to_numpy()
            lo, hi = np.searchsorted(asked.value, start), np.searchsorted(asked.value, start + b.column(2).to_numpy())
            yield b.filter(pa.array(hi > lo))

    near = numbered.mapInArrow(drawn, numbered.schema).toArrow().sort_by("_h")                # a row a number at most
    h, first, c = (near[n].to_numpy() for n in ("_h", "_first", "_c"))
    asked.unpersist()
    alone = c == 1
    bc = spark.sparkContext.broadcast((h[alone], first[alone]))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, number = bc.value
        for b in batches:
            mine = b.column(0).to_numpy()
            at = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
            keep = np.flatnonzero(wanted[at] == mine)
            if len(keep):
                x = _matrix(b.take(pa.array(keep)), 1).astype("<f8")
                yield pa.RecordBatch.from_arrays([pa.array(number[at[keep]]), pa.array([r.tobytes() for r in x], pa.binary())],
                                                 names=["number", "x"])

    parts = []
    if alone.any():
        parts.append(hashed.select("_h", *[f"_x{i}" for i in range(d)]).mapInArrow(pick, "number long, x binary"))
    if not alone.all():
        # numbers of rows that share a hash
        h, first, c = h[~alone], first[~alone], c[~alone]
        by = np.argsort(first)
        at = np.searchsorted(first[by], numbers, "right") - 1
        shared = numbers[(at >= 0) & (numbers < first[by][at] + c[by][at])]
        parts.append(_ranked(hashed, features, shared, h[by], first[by], "_h"))
    return _union(parts)


def _picker(df: DataFrame, key: str, features: Sequence[str], specs: Sequence[ForestSpec]):
    """(number of rows, function numbers -> DataFrame (number, x)); resolves the forests."""
    hashed = df.select(unit_hash(key).alias("_h"), F.col(key).alias("_k"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    hashed = hashed.withColumn("_b", F.floor(F.col("_h") * BUCKETS).cast("long"))
    counted = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("c")).toArrow().sort_by("_b")          # BUCKETS rows at most
    buckets, ends = counted["_b"].to_numpy(), np.cumsum(counted["c"].to_numpy(), dtype=np.int64)
    n_rows = int(ends[-1]) if len(ends) else 0
    if n_rows == 0:
        raise ValueError("a forest needs training rows")
    for s in specs:
        s.resolve(n_rows)
    first = np.concatenate([[0], ends[:-1]])
    held = np.zeros(len(ends), bool)
    for s in specs:
        for t in range(s.n_trees):
            held[np.searchsorted(ends, draw_rows(s, t, n_rows), "right")] = True
    if (ends - first)[held].sum() <= DENSE * n_rows:
        return n_rows, lambda numbers: _ranked(hashed, features, numbers, buckets, first)
    if n_rows > sum(s.n_trees * s.psi for s in specs):
        numbered = _numbered_hashes(hashed, buckets, first)
        return n_rows, lambda numbers: _by_hash(hashed, features, numbers, numbered)
    order = ["_h", "_k", *[f"_x{i}" for i in range(len(features))]]
    ordered = hashed.repartitionByRange(sized_partitions(df.sparkSession, df), *order).sortWithinPartitions(*order)
    written = cut_lineage(ordered.select(*[F.col(f"_x{i}").alias(c) for i, c in enumerate(features)]))
    files, base = _numbered_files(written)
    return n_rows, lambda numbers: _drawn(written, features, numbers, files, base)


def _fit_pass(spark, features: Sequence[str], specs: Sequence[ForestSpec], n_rows: int, pick) -> DataFrame:
    """Packed trees of the forests of one pass."""
    by_id = {s.forest: s for s in specs}
    draws = [(s, t, draw_rows(s, t, n_rows)) for s in specs for t in range(s.n_trees)]
    numbers = np.unique(np.concatenate([d for _, _, d in draws]))
    rows = pick(numbers)
    if len(numbers) * 8 * len(features) <= SHIP_BYTES:
        got = rows.toArrow().sort_by("number")
        if len(got) != len(numbers):
            raise ValueError(f"{len(got)} of {len(numbers)} drawn rows were found")
        x = np.frombuffer(b"".join(got["x"].to_pylist()), "<f8").reshape(len(got), len(features))
        bc = spark.sparkContext.broadcast((numbers, x))

        def build(batches):
            numbers, x = bc.value
            for b in batches:
                out = []
                for forest, tree in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    s = by_id[forest]
                    out.append(_tree_row(s, tree, x[np.searchsorted(numbers, draw_rows(s, tree, n_rows))]))
                yield _store_batch(out)

        return _trees(spark, specs).mapInArrow(build, STORE_SCHEMA)
    # every draw of a row as (forest, tree, slot): the rows go to their trees
    flat = np.concatenate([d for _, _, d in draws])
    order = np.argsort(flat, kind="stable")
    owner = np.concatenate([np.full(len(d), i, np.int32) for i, (_, _, d) in enumerate(draws)])[order]
    slot = np.concatenate([np.arange(len(d), dtype=np.int32) for _, _, d in draws])[order]
    ids = np.array([(s.forest, t) for s, t, _ in draws], np.int32)
    bc = spark.sparkContext.broadcast((flat[order], owner, slot, ids))

    def deal(batches):
        flat, owner, slot, ids = bc.value
        for b in batches:
            number = b.column(0).to_numpy()
            lo, hi = np.searchsorted(flat, number, "left"), np.searchsorted(flat, number, "right")
            src = np.repeat(np.arange(len(number)), hi - lo)
            at = np.concatenate([np.arange(a, z) for a, z in zip(lo, hi)]) if len(src) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner[at], 0]), pa.array(ids[owner[at], 1]), pa.array(slot[at]),
                                              b.column(1).take(pa.array(src))], names=["forest", "tree", "slot", "x"])

    def build_group(t: pa.Table) -> pa.Table:
        spec, tree = by_id[t["forest"][0].as_py()], t["tree"][0].as_py()
        t = t.sort_by("slot")                                # shuffle order must not matter
        x = np.frombuffer(b"".join(t["x"].to_pylist()), "<f8").reshape(len(t), -1)
        return pa.Table.from_batches([_store_batch([_tree_row(spec, tree, x)])])

    dealt = rows.mapInArrow(deal, "forest int, tree int, slot int, x binary")
    return dealt.groupBy("forest", "tree").applyInArrow(build_group, STORE_SCHEMA)


def _store_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 4 + [pa.binary()] * 4 + [pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=STORE_SCHEMA.fieldNames())


def _passes(specs: Sequence[ForestSpec], cost, most: int) -> Iterator[list[ForestSpec]]:
    """Forests in order, as many a pass as ``most`` allows."""
    held, total = [], 0
    for s in specs:
        if held and total + cost(s) > most:
            yield held
            held, total = [], 0
        held.append(s)
        total += cost(s)
    if held:
        yield held


def fit_forests(df: DataFrame, key: str, features: Sequence[str], specs: Sequence[ForestSpec]) -> DataFrame:
    """Fit one or more forests; returns the written store (one row per tree)."""
    if [s.forest for s in specs] != list(range(len(specs))):
        raise ValueError("forest ids must be 0..k-1 in order")
    n_rows, pick = _picker(df, key, features, specs)
    parts = [_fit_pass(df.sparkSession, features, p, n_rows, pick) for p in _passes(specs, lambda s: s.n_trees * s.psi, PASS_DRAWS)]
    store = cut_lineage(_union(parts))
    built, wanted = store.count(), sum(s.n_trees for s in specs)
    if built != wanted:
        raise ValueError(f"{built} of {wanted} trees were built")
    return store


def unpack_nodes(store: DataFrame) -> DataFrame:
    """The node table of a store: the places rows have reached, numbered from 0."""
    def run(batches):
        for b in batches:
            for forest, tree, depth, _, feature, threshold, path, sizes, _ in zip(*[c.to_pylist() for c in b.columns]):
                feature, threshold = np.frombuffer(feature, "<i2"), np.frombuffer(threshold, "<f8")
                path, sizes = np.frombuffer(path, "<f8"), np.frombuffer(sizes, "<i4")
                at = np.flatnonzero(sizes)
                inner = at < len(feature)
                f = np.where(inner, feature[np.where(inner, at, 0)], -1)
                number = np.full(len(sizes) + 2, -1)
                number[at] = np.arange(len(at))
                level = np.floor(np.log2(at + 1)).astype(int)
                leaf = ((at + 1) << (depth - level)) - (1 << depth)
                split = f >= 0
                kids = np.where(split, 2 * at + 1, len(sizes))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (
                    np.full(len(at), forest, np.int32), np.full(len(at), tree, np.int32), number[at].astype(np.int32), f.astype(np.int32),
                    np.where(split, threshold[np.where(split, at, 0)], 0.0), number[kids].astype(np.int32),
                    number[np.where(split, kids + 1, len(sizes))].astype(np.int32), np.where(split, 0.0, path[leaf]), sizes[at])],
                    names=NODE_SCHEMA.fieldNames())

    return store.mapInArrow(run, NODE_SCHEMA)


@dataclass
class ForestModel:
    """A fitted forest: store + parameters (+ offset once calibrated)."""
    store: DataFrame
    features: list[str]
    spec: ForestSpec
    contamination: float = 0.05
    offset: float | None = None

    @property
    def nodes(self) -> DataFrame:
        return unpack_nodes(self.store.where(F.col("forest") == self.spec.forest))


# ---------------------------------------------------------------- scores
def packed(store: DataFrame, spec: ForestSpec, n_trees: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(depth, feature, threshold, path) of the first trees of a forest, one row
    per tree: at most ``STORE_BYTES``, checked when the forest was resolved."""
    rows = store.where((F.col("forest") == spec.forest) & (F.col("tree") < n_trees)).orderBy("tree").select(
        "feature", "threshold", "path").toArrow()
    if len(rows) != n_trees:
        raise ValueError(f"{len(rows)} of {n_trees} trees in the store")
    kinds = {"feature": "<i2", "threshold": "<f8", "path": "<f8"}
    return (spec.depth, *[np.frombuffer(b"".join(rows[c].to_pylist()), k).reshape(n_trees, -1) for c, k in kinds.items()])


def ordered(x: np.ndarray) -> list[tuple]:
    """For every ``CHUNK`` rows: the first row, each row's place in the order of every
    feature [features, rows] (NaN last) and the features' values in that order.  Serves
    all forests: ``x <= t`` is ``place < number of values <= t``."""
    out = []
    for lo in range(0, len(x), CHUNK):
        part = x[lo:lo + CHUNK]
        place, values = np.empty((x.shape[1], len(part)), np.uint16), []
        for j in range(x.shape[1]):
            column = np.ascontiguousarray(part[:, j])
            by = np.argsort(column)
            place[j, by] = np.arange(len(part), dtype=np.uint16)
            values.append(column[by])
        out.append((lo, place, values))
    return out


def _cuts(feature: np.ndarray, threshold: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """The number of values at or below every node's threshold; all of them where a node has no split."""
    kinds = feature.ravel()
    by = np.argsort(kinds, kind="stable")
    ends = np.searchsorted(kinds[by], np.arange(len(values) + 1))
    cut = np.full(kinds.size, len(values[0]), np.uint16)
    for j, column in enumerate(values):
        mine = by[ends[j]:ends[j + 1]]
        cut[mine] = np.searchsorted(column, threshold.ravel()[mine], "right")
    return cut.reshape(feature.shape)


def _top(place: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int, masks: np.ndarray) -> tuple[int, np.ndarray]:
    """The first levels of a tree, which have few splits: (their number, every row's
    place on the next level).  A split compares all rows and keeps those that reach it."""
    at, right = np.zeros(place.shape[1], np.uint8), np.empty(place.shape[1], np.uint8)
    free, reach, level = list(range(1, len(masks))), {0: 0}, 0
    masks[0] = 1
    while level < depth:
        first = (1 << level) - 1
        live = [q for q in reach if feature[first + q] >= 0]
        if len(live) > MASKS:
            break
        right.fill(0)
        below = {}
        for q in live:
            up, new = reach[q], free.pop()
            np.greater_equal(place[feature[first + q]], cut[first + q], out=masks[new].view(bool))
            masks[new] &= masks[up]
            masks[up] ^= masks[new]
            right |= masks[new]
            below[2 * q], below[2 * q + 1] = up, new
        free += [m for q, m in reach.items() if q not in live]
        at += at
        at += right
        reach, level = below, level + 1
        if level == 8:                                       # a place fits 8 bits no longer
            break
    return level, at


def walk(x: np.ndarray, forest: tuple, counts: Sequence[int], order: list[tuple] | None = None) -> np.ndarray:
    """Sum of the path lengths over the first k trees for each k of ``counts``
    (ascending): array [rows, counts].  ``order``: ``ordered(x)`` if known.  Rows go
    down a tree together, one level a step; a place without a split leads to equal
    leaves either way."""
    depth, feature, threshold, path = forest
    out, d = np.empty((len(x), len(counts))), x.shape[1]
    offset = np.maximum(feature, 0).astype(np.intp)
    masks = np.empty((4 * MASKS, min(len(x), CHUNK)), np.uint8)
    index, go, length = np.empty(LOOKUP, np.intp), np.empty(LOOKUP, bool), np.empty(LOOKUP)
    mine, limit = np.empty(LOOKUP, np.uint16), np.empty(LOOKUP, np.uint16)
    for lo, place, values in ordered(x) if order is None else order:
        n = place.shape[1]
        cut = _cuts(feature[:counts[-1]], threshold[:counts[-1]], values)
        by_row, row = np.ascontiguousarray(place.T).ravel(), np.arange(n) * d
        total, done = np.zeros(n), 0
        for i, k in enumerate(counts):
            for t in range(done, k):
                level, top = _top(place, feature[t], cut[t], depth, masks[:, :n])
                for a in range(0, n, LOOKUP):
                    z = min(a + LOOKUP, n)
                    at, w, m, c, right = top[a:z].astype(np.intp), index[:z - a], mine[:z - a], limit[:z - a], go[:z - a]
                    for step in range(level, depth):
                        nodes = slice((1 << step) - 1, (2 << step) - 1)
                        offset[t, nodes].take(at, out=w, mode="clip")
                        w += row[a:z]
                        by_row.take(w, out=m, mode="clip")
                        cut[t, nodes].take(at, out=c, mode="clip")
                        np.greater_equal(m, c, out=right)
                        at += at
                        at += right
                    path[t].take(at, out=length[:z - a], mode="clip")
                    total[a:z] += length[:z - a]
            done = k
            out[lo:lo + n, i] = total
    return out


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of some ``CHUNK`` rows, which a walk needs to be fast."""
    held, n = [], 0
    for b in batches:
        if held and n + len(b) > CHUNK:
            yield pa.concat_batches(held)
            held, n = [], 0
        held.append(b)
        n += len(b)
    if held:
        yield pa.concat_batches(held)


def _to_score(total: np.ndarray, k: int, c_psi: float) -> np.ndarray:
    return -np.power(2.0, -(total / k) / c_psi) if c_psi > 0 else -np.ones(len(total))


def raw_scores(df: DataFrame, key: str, store: DataFrame, features: Sequence[str], spec: ForestSpec,
               prefixes: Sequence[int] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``score_samples`` (−2^(−E[h]/c(ψ))) for the first k trees, for
    each k in ``prefixes`` (default: all trees), in one pass.  Output: key,
    ``keep`` columns, ``raw_score_<k>``."""
    prefixes = sorted(prefixes or [spec.n_trees])
    bc = df.sparkSession.sparkContext.broadcast(packed(store, spec, prefixes[-1]))
    c_psi = float(average_path_length([spec.psi])[0])
    feats = list(features)
    carried = [key, *keep]

    def score(batches):
        for b in _batched(batches):
            x = np.stack([b.column(len(carried) + i).to_numpy(zero_copy_only=False) for i in range(len(feats))], axis=1).astype(float)
            total = walk(x, bc.value, prefixes)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(carried)], *[pa.array(_to_score(total[:, i], k, c_psi))
                                                                           for i, k in enumerate(prefixes)]], names=names)

    schema = T.StructType([df.schema[c] for c in carried] + [T.StructField(f"raw_score_{k}", T.DoubleType()) for k in prefixes])
    names = schema.fieldNames()
    return df.select(*carried, *[F.col(c).cast("double").alias(c) for c in feats]).mapInArrow(score, schema)


@dataclass
class Group:
    """The first ``n_trees`` trees of a forest and the contaminations asked of it."""
    spec: ForestSpec
    n_trees: int
    contaminations: list[float]


def _group_scores(store: DataFrame, groups: Sequence[Group]) -> Iterator[tuple[list[int], object, object]]:
    """For each pass: numbers of its groups, a broadcast of its forests and a
    function x -> scores [rows, groups of the pass]."""
    specs = {g.spec.forest: g.spec for g in groups}
    for part in _passes([specs[f] for f in sorted(specs)], lambda s: s.store_bytes, STORE_BYTES):
        plan, ids = [], []
        for s in part:
            mine = sorted((g.n_trees, i) for i, g in enumerate(groups) if g.spec.forest == s.forest)
            plan.append((packed(store, s, mine[-1][0]), [k for k, _ in mine], float(average_path_length([s.psi])[0])))
            ids += [i for _, i in mine]
        bc = store.sparkSession.sparkContext.broadcast(plan)

        def scores(x, bc=bc):
            cols, order = [], ordered(x)
            for forest, counts, c_psi in bc.value:
                total = walk(x, forest, counts, order)
                cols += [_to_score(total[:, i], k, c_psi) for i, k in enumerate(counts)]
            return np.stack(cols, axis=1)

        yield ids, bc, scores


def _bin(raw: np.ndarray) -> np.ndarray:
    """Bin of a score in -1..0, ascending."""
    return np.clip(((raw + 1.0) * BINS).astype(np.int64), 0, BINS - 1)


def _matrix(b: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[first:]], axis=1).astype(float)


@dataclass
class Judged:
    """Rows on one side of an offset: number, mean and population variance of
    their decision scores."""
    n: int = 0
    mean: float | None = None
    var: float | None = None


@dataclass
class Slot:
    """One contamination of a group: its offset and, per judged table, the rows
    at or above it, those below it and those whose score is no number."""
    offset: float
    normal: list[Judged]
    anomaly: list[Judged]
    bad: list[int]


def evaluate_groups(train: DataFrame, judged: Sequence[DataFrame], features: Sequence[str], store: DataFrame,
                    groups: Sequence[Group]) -> list[list[Slot]]:
    """For every group and contamination: the offset (the contamination quantile of
    the training scores, linear) and the judged tables' rows on either side of it.
    Exact, in one scan after a bounded look whatever the number of forests (see the
    module); more only if a guess failed or the packed forests exceed
    ``STORE_BYTES``."""
    cols = [F.col(c).cast("double").alias(c) for c in features]
    out: list[list[Slot]] = [[] for _ in groups]
    n_train = groups[0].spec.rows or train.count()           # decides the look alone
    for ids, bc, scores in _group_scores(store, groups):
        def bins(rows: DataFrame) -> np.ndarray:
            counted = rows.select(*cols).mapInArrow(_count_bins(scores, len(ids)), "g int, bin int, c long")
            table = counted.groupBy("g", "bin").agg(F.sum("c").alias("c")).toArrow()     # groups x BINS rows at most
            hist = np.zeros((len(ids), BINS), np.int64)
            hist[table["g"].to_numpy(), table["bin"].to_numpy()] = table["c"].to_numpy()
            return hist

        def look(wanted: list[np.ndarray]) -> DataFrame:
            parts = [train, *judged]
            both = _union([p.select(F.lit(k).alias("_part"), *cols) for k, p in enumerate(parts)])
            seen = both.mapInArrow(_look(scores, wanted, len(parts)), "g int, part int, rest int, v double, c long, s double, q double")
            return cut_lineage(seen.groupBy("g", "part", "rest", "v").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("q").alias("q")))

        shares = [groups[g].contaminations for g in ids]
        few = train if n_train <= GUESS_ROWS else train.sample(GUESS_ROWS / n_train, 42)
        wanted = [_bins_around(h, s, n_train <= GUESS_ROWS) for h, s in zip(bins(few), shares)]
        seen = look(wanted)
        counts = _train_counts(seen, wanted)
        if any(any(not _inside(c, w, s) for s in mine) for c, w, mine in zip(counts, wanted, shares)):
            wanted = [_bins_around(h, s, True) for h, s in zip(bins(train), shares)]
            seen = look(wanted)
            counts = _train_counts(seen, wanted)
        bc.unpersist()
        asked = []
        for i, (c, w, mine) in enumerate(zip(counts, wanted, shares)):
            for j, share in enumerate(mine):
                asked += [(i, j, which, *_place(c, w, q)) for which, q in enumerate(_ends(c, share))]
        edges = _order_statistics(seen, asked)
        for i, g in enumerate(ids):
            for j, share in enumerate(groups[g].contaminations):
                a, z = edges[i, j, 0], edges[i, j, 1]
                pos = (int(counts[i].sum()) - 1) * share
                d = pos - math.floor(pos)
                out[g].append(Slot(a + (z - a) * d if d < 0.5 else a * (1 - d) + z * d, [Judged() for _ in judged],
                                   [Judged() for _ in judged], [0] * len(judged)))
        if judged:
            _fold(seen, ids, wanted, out)
    return out


def _count_bins(scores, n_groups: int):
    def run(batches):
        held = np.zeros((n_groups, BINS), np.int64)
        for b in _batched(batches):
            raw = scores(_matrix(b, 0))
            for i in range(n_groups):
                held[i] += np.bincount(_bin(raw[~np.isnan(raw[:, i]), i]), minlength=BINS)
        g, at = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(held[g, at])],
                                         names=["g", "bin", "c"])
    return run


def _bins_around(hist: np.ndarray, shares: Sequence[float], exact: bool) -> np.ndarray:
    """The bins that hold, or in a sample's judgement surround, the quantiles of these shares."""
    cum, out = np.cumsum(hist), [np.zeros(1, np.int64)]
    n = int(cum[-1])
    for share in shares if n else ():
        slack = 0.0 if exact else GUESS_WIDTH * math.sqrt(max(share * (1 - share) * n, 1.0)) + 1
        pos = (n - 1) * share
        lo, hi = (int(np.searchsorted(cum, min(max(q, 0), n - 1), "right")) for q in (math.floor(pos - slack), math.ceil(pos + slack)))
        out.append(np.arange(lo, hi + 1))                    # the offset lies in one of these
    return np.unique(np.concatenate(out[1:] or out))


def _train_counts(seen: DataFrame, wanted: list[np.ndarray]) -> list[np.ndarray]:
    """Training rows of a group in the gaps before its wanted bins, in these bins and
    after them: gap, bin, gap, bin, ..., gap."""
    at = F.when(F.col("rest") == -1, F.least(F.floor((F.col("v") + 1.0) * BINS).cast("int"), F.lit(BINS - 1))).otherwise(F.lit(None))
    table = seen.where("part = 0 AND rest >= -1").groupBy("g", "rest", at.alias("bin")).agg(F.sum("c").alias("c")).toArrow().to_pylist()
    counts = [np.zeros(2 * len(w) + 1, np.int64) for w in wanted]
    for r in table:                                          # two rows a wanted bin at most
        w = wanted[r["g"]]
        counts[r["g"]][2 * r["rest"] if r["rest"] >= 0 else 2 * int(np.searchsorted(w, r["bin"])) + 1] += r["c"]
    return counts


def _ends(counts: np.ndarray, share: float) -> tuple[int, int]:
    """The two positions a quantile lies between."""
    pos = (int(counts.sum()) - 1) * share
    return math.floor(pos), math.ceil(pos)


def _place(counts: np.ndarray, wanted: np.ndarray, position: int) -> tuple[int, int]:
    """(bin, position inside it) of a training score; bin -1 in a gap."""
    cum = np.cumsum(counts)
    at = int(np.searchsorted(cum, position, "right"))
    return (int(wanted[at // 2]) if at % 2 else -1), position - int(cum[at - 1] if at else 0)


def _inside(counts: np.ndarray, wanted: np.ndarray, share: float) -> bool:
    return counts.sum() > 0 and all(_place(counts, wanted, q)[0] >= 0 for q in _ends(counts, share))


def _look(scores, wanted: list[np.ndarray], n_parts: int):
    """Rows of the second scan: (v, c) for the values inside the wanted bins
    (rest -1); count, sum and sum of squares of the rows before the rest-th wanted
    bin; count of scores that are no numbers (rest -2)."""
    def run(batches):
        inside: dict[tuple, int] = {}
        rest = [[np.zeros((len(w) + 1, 3)) for w in wanted] for _ in range(n_parts)]
        bad = np.zeros((n_parts, len(wanted)), np.int64)
        for b in _batched(batches):
            raw, part = scores(_matrix(b, 1)), b.column(0).to_numpy()
            for p in np.unique(part).tolist():
                mine = raw[part == p]
                for i, w in enumerate(wanted):
                    r = mine[:, i]
                    bad[p, i] += int(np.isnan(r).sum())
                    r = r[~np.isnan(r)]
                    at = _bin(r)
                    side = np.searchsorted(w, at)
                    hit = w[np.minimum(side, len(w) - 1)] == at
                    for v, c in zip(*[a.tolist() for a in np.unique(r[hit], return_counts=True)]):
                        inside[i, p, v] = inside.get((i, p, v), 0) + c
                    side, v = side[~hit], r[~hit]
                    for k, weight in enumerate((None, v, v * v) if p else (None,)):
                        rest[p][i][:, k] += np.bincount(side, weight, len(w) + 1)
        rows = [(i, p, -1, v, c, 0.0, 0.0) for (i, p, v), c in inside.items()]
        for p in range(n_parts):
            for i in range(len(wanted)):
                rows += [(i, p, k, 0.0, int(x[0]), x[1], x[2]) for k, x in enumerate(rest[p][i].tolist()) if x[0]]
                if bad[p, i]:
                    rows.append((i, p, -2, 0.0, int(bad[p, i]), 0.0, 0.0))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                                         names=["g", "part", "rest", "v", "c", "s", "q"])
    return run


def _order_statistics(seen: DataFrame, asked: list[tuple]) -> dict[tuple, float]:
    """(group, contamination, end) -> value at a position of the training scores."""
    want = seen.sparkSession.createDataFrame(asked, "g int, j int, which int, bin int, pos long")    # two rows a slot
    inside = seen.where("part = 0 AND rest = -1").withColumn("bin", F.least(F.floor((F.col("v") + 1.0) * BINS).cast("int"), F.lit(BINS - 1)))
    w = Window.partitionBy("g", "bin").orderBy("v")          # the distinct values inside one bin
    ranked = inside.select("g", "bin", "v", "c", F.sum("c").over(w).alias("cum"))
    hit = ranked.join(F.broadcast(want), ["g", "bin"]).where((F.col("cum") > F.col("pos")) & (F.col("cum") - F.col("c") <= F.col("pos")))
    found = {(r["g"], r["j"], r["which"]): r["v"] for r in hit.collect()}
    if len(found) != len(asked):
        raise ValueError(f"{len(found)} of {len(asked)} order statistics were found")
    return found


def _fold(seen: DataFrame, ids: list[int], wanted: list[np.ndarray], out: list[list[Slot]]) -> None:
    """The judged rows on either side of every offset, as moments about it."""
    cuts = [(i, j, slot.offset, int(np.searchsorted(wanted[i], _bin(np.array([slot.offset]))[0])))
            for i, g in enumerate(ids) for j, slot in enumerate(out[g])]
    rows = seen.sparkSession.createDataFrame(cuts, "g int, j int, o double, cut int")
    part = seen.where("part > 0 AND rest >= -1").join(F.broadcast(rows), "g")
    value, o, c = F.col("rest") == -1, F.col("o"), F.col("c")
    above = F.when(value, F.col("v") >= o).otherwise(F.col("rest") > F.col("cut"))
    total = F.when(value, F.col("v") * c).otherwise(F.col("s"))
    square = F.when(value, F.col("v") * F.col("v") * c).otherwise(F.col("q"))
    stats = part.groupBy("g", "j", "part", above.alias("normal")).agg(
        F.sum("c").alias("n"), F.sum(total - c * o).alias("d"), F.sum(square - 2 * o * total + c * o * o).alias("dd"))
    for r in stats.collect():                                # four rows a slot and table at most
        mean = r["d"] / r["n"]
        slot = out[ids[r["g"]]][r["j"]]
        (slot.normal if r["normal"] else slot.anomaly)[r["part"] - 1] = Judged(r["n"], mean, max(r["dd"] / r["n"] - mean * mean, 0.0))
    for r in seen.where("part > 0 AND rest = -2").groupBy("g", "part").agg(F.sum("c").alias("c")).collect():
        for slot in out[ids[r["g"]]]:
            slot.bad[r["part"] - 1] = r["c"]


# ---------------------------------------------------------------- model
def fit(df: DataFrame, key: str, features: Sequence[str], n_trees: int = 200, max_samples="auto",
        contamination: float = 0.05, max_features: float = 1.0, bootstrap: bool = False, seed: int = 42
        ) -> ForestModel:
    """E1 + offset: fit, score the training rows, offset = contamination percentile."""
    spec = ForestSpec(0, n_trees, max_samples, max_features, bootstrap, seed)
    store = fit_forests(df, key, features, [spec])
    offset = evaluate_groups(df, [], features, store, [Group(spec, n_trees, [contamination])])[0][0].offset
    return ForestModel(store, list(features), spec, contamination, offset)


def score(model: ForestModel, df: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """Raw score, decision = raw − offset, flag (decision < 0), confidence |decision|."""
    k = model.spec.n_trees
    s = raw_scores(df, key, model.store, model.features, model.spec, [k], keep)
    return (s.withColumnRenamed(f"raw_score_{k}", "raw_score")
             .withColumn("anomaly_score", F.col("raw_score") - F.lit(model.offset))
             .withColumn("is_anomaly", (F.col("anomaly_score") < 0).cast("int"))
             .withColumn("confidence", F.abs("anomaly_score")))


def stability(model: ForestModel, df: DataFrame, key: str, tree_counts: Sequence[int] = (10, 25, 50, 75, 100, 150, 200),
              train_flag: str = "is_train") -> DataFrame:
    """For the first k trees of one forest, mean and population std of the
    decision score and the number flagged, on the training and on the test rows
    (``train_flag`` 1 and 0); the offset of each k comes from the training rows.
    Two scans for all k."""
    counts = [k for k in tree_counts if k <= model.spec.n_trees]
    train, test = df.where(F.col(train_flag) == 1), df.where(F.col(train_flag) == 0)
    slots = evaluate_groups(train, [train, test], model.features, model.store,
                            [Group(model.spec, k, [model.contamination]) for k in counts])
    rows = []
    for k, (slot,) in zip(counts, slots):
        for p, flag in enumerate((1, 0)):
            sides = [j for j in (slot.normal[p], slot.anomaly[p]) if j.n]
            n = sum(j.n for j in sides)
            mean = sum(j.n * j.mean for j in sides) / n if n else None
            var = sum(j.n * (j.var + (j.mean - mean) ** 2) for j in sides) / n if n else None
            if n + slot.bad[p]:
                rows.append((k, flag, n + slot.bad[p], mean, math.sqrt(var) if n else None, slot.anomaly[p].n))
    return df.sparkSession.createDataFrame(rows, T.StructType([
        T.StructField("n_trees", T.IntegerType()), T.StructField(train_flag, df.schema[train_flag].dataType), T.StructField("n_rows", T.LongType()),
        T.StructField("mean_score", T.DoubleType()), T.StructField("std_score", T.DoubleType()), T.StructField("n_flagged", T.LongType())]))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- search
def search(train: DataFrame, valid: DataFrame, key: str, features: Sequence[str], candidates: Sequence[dict],
           seed: int = 42, min_group: int = 10, penalised: bool = True) -> DataFrame:
    """Score every candidate (n_estimators, contamination,
    max_samples, max_features, bootstrap) by the penalised separation (G9) of
    its validation decision scores.

    Candidates sharing (max_samples, max_features, bootstrap) share one
    forest: ``n_estimators`` is a prefix of its trees and ``contamination``
    only moves the offset.  All forests are fitted and evaluated together.
    ``fit_seconds`` is the time the tasks spent on the candidate's own trees.
    Returns one row per candidate."""
    def fkey(c):
        return (c["max_samples"], float(c["max_features"]), bool(c["bootstrap"]))
    fkeys = sorted({fkey(c) for c in candidates}, key=str)
    specs = [ForestSpec(i, max(c["n_estimators"] for c in candidates if fkey(c) == fk), fk[0], fk[1], fk[2], seed)
             for i, fk in enumerate(fkeys)]
    store = fit_forests(train, key, features, specs)
    asked: dict[tuple, set] = {}
    for c in candidates:
        asked.setdefault((fkeys.index(fkey(c)), int(c["n_estimators"])), set()).add(float(c["contamination"]))
    groups = {gk: Group(specs[gk[0]], gk[1], sorted(conts)) for gk, conts in sorted(asked.items())}
    slots = dict(zip(groups, evaluate_groups(train, [valid], features, store, list(groups.values()))))
    spent: dict[int, list[float]] = {}
    for r in store.select("forest", "tree", "seconds").orderBy("forest", "tree").toArrow().to_pylist():    # one row a tree
        spent.setdefault(r["forest"], []).append(r["seconds"])
    rows = []
    for c in candidates:
        gk = (fkeys.index(fkey(c)), int(c["n_estimators"]))
        slot = slots[gk][groups[gk].contaminations.index(float(c["contamination"]))]
        normal, anomaly, bad = slot.normal[0], slot.anomaly[0], slot.bad[0]
        n = normal.n + anomaly.n + bad
        rate = anomaly.n / n if n else None
        value = float("-inf") if penalised else 0.0
        if not bad and normal.n >= min_group and anomaly.n >= min_group:
            pooled = math.sqrt((normal.var + anomaly.var) / 2)
            if pooled >= 1e-6:
                value = (normal.mean - anomaly.mean) / pooled
                if penalised:
                    value -= 2 * abs(rate - float(c["contamination"]))
        rows.append((int(c["candidate"]), int(c["n_estimators"]), float(c["contamination"]), str(c["max_samples"]), float(c["max_features"]),
                     bool(c["bootstrap"]), value, rate, sum(spent[gk[0]][:gk[1]])))
    # one row per candidate: a parameter table
    return train.sparkSession.createDataFrame(rows, "candidate int, n_estimators int, contamination double, max_samples string, "
                                              "max_features double, bootstrap boolean, score double, flagged_rate double, fit_seconds double")


# Fixed values that must equal the reference's search spaces.
GRID = {"n_estimators": [150, 250], "contamination": [0.03, 0.05, 0.07], "max_samples": [512, 1024],
        "max_features": [0.8, 1.0], "bootstrap": [False, True]}


#: the cross-validated search has a space of its own: 24 candidates
FOLD_GRID = {**GRID, "max_samples": [512]}


def grid_candidates(grid: dict = GRID) -> list[dict]:
    from itertools import product

    return [dict(zip(grid, vals), candidate=i) for i, vals in enumerate(product(*grid.values()))]


def random_candidates(n_iter: int = 30, seed: int = 42) -> list[dict]:
    """The reference's draws: NumPy's legacy generator, seeded, in the same call order."""
    rs = np.random.RandomState(seed)
    out = []
    for i in range(n_iter):
        out.append({"n_estimators": int(rs.randint(50, 500)), "contamination": float(rs.uniform(0.01, 0.15)),
                    "max_samples": int(rs.choice([512, 1024, 2048])), "max_features": float(rs.uniform(0.5, 1.0)),
                    "bootstrap": bool(rs.choice([False, True])), "candidate": i})
    return out


def cv_search(df: DataFrame, key: str, features: Sequence[str], candidates: Sequence[dict], folds: int = 2,
              seed: int = 42) -> DataFrame:
    """K-fold search (hash fold id); each fold trains on the others and
    is scored by the unpenalised separation (guards → 0); mean over folds."""
    from ledgerlens.functions.stats import unit_hash as _uh

    fold = F.floor(_uh(key, f"fold-{seed}") * folds).cast("int")
    tagged = df.withColumn("_fold", fold)
    parts = []
    for k in range(folds):
        tr = tagged.where(F.col("_fold") != k).drop("_fold")
        va = tagged.where(F.col("_fold") == k).drop("_fold")
        parts.append(search(tr, va, key, features, candidates, seed, min_group=3, penalised=False)
                     .withColumn("fold", F.lit(k)))
    allf = parts[0]
    for p in parts[1:]:
        allf = allf.unionByName(p)
    return allf.groupBy("candidate", "n_estimators", "contamination", "max_samples", "max_features", "bootstrap") \
               .agg(F.avg("score").alias("score"), F.avg("flagged_rate").alias("flagged_rate"),
                    F.sum("fit_seconds").alias("fit_seconds"))
