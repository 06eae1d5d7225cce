"""Local density of rows: exact nearest neighbours and the local outlier factor
(survey §2.5, E14).

Equal rows are one point with a weight, so a place that holds a third of all rows
is a single point.  A tree of median cuts, fitted on a bounded sample, deals the
points to leaves of about ``leaf`` points; the tree only decides who is compared
with whom, the result is exact whatever the sample.  A first pass finds the
distance of the k-th neighbour inside a point's own leaf; the true neighbours are
not farther away than that, so a second pass sends the point to the leaves its
ball of that radius touches, and to no other.  Leaves that many points visit are
split by salt.  No pair outside these leaves is formed and no candidate is capped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.skew import group_lookup
from ledgerlens.functions.stats import clean_double
from ledgerlens.session import cut_lineage, fitted_params

#: leaves of the tree, and sampled points a leaf; both bound what the driver holds
MAX_LEAVES = 1 << 16
SAMPLE_PER_LEAF = 16
#: points that visit one leaf in one task
VISITS = 8192
#: keeps the density of points with k copies finite
LEAST_REACH = 1e-10


class CutTree:
    """A full binary tree of axis cuts; left is at or below the cut."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.leaves = depth, 1 << depth
        self.dim, self.cut = np.zeros(self.leaves, np.int64), np.full(self.leaves, np.inf)
        held = {1: sample}
        for node in range(1, self.leaves):
            part = held.pop(node)
            if len(part) > 1:
                self.dim[node] = np.argmax(part.max(0) - part.min(0))
                self.cut[node] = np.sort(part[:, self.dim[node]])[(len(part) - 1) // 2]
            left = part[:, self.dim[node]] <= self.cut[node]
            held[2 * node], held[2 * node + 1] = part[left], part[~left]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node, row = np.ones(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + (x[row, self.dim[node]] > self.cut[node])
        return node - self.leaves

    def touched(self, x: np.ndarray, radius: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows whose ball touches it) of every leaf that any ball touches."""
        far = radius * (1 + 1e-9)                # a ball never loses a point to rounding
        todo = [(1, np.arange(len(x)), np.zeros_like(x))]
        while todo:
            node, rows, gap = todo.pop()
            if node >= self.leaves:
                yield node - self.leaves, rows
                continue
            d = self.dim[node]
            past = x[rows, d] - self.cut[node]   # how far beyond the cut
            for child, out in ((2 * node, past), (2 * node + 1, -past)):
                to = gap.copy()
                to[:, d] = np.maximum(to[:, d], out)
                near = np.sqrt((to ** 2).sum(1)) <= far[rows]
                if near.any():
                    todo.append((child, rows[near], to[near]))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        total += (a[:, d, None] - b[None, :, d]) ** 2
    return np.sqrt(total)


def _kth(dist: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Per row the smallest distance within which ``weight`` reaches k; infinite if never."""
    first = np.argsort(dist, axis=1, kind="stable")
    if dist.shape[1] > k + 1:                    # k + 1 points are enough: one may be the row itself
        first = first[:, :k + 1]
    upto = np.cumsum(np.take_along_axis(weight, first, 1), axis=1)
    at = np.argmax(upto >= k, axis=1)
    row = np.arange(len(dist))
    return np.where(upto[:, -1] >= k, dist[row, first[row, at]], np.inf)


def _others(mine: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Copies of each point that are not the asking row itself."""
    return weight[None, :] - (mine[:, None] == ids[None, :])


def nearest_points(points: DataFrame, k: int, leaf: int = 512) -> DataFrame:
    """(pid, nid, dist, take) for ``points`` (pid, x array of doubles, w copies): the k
    nearest other rows of one row at each point.  ``take`` rows are taken at point
    nid, the copies at pid itself first; equal distances go by coordinates.  A point
    has fewer than k only where the whole table has."""
    points = cut_lineage(points)
    n = points.count()
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
    depth = min(depth, MAX_LEAVES.bit_length() - 1)
    want = SAMPLE_PER_LEAF << depth
    share = F.pmod(F.xxhash64("pid"), F.lit(1 << 30)) < int(min(1.0, want / max(n, 1)) * (1 << 30))
    sample = fitted_params(points.where(share | F.lit(n <= want)).select("x").limit(2 * want), 2 * want) if depth else []
    tree = CutTree(np.array([r["x"] for r in sample], float).reshape(len(sample), -1) if sample else np.zeros((0, 1)), depth)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(leaf=tree.leaf(np.stack(b["x"])))

    dealt = cut_lineage(points.mapInPandas(deal, "pid long, x array<double>, w long, leaf long"))

    def bound(g: pd.DataFrame) -> pd.DataFrame:
        x, ids, w = np.stack(g["x"]), g["pid"].to_numpy(), g["w"].to_numpy()
        radius = [_kth(_distances(x[i:i + 256], x), _others(ids[i:i + 256], ids, w), k) for i in range(0, len(x), 256)]
        return g[["pid", "x"]].assign(radius=np.concatenate(radius))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 4096):
                part = b.iloc[i:i + 4096]
                for at, rows in tree.touched(np.stack(part["x"]), part["radius"].to_numpy()):
                    yield part.iloc[rows].assign(leaf=at)

    bounded = dealt.groupBy("leaf").applyInPandas(bound, "pid long, x array<double>, radius double")
    visits = cut_lineage(bounded.mapInPandas(visit, "pid long, x array<double>, radius double, leaf long"))
    # one row per leaf that needs more than one task
    busy = visits.groupBy("leaf").count().where(F.col("count") > VISITS).select(
        F.col("leaf").alias("_leaf"), F.ceil(F.col("count") / VISITS).cast("long").alias("salts"))
    salted = lambda df: df.join(F.broadcast(busy), F.col("leaf") == F.col("_leaf"), "left").drop("_leaf").withColumn(
        "salts", F.coalesce("salts", F.lit(1)))
    asking = salted(visits).withColumn("salt", F.pmod(F.xxhash64("pid"), F.col("salts"))).drop("salts")
    held = salted(dealt).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")

    def compare(asks: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        out = {"pid": [], "nid": [], "dist": [], "w": [], "nx": []}
        if len(asks) and len(here):
            x, ids, w = np.stack(here["x"]), here["pid"].to_numpy(), here["w"].to_numpy()
            order = np.lexsort(x.T[::-1])        # by coordinates, so stable sorts break ties by them
            x, ids, w = x[order], ids[order], w[order]
            ax, aid, radius = np.stack(asks["x"]), asks["pid"].to_numpy(), asks["radius"].to_numpy()
            for i in range(0, len(ax), 256):
                dist, rest = _distances(ax[i:i + 256], x), _others(aid[i:i + 256], ids, w)
                limit = np.minimum(_kth(dist, rest, k), radius[i:i + 256])
                for j in range(len(dist)):
                    at = np.flatnonzero((dist[j] <= limit[j]) & (rest[j] > 0))
                    at = at[np.argsort(dist[j, at], kind="stable")]
                    at = at[np.cumsum(rest[j, at]) - rest[j, at] < k]
                    out["pid"].append(np.full(len(at), aid[i + j]))
                    for name, v in (("nid", ids[at]), ("dist", dist[j, at]), ("w", rest[j, at])):
                        out[name].append(v)
                    out["nx"].extend(x[at])
        flat = {name: np.concatenate(v) if v else v for name, v in out.items() if name != "nx"}
        return pd.DataFrame({**flat, "nx": pd.Series(out["nx"], dtype=object)})

    found = asking.groupBy("leaf", "salt").cogroup(held.groupBy("leaf", "salt")).applyInPandas(
        compare, "pid long, nid long, dist double, w long, nx array<double>")
    # a point's window holds k points of each leaf it visited
    before = F.coalesce(F.sum("w").over(Window.partitionBy("pid").orderBy("dist", "nx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("_before", before).where(F.col("_before") < k).select(
        "pid", "nid", "dist", F.least(F.col("w"), k - F.col("_before")).alias("take"))


def local_density(df: DataFrame, cols: Sequence[str], k: int = 20, leaf: int = 512) -> DataFrame:
    """``df`` with k_distance (distance of the k-th nearest other row over
    ``cols``, Euclidean), and lof, the local outlier factor: about 1 inside a
    cluster, larger where a row lies in a thinner place than its neighbours.

    Exactly k neighbours count, equal distances by their coordinates; k or more
    copies of a row keep a finite density.  Rows with a missing value (NULL, NaN,
    infinite) in ``cols`` are nobody's neighbours and get NULL, as does a lone row."""
    keys = [f"_at{i}" for i in range(len(cols))]
    rows = df.withColumns({a: clean_double(c) + 0.0 for a, c in zip(keys, cols)})      # -0.0 is 0.0
    whole = rows.select(*keys).na.drop()
    points = cut_lineage(whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("w")).withColumn("pid", F.monotonically_increasing_id()))
    near = cut_lineage(nearest_points(points.select("pid", F.array(*keys).alias("x"), "w"), k, leaf))
    far = near.groupBy("pid").agg(F.max("dist").alias("k_distance"))
    reach = near.join(far.select(F.col("pid").alias("nid"), F.col("k_distance").alias("_k")), "nid").withColumn(
        "_reach", F.greatest("_k", "dist"))
    lrd = cut_lineage(reach.groupBy("pid").agg(
        (1 / (F.sum(F.col("take") * F.col("_reach")) / F.sum("take") + LEAST_REACH)).alias("lrd")).join(far, "pid"))
    around = near.join(lrd.select(F.col("pid").alias("nid"), F.col("lrd").alias("_l")), "nid").groupBy("pid").agg(
        (F.sum(F.col("take") * F.col("_l")) / F.sum("take")).alias("_around"))
    answers = points.join(lrd, "pid").join(around, "pid").select(*keys, "k_distance", (F.col("_around") / F.col("lrd")).alias("lof"))
    return group_lookup(rows, answers, keys).drop(*keys)
