"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut_lineage

#: a node's edges are spread over this many salts while its minimum meets them
SALTS = 64


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction over edges (a, b), a > b.

    Large star: every larger neighbour of a node moves to the smallest node
    around it.  Small star: a node and its smaller neighbours move to the
    smallest of them.  The minimum is a partial aggregate, and a centre with
    very many edges meets its minimum once per salt."""
    if large:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    asked = pairs.select("u", "salt").distinct().join(least, "u")
    met = pairs.join(asked, ["u", "salt"])
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _state(edges: DataFrame) -> Row:
    """What tells two sets of edges apart, without a sum that could overflow:
    their number and the exclusive or of their hashes."""
    return edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge, the root its smallest reachable
    node.  Each round is written to the shared folder, so the lineage stays one
    round long.  Converged when the edges form stars: no node has two centres
    and no centre is itself a leaf."""
    now = cut_lineage(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        state = _state(now)
        if state == before or state["n"] == 0:
            break
        before = state
        now = cut_lineage(_star(_star(now, large=True), large=False))
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
