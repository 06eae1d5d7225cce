"""Joins of rows with the statistics of their group that no hot group overloads."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage

#: answers of a lookup that are broadcast; the count is checked
BROADCAST_ROWS = 20_000


def group_lookup(rows: DataFrame, answers: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``answers`` (one row per group; null keys are a
    group of their own).

    The answers are written once.  Up to ``BROADCAST_ROWS`` of them are broadcast,
    so the rows stay where they are.  Beyond that the rows carry the number of
    their input partition: the distinct (group, partition) pairs, formed with a
    map-side combine, meet the answers, and the rows then join on (group,
    partition).  A group with a third of all rows is one pair per input
    partition, so it spreads over the tasks instead of landing in one."""
    keys = list(keys)
    names = [f"_g{i}" for i in range(len(keys))]
    rest = [c for c in answers.columns if c not in keys]
    small = cut_lineage(answers.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *rest))
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), _same(rows, keys, small, names), how).drop(*names)
    tagged = cut_lineage(rows.withColumn("_run", F.spark_partition_id()))    # both uses below see the same numbers
    pairs = [f"_p{i}" for i in range(len(keys))]
    asked = tagged.select(F.col("_run").alias("_of"), *[F.col(k).alias(p) for k, p in zip(keys, pairs)]).distinct()
    answered = asked.join(small, _same(asked, pairs, small, names), how).drop(*names)
    at = (tagged["_run"] == answered["_of"]) & _same(tagged, keys, answered, pairs)
    return tagged.join(answered, at, how).drop("_run", "_of", *pairs)


def _same(a: DataFrame, ka: Sequence[str], b: DataFrame, kb: Sequence[str]):
    return reduce(lambda x, y: x & y, [a[i].eqNullSafe(b[j]) for i, j in zip(ka, kb)])
