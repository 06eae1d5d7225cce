"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes.

A text is lower-cased, its white space joined to single spaces, and every window
of 3 to 7 characters (word borders are spaces, so they belong to the n-grams) is
hashed to one of 2^20 features; a text has a feature or has it not.  Over the
labelled texts every feature gets a log-count ratio

    r = log((toxic texts with it + 1) / (toxic texts + 2))
      - log((other texts with it + 1) / (other texts + 2))

Features whose shares in the two classes differ by ``min_z`` standard errors stay
in, at most ``max_features``.  A text's vector holds r for each of its features,
scaled to length one, and a logistic regression with a Gaussian prior learns a
weight for each.  Classes are weighted by their true numbers, so the score of a
text without any feature is near the share of toxic texts.

Fitting: at most ``per_class`` labelled documents of either class outside the
held-out fold, those with the smallest hash of their identifier.  The n-gram
counts are one distributed aggregate; the driver sees the selected features (at
most ``max_features``) and the sampled documents as lists of these.  Scoring
reads every whole text, ``WINDOW`` characters at a time.  Identifiers, labels,
sources and languages are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import cut_lineage

SHORTEST, LONGEST, BITS = 3, 7, 20
#: characters hashed at a time
WINDOW = 1 << 20
_STEP, _CHAR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def features(text: str | None) -> Iterator[np.ndarray]:
    """Feature numbers of a text, window by window, with repeats."""
    words = (text or "").lower().split()
    if not words:
        return
    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(codes), WINDOW):
        chars = (codes[at:at + WINDOW + LONGEST - 1].astype(np.uint64) + np.uint64(1)) * _CHAR
        h, found = chars, []
        for n in range(2, LONGEST + 1):
            if len(h) < 2:
                break
            h = h[:-1] * _STEP + chars[n - 1:] + np.uint64(n)
            if n >= SHORTEST:
                found.append((((h ^ (h >> np.uint64(32))) * _STEP) >> np.uint64(64 - BITS)).astype(np.int32))
        if found:
            yield np.concatenate(found)


def distinct_features(text: str | None) -> np.ndarray:
    parts = [np.unique(p) for p in features(text)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int32)


@dataclass
class NgramModel:
    """place: feature number -> place in ratio and weight, or -1."""
    place: np.ndarray
    ratio: np.ndarray
    weight: np.ndarray
    bias: float

    def own(self, text: str | None) -> np.ndarray:
        """Places of the features a text has."""
        parts = []
        for p in features(text):
            p = self.place[p]
            parts.append(np.unique(p[p >= 0]))
        return (np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]) if parts else np.zeros(0, np.int32)

    def score(self, text: str | None) -> float:
        own = self.own(text)
        r = self.ratio[own]
        length = float(np.sqrt(np.square(r).sum()))
        z = self.bias + (float((r * self.weight[own]).sum()) / length if length else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -50.0, 50.0))))


def _regress(rows: list[tuple[int, np.ndarray]], ratio: np.ndarray, class_weight: tuple[float, float],
             steps: int = 300, rate: float = 0.05, l2: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic regression, by Adam on the whole sample.
    Beyond 300 steps the rate falls, so that a long run settles at the optimum."""
    y = np.array([k for k, _ in rows], float)
    row = np.repeat(np.arange(len(rows)), [len(x) for _, x in rows])
    col = np.concatenate([x for _, x in rows]) if rows else np.zeros(0, np.int64)
    value = ratio[col]
    length = np.sqrt(np.bincount(row, value * value, len(rows)))
    value = value / np.where(length > 0, length, 1.0)[row]
    heed = np.where(y == 1, class_weight[1], class_weight[0])
    params, m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, value * params[col], len(rows)) + params[-1]
        miss = (1.0 / (1.0 + np.exp(-np.clip(z, -50.0, 50.0))) - y) * heed
        grad = np.append(np.bincount(col, value * miss[row], len(ratio)) + l2 * params[:-1], miss.sum()) / len(rows)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        params -= rate * min(1.0, 300 / step) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return params[:-1], float(params[-1])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def neutral() -> NgramModel:
    return NgramModel(np.full(1 << BITS, -1, np.int32), np.zeros(0), np.zeros(0), 0.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          per_class: int = 2000, min_texts: int = 5, min_z: float = 3.0, max_features: int = 1 << 16) -> NgramModel:
    """Fit on at most ``per_class`` labelled documents of either class outside the
    held-out fold.  A document labelled more than once counts as toxic if any of
    its labels says so; of several texts under one identifier the smallest is
    read.  Without documents of both classes the score is 0.5 everywhere."""
    usable = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
              .where("_id is not null and _y in (0, 1)").where(~held_out("_id")).groupBy("_id").agg(F.max("_y").alias("_y")))
    there = {r["_y"]: r["count"] for r in usable.groupBy("_y").count().collect()}
    pick = [usable.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    pick = F.broadcast(pick[0].unionByName(pick[1]))                     # 2 * per_class rows at most
    sample = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t")).join(pick, "_id")
    sample = cut_lineage(sample.groupBy("_id", "_y").agg(F.min("_t").alias("_t")).select("_y", "_t"))
    n = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
    if len(n) < 2:
        return neutral()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[y, distinct_features(text)] += 1
        some = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[0, some].astype(np.int64)), pa.array(seen[1, some].astype(np.int64))],
                                         names=["f", "c0", "c1"])

    counts = sample.mapInArrow(count, "f long, c0 long, c1 long").groupBy("f").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    share = (F.col("c0") + F.col("c1") + 1) / F.lit(float(n[0] + n[1] + 2))
    z = (F.col("c1") / n[1] - F.col("c0") / n[0]) / F.sqrt(share * (1 - share) * F.lit(1.0 / n[1] + 1.0 / n[0]))
    best = (counts.where(F.col("c0") + F.col("c1") >= min_texts).withColumn("z", F.abs(z)).where(F.col("z") > min_z)
            .orderBy(F.desc("z"), "f").limit(max_features).toPandas().sort_values("f"))
    model = neutral()
    model.place[best["f"].to_numpy()] = np.arange(len(best), dtype=np.int32)
    model.ratio = (np.log((best["c1"].to_numpy() + 1) / (n[1] + 2)) - np.log((best["c0"].to_numpy() + 1) / (n[0] + 2)))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [model.own(t).astype("<i4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["y", "own"])

    rows = sample.mapInArrow(own, "y int, own binary").collect()
    rows = sorted((bytes(r["own"]), r["y"]) for r in rows)               # the same order on every run
    heed = [there[y] / n[y] for y in (0, 1)]
    mean = (heed[0] * n[0] + heed[1] * n[1]) / (n[0] + n[1])
    model.weight, model.bias = _regress([(y, np.frombuffer(x, "<i4")) for x, y in rows], model.ratio,
                                        (heed[0] / mean, heed[1] / mean))
    return model


def score_toxicity(docs: DataFrame, model: NgramModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.  Null, empty and blank
    texts have no features and get the bias alone; a null identifier is not held
    out; repeated rows each get their row; other columns are not read."""
    small = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.array([model.score(t) for t in b.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    schema = T.StructType([*small.schema.fields[:2], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return small.mapInArrow(run, schema)
