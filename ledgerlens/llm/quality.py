"""Quality classifier: a linear-chain conditional random field over lines.

Every line is good or bad.  Its evidence is a set of binned statistics of the
line itself, of the line before and of the line after (one-hot, so the field's
unary score is a sum of table entries); neighbouring labels are tied by
transition weights.  Forward-backward gives each line's probability of being
good, and a document's score is the mean of these, weighted by line length.

Lines have no labels of their own: in training every line carries its
document's label.  The field is fitted on a bounded sample - at most
``per_class`` labelled documents of either label, those with the smallest hash
of their identifier - by gradient steps on the exact log-likelihood.  Scoring
reads every line of every text; identifiers, labels, sources and languages are
never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: upper bin edges of each line statistic
EDGES = {
    "words": (1.5, 3.5, 7.5, 15.5, 40.5, 100.5),
    "distinct": (0.05, 0.15, 0.3, 0.5, 0.7, 0.85),        # different words / words
    "upper": (0.02, 0.1, 0.3, 0.6, 0.9),                  # words in capitals
    "odd_end": (0.02, 0.1, 0.3, 0.6, 0.9),                # words ending in an unusual sign
    "shout_end": (0.02, 0.1, 0.3, 0.6, 0.9),              # words ending in ! or ?
    "odd_start": (0.02, 0.1, 0.25, 0.45, 0.7),            # words starting with neither letter nor digit
    "digits": (0.02, 0.1, 0.3, 0.6),                      # words starting with a digit
    "stops": (0.005, 0.03, 0.08, 0.2, 0.4),               # words ending in , or .
    "word_length": (1.5, 2.5, 3.5, 5.5, 8.5, 14.5),
    "last": (0.5, 1.5),                                   # line ends: letter or digit, usual sign, other
    "first": (0.5, 1.5),                                  # line starts: capital, other letter, other
}
STATS, BINS = len(EDGES), 1 + max(map(len, EDGES.values()))
USUAL = frozenset(",.;:!?)\"'»”’…]")


def line_stats(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bins of each line that has a word, lengths in code points)."""
    rows, lengths = [], []
    for line in (text or "").split("\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        ends = [w[-1] for w in words]
        starts = [w[0] for w in words]
        tail = {c: ends.count(c) for c in set(ends)}
        head = {c: starts.count(c) for c in set(starts)}
        last, first = ends[-1], starts[0]
        rows.append((
            n, len(set(words)) / n, sum(map(str.isupper, words)) / n,
            sum(k for c, k in tail.items() if not c.isalnum() and c not in USUAL) / n,
            (tail.get("!", 0) + tail.get("?", 0)) / n,
            sum(k for c, k in head.items() if not c.isalnum()) / n,
            sum(k for c, k in head.items() if c.isdigit()) / n,
            (tail.get(",", 0) + tail.get(".", 0)) / n, sum(map(len, words)) / n,
            0 if last.isalnum() else 1 if last in USUAL else 2,
            0 if first.isupper() else 1 if first.isalpha() else 2))
        lengths.append(len(line))
    if not rows:
        return np.zeros((0, STATS), np.int8), np.zeros(0)
    stats = np.array(rows)
    bins = np.stack([np.searchsorted(e, stats[:, i], "left") for i, e in enumerate(EDGES.values())], axis=1)
    return bins.astype(np.int8), np.array(lengths, float)


@dataclass
class Field:
    """tables[0|1|2]: weights of the bins of the line, the one before, the one
    after; edge[0|1]: weight of having no line before, after; trans[y, y']:
    weight of neighbouring labels."""
    tables: np.ndarray
    edge: np.ndarray
    bias: float
    trans: np.ndarray

    @classmethod
    def zeros(cls) -> Field:
        return cls(np.zeros((3, STATS, BINS)), np.zeros(2), 0.0, np.zeros((2, 2)))


def unary(field: Field, bins: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Score of "good" for every line; ``starts`` are the documents' first lines."""
    cols = np.arange(STATS)
    own, prev, nxt = (field.tables[k][cols, bins].sum(1) for k in range(3))
    u = field.bias + own
    u[1:] += prev[:-1]
    u[:-1] += nxt[1:]
    first = starts[starts < len(bins)]
    u[first] += field.edge[0]
    u[first[first > 0]] -= prev[first[first > 0] - 1]         # the line before belongs to another document
    last = np.append(first[1:], len(bins)) - 1
    u[last] += field.edge[1]
    u[last[:-1]] -= nxt[last[:-1] + 1]
    return u


def _logsum(a: np.ndarray) -> np.ndarray:
    return np.logaddexp(a[..., 0], a[..., 1])


def forward_backward(u: np.ndarray, trans: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Exact marginals of all documents at once, one step along the lines at a
    time; documents are kept longest first, so each step touches a prefix.

    Returns P(good) per line, the expected label pairs (2, 2) and log Z."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    steps = int(sizes[0]) if len(sizes) else 0
    live = [int(np.searchsorted(-sizes, -t, "left")) for t in range(steps)]          # documents longer than t
    score = np.stack([np.zeros_like(u), u], axis=1)
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    for t in range(steps):
        at = starts[:live[t]] + t
        alpha[at] = score[at] if t == 0 else score[at] + _logsum((alpha[at - 1][:, :, None] + trans).transpose(0, 2, 1))
    for t in range(steps - 2, -1, -1):
        at = starts[:live[t + 1]] + t
        beta[at] = _logsum(trans[None] + (score[at + 1] + beta[at + 1])[:, None, :])
    some = sizes > 0
    z = _logsum(alpha[starts[some] + sizes[some] - 1])
    each = np.zeros(len(u))
    each[starts[some]] = z                                                          # log Z of every line's document
    doc = np.zeros(len(u), int)
    doc[starts[some]] = 1
    by_line = each[np.maximum.accumulate(np.where(doc > 0, np.arange(len(u)), 0))] if len(u) else each
    good = np.exp(alpha[:, 1] + beta[:, 1] - by_line)
    inner = np.flatnonzero(doc == 0)                                                # lines that have one before
    pair = alpha[inner - 1][:, :, None] + trans + (score[inner] + beta[inner])[:, None, :]
    pairs = np.exp(pair - by_line[inner][:, None, None]).sum(0) if len(inner) else np.zeros((2, 2))
    return good, pairs, float(z.sum())


def fit_field(docs: list[tuple[np.ndarray, int]], steps: int = 150, rate: float = 0.1, l2: float = 1.0) -> Field:
    """Fit by Adam on the log-likelihood with a Gaussian prior (``l2``).
    Every document counts as much as its share of lines."""
    docs = [(b, y) for b, y in docs if len(b)]
    field = Field.zeros()
    if not docs:
        return field
    bins = np.concatenate([b for b, _ in docs])
    sizes = np.array([len(b) for b, _ in docs])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    label = np.repeat([y for _, y in docs], sizes).astype(float)
    first = np.zeros(len(bins), bool)
    first[starts] = True
    last = np.append(first[1:], True)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[:-1][~first[1:]].astype(int), label[1:][~first[1:]].astype(int)), 1)
    flat = bins + np.arange(STATS) * BINS

    def spread(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.bincount(flat[rows].ravel(), np.repeat(r, STATS), STATS * BINS).reshape(STATS, BINS)

    params = [field.tables, field.edge, np.zeros(1), field.trans]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    inner, outer = np.flatnonzero(~first), np.flatnonzero(~last)
    for step in range(1, steps + 1):
        field.bias = float(params[2][0])
        good, pairs, _ = forward_backward(unary(field, bins, starts), field.trans, starts, sizes)
        r = label - good
        grads = [np.stack([spread(r, np.arange(len(r))), spread(r[inner], inner - 1), spread(r[outer], outer + 1)]),
                 np.array([r[first].sum(), r[last].sum()]), np.array([r.sum()]), seen - pairs]
        for i, (p, g) in enumerate(zip(params, grads)):
            g = (g - l2 * p) / len(bins)
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            p += rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-8)
    field.bias = float(params[2][0])
    return field


def score_texts(field: Field, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(score, lines) of whole texts; a text without any word scores 0."""
    stats = [line_stats(t) for t in texts]
    sizes = np.array([len(b) for b, _ in stats], int)
    if not sizes.sum():
        return np.zeros(len(texts)), sizes
    bins = np.concatenate([b for b, _ in stats])
    weight = np.concatenate([w for _, w in stats])
    some = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[some]
    good, _, _ = forward_backward(unary(field, bins, starts), field.trans, starts, sizes[some])
    score = np.zeros(len(texts))
    score[some] = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
    return np.clip(score, 0.0, 1.0), sizes


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          per_class: int = 1500) -> Field:
    """Fit on at most ``per_class`` documents of either label outside the
    held-out fold.  Without labels the field is neutral (score 0.5)."""
    usable = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
              .where("_id is not null and _y in (0, 1)").where(~held_out("_id")))
    pick = [usable.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    pick = F.broadcast(pick[0].unionByName(pick[1]))                     # 2 * per_class rows at most
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).join(pick, "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = [line_stats(t)[0].tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bins, pa.binary())], names=["y", "bins"])

    rows = sample.select("_y", "_t").mapInArrow(run, "y int, bins binary").collect()
    rows = sorted((bytes(r["bins"]), r["y"]) for r in rows)              # the same order on every run
    return fit_field([(np.frombuffer(b, np.int8).reshape(-1, STATS), y) for b, y in rows])


def score_quality(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text",
                  carry: tuple[str, ...] = (), threshold: float = 0.3) -> DataFrame:
    """doc_id, ``carry``, held_out, score, predicted, n_lines for every row.
    Null and empty texts score 0; a null identifier is not held out."""
    small = docs.select(F.col(id_col).alias("doc_id"), *carry, held_out(id_col).alias("held_out"),
                        F.col(text_col).cast("string").alias("_text"))
    keep = len(small.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, lines = score_texts(field, b.column(keep).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:keep], pa.array(score), pa.array((score >= threshold).astype(np.int32)),
                 pa.array(lines, pa.int64())], names=names)

    from pyspark.sql import types as T

    schema = T.StructType([*small.schema.fields[:keep], T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType()), T.StructField("n_lines", T.LongType())])
    names = schema.fieldNames()
    return small.mapInArrow(run, schema)


def keep_good(docs: DataFrame, field: Field, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows whose score reaches the threshold, all columns unchanged."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, _ = score_texts(field, b.column(at).to_pylist())
            yield b.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
