"""Ranked lexical search by the Best Position Algorithm.

Terms are runs of letters and digits (every character beyond ASCII counts as
one).  A posting's impact is an integer between 0 and 10^6; a document's score
is the sum of weight times impact over the query's terms.

The documents are read once per block of queries: each becomes one row of the
index with its length and the query terms it holds.  Length and document counts
come from that table, then every task turns its rows into shards of a bounded
number of documents and answers all queries of the block on each: a shard holds
one list of postings per term in descending impact.  For a query its lists are
read in parallel, a step of positions at a time; a document met for the first
time is looked up in all other lists (direct access), and every position so seen
is marked, whichever way it was reached.  A list's best position is the last one
before which everything has been seen.  A document not met yet stands behind the
best position in every list, so its score is at most the sum of weight times
impact there; reading stops once that sum is strictly below the k-th score (equal
scores are ordered by identifier, so equality is not enough).  A shard returns at
most k documents a query, and the k best of all shards are the answer.

A null text has no terms and never matches; a query without terms, or with
unknown ones only, has no rows.  Each row of the queries is a query of its own,
each row of the documents a document of its own, repeated or not; null
identifiers come last among equal scores.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import cut_lineage

#: queries and distinct terms of a block, documents and postings of a shard
BLOCK_QUERIES, BLOCK_TERMS = 512, 1 << 16
SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 1 << 22
#: positions of every list read in the first step; each step doubles
FIRST_STEP = 16

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERM).split()                # blanks are the only white space left


# ------------------------------------------------------------------ one shard
@dataclass
class Shard:
    """Postings by document (``first``, ``term``, ``impact``, ``rank``: place in the
    term's list) and the lists (``start`` by term, ``list_doc``, ``list_impact``)."""
    first: np.ndarray
    term: np.ndarray
    impact: np.ndarray
    rank: np.ndarray
    start: np.ndarray
    list_doc: np.ndarray
    list_impact: np.ndarray

    @classmethod
    def build(cls, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_words: int, n_terms: int) -> Shard:
        """``sizes``: postings of each document, ``n``: its terms with repeats."""
        doc = np.repeat(np.arange(len(sizes)), sizes)
        if len(n) and 75 * int(n.max()) * n_docs >= 1 << 63:
            part = np.array([75 * x * n_docs // n_words for x in n.tolist()], np.int64)
        else:
            part = 75 * n * n_docs // max(n_words, 1)
        m = (100 - 75 + part)[doc]
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)
        order = np.lexsort((doc, -impact, term))
        start = np.searchsorted(term[order], np.arange(n_terms + 1))
        rank = np.empty(len(term), np.int64)
        rank[order] = np.arange(len(term)) - start[term[order]]
        return cls(np.concatenate([[0], np.cumsum(sizes)]), term, impact, rank, start, doc[order], impact[order])

    def lookup(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(posting numbers of the documents, which of ``docs`` each belongs to)."""
        sizes = self.first[docs + 1] - self.first[docs]
        row = np.repeat(np.arange(len(docs)), sizes)
        return self.first[docs][row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row


def best_positions(shard: Shard, terms: np.ndarray, weights: np.ndarray, k: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, documents looked up): the k best of a shard with a
    positive score; equal scores by ``order``."""
    size = shard.start[terms + 1] - shard.start[terms]
    use = (size > 0) & (weights > 0)
    terms, weights, size = terms[use], weights[use], size[use]
    none = np.zeros(0, np.int64)
    if not len(terms):
        return none, none, 0
    lo, base = shard.start[terms], np.cumsum(size) - size
    slot = np.full(len(shard.start), -1, np.int32)
    slot[terms] = np.arange(len(terms))
    seen = np.zeros(int(size.sum()), bool)                       # positions of all lists, one after the other
    best = np.zeros(len(terms), np.int64)                        # positions seen without a gap
    known = np.zeros(len(order), bool)
    top, score, looked, depth, step = none, none, 0, 0, FIRST_STEP
    while True:
        read = np.concatenate([shard.list_doc[a + depth:a + min(depth + step, s)] for a, s in zip(lo.tolist(), size.tolist())])
        new = np.unique(read[~known[read]])
        if len(new):
            known[new] = True
            looked += len(new)
            at, row = shard.lookup(new)
            j = slot[shard.term[at]]
            hit = j >= 0
            at, row, j = at[hit], row[hit], j[hit]
            seen[base[j] + shard.rank[at]] = True
            sums = np.zeros(len(new), np.int64)
            np.add.at(sums, row, weights[j] * shard.impact[at])
            top, score = np.concatenate([top, new[sums > 0]]), np.concatenate([score, sums[sums > 0]])
            if len(top) > k:
                keep = np.lexsort((order[top], -score))[:k]
                top, score = top[keep], score[keep]
        for i in np.flatnonzero(best < size).tolist():
            ahead = seen[base[i] + best[i]:base[i] + size[i]]
            gap = int(ahead.argmin())
            best[i] = size[i] if ahead[gap] else best[i] + gap
        left = best < size
        bound = int((weights[left] * shard.list_impact[lo[left] + best[left] - 1]).sum())
        depth += step
        step *= 2
        if not left.any() or (len(top) == k and int(score.min()) > bound):
            keep = np.lexsort((order[top], -score))
            return top[keep], score[keep], looked


# ------------------------------------------------------------------ distributed
def _blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Queries as (identifier, terms with their counts), in bounded blocks."""
    block, terms = [], set()
    for r in queries.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        own = Counter(terms_of((r["t"] or "").encode()))
        if block and (len(block) >= BLOCK_QUERIES or len(terms | own.keys()) > BLOCK_TERMS):
            yield block
            block, terms = [], set()
        block.append((r["i"], own))
        terms |= own.keys()
    if block:
        yield block


def _index(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n, terms, tfs (int32 arrays as bytes) of every document."""
    def run(batches):
        number = vocabulary.value
        for b in batches:
            n, terms, tfs = [], [], []
            for text in b.column(1).cast(pa.large_binary()).to_pylist():
                words = terms_of(text)
                n.append(len(words))
                ids = np.fromiter((i for i in map(number.get, words) if i is not None), np.int32)
                own, tf = np.unique(ids, return_counts=True)
                terms.append(own.tobytes())
                tfs.append(tf.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())],
                                             names=["doc_id", "n", "terms", "tfs"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("terms", T.BinaryType()),
                           T.StructField("tfs", T.BinaryType())])
    return docs.mapInArrow(run, schema)


def _doc_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """Documents holding each term of the block."""
    def run(batches):
        held = np.zeros(n_terms, np.int64)
        for b in batches:
            held += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=n_terms)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in index.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]                                 # as many rows as the block has terms, at most
    return out


def _answers(index: DataFrame, plan, k: int) -> DataFrame:
    """(q, doc_id, score): the k best documents of every shard for every query."""
    schema = T.StructType([T.StructField("q", T.IntegerType()), index.schema["doc_id"], T.StructField("score", T.LongType())])

    def run(batches):
        queries, n_docs, n_words, n_terms = plan.value
        for part in _shards(batches):
            ids = part.column("doc_id").combine_chunks()
            terms = part.column("terms").to_pylist()
            order = np.empty(len(ids), np.int64)
            order[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
            shard = Shard.build(np.array([len(t) // 4 for t in terms]), np.frombuffer(b"".join(terms), np.int32),
                                np.frombuffer(b"".join(part.column("tfs").to_pylist()), np.int32).astype(np.int64),
                                part.column("n").to_numpy(), n_docs, n_words, n_terms)
            found = [best_positions(shard, t, w, k, order)[:2] for t, w in queries]
            at = np.concatenate([d for d, _ in found]).astype(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(found), dtype=np.int32), [len(d) for d, _ in found])), ids.take(pa.array(at)),
                 pa.array(np.concatenate([s for _, s in found]).astype(np.int64) if found else at)], names=["q", "doc_id", "score"])

    return index.mapInArrow(run, schema)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, docs, postings = [], 0, 0
    for b in batches:
        held.append(b)
        docs += len(b)
        postings += b.column(2).nbytes // 4
        if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
            yield pa.Table.from_batches(held)
            held, docs, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query: first within 32 parts, then of these."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = Window.partitionBy("q", "salt").orderBy(*order)
    few = (found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(32))).withColumn("rank", F.row_number().over(part))
           .where(F.col("rank") <= k).drop("rank", "salt"))
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """The ``k`` best documents of every query: ``query_id``, rank, doc_id, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField(query_id, queries.schema[query_id].dataType)])
    out = None
    for block in _blocks(queries, query_id, query_text):
        number = {t: i for i, t in enumerate(sorted(set().union(*(own for _, own in block))))}
        vocabulary = spark.sparkContext.broadcast(number)        # BLOCK_TERMS terms (or one query's) at most
        index = cut_lineage(_index(rows, vocabulary))
        vocabulary.unpersist()
        size = index.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).first()
        df = _doc_counts(index, len(number)).tolist()
        weight = [math.floor(1000 * math.log((2 * size["docs"] + 2) / (2 * d + 1))) for d in df]
        asked = [(np.array([number[t] for t in own], np.int64), np.array([weight[number[t]] * c for t, c in own.items()], np.int64))
                 for _, own in block]
        plan = spark.sparkContext.broadcast((asked, size["docs"], size["words"] or 0, len(number)))
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], schema)
        found = _top(_answers(index, plan, k), k).join(F.broadcast(names), "q").select(query_id, F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], T.StructType([schema[query_id], T.StructField("rank", T.IntegerType()), rows.schema["doc_id"],
                                                      T.StructField("score", T.LongType())]))
    return out
