"""From raw documents to token ids: quality, exact dedup, near-dedup, mix, BPE.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept; all but the last return the columns of ``documents``.  ``run`` writes
every stage as Parquet in the shared checkpoint folder and hands the reread
table to the next one, so a lost executor costs one stage at most.

A stage's intermediate tables go when a later stage starts and neither that
stage's input nor any result of a stage that is still referenced reads them, so
stages may be built one on another before the first is written.  Whoever derives
a table from a stage's result and reads it after the next stage was built keeps
the result.  Columns of any name pass through all stages but the last.
"""

from __future__ import annotations

import functools
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.bpe import bpe_encode
from ledgerlens.llm.common import cut_lineage, free_names, ready, table
from ledgerlens.llm.exact_dedup import keep_first
from ledgerlens.llm.mixing import mixed_documents
from ledgerlens.llm.quality import keep_good, train
from ledgerlens.llm.simhash import simhash_groups
from ledgerlens.session import drop_scratch, scratch_tables

#: results of stages, weakly, with the intermediate tables they read
_MADE: list[tuple[weakref.ref, set[str]]] = []


def _drop_unread(spark: SparkSession, docs: DataFrame) -> set[str]:
    """Delete the tables that no result reads any more; the tables ``docs`` reads."""
    known = set().union(*(paths for _, paths in _MADE)) & set(scratch_tables(spark))
    files = docs.inputFiles() if known else []
    read = {p for p in known if any(p.rsplit("/", 1)[1] in f for f in files)}
    _MADE[:] = [(ref, paths) for ref, paths in _MADE if ref() is not None]
    drop_scratch(spark, sorted(known - read - set().union(*(paths for _, paths in _MADE))))
    return read


def _stage(work: Callable) -> Callable:
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ready(spark)
        read = _drop_unread(spark, docs)
        before = set(scratch_tables(spark))
        out = work(spark, docs, sf_dir)
        _MADE.append((weakref.ref(out), read | {p for p in scratch_tables(spark) if p not in before}))
        return out
    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the line field scores 0.3 or more (a text without a word goes)."""
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest identifier, of each distinct text."""
    return keep_first(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints linked at 2 bits or fewer: the
    row with the smallest identifier (the first of repeated rows; null last)."""
    number, = free_names(docs, "_uid")
    base = cut_lineage(docs.withColumn(number, F.monotonically_increasing_id()))
    groups = simhash_groups(base, shingle=3, radius=2, uid_col=number)
    first = groups.groupBy("root", "run").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("k"))
    stay = first.groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.uid").alias(number))
    return base.join(stay, number, "left_semi").select(*docs.columns)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words the mix takes, as documents: one row per document and epoch."""
    return mixed_documents(docs)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every mixed text, with its digest and that of its decoding."""
    import public_tokenizers

    return bpe_encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
                      carry=("lang", "source"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("mixing sources", mix),
    ("byte-level bpe", encode),
]

#: the field's fit and the sentencepiece merges have no SQL form; the pipeline
#: is tested against a brute-force version instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
