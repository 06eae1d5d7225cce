"""Exact dedup: a tree merge of sorted digest runs.

Every input partition is one run: its documents' digests, reduced to one entry
per distinct text (64-bit digest, SHA-256 and length for verification, the
smallest identifier, the number of rows).  Runs are exchanged in rounds: round
r merges the runs whose numbers agree after dropping ``log2(fan_in)`` more low
bits (a binomial tree of that arity), with a sort-based aggregate that merges
entries equal in digest *and* verification fields and keeps the smallest
identifier.  After ceil(log_fan_in(runs)) rounds each text has one entry, the
winner, which flows back down to the runs.

A text held by a third of all rows is one entry per run before anything is
shuffled, so no task sees more than ``fan_in`` entries of it per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import BLANKS, cut_lineage, free_names, lookup_by_run, text_of

ENTRY = ["digest", "sha", "n"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None) -> DataFrame:
    """One small row per document: (run, uid, doc_id, digest, sha, n).  Written
    once: the row numbers and run numbers must not change between readers."""
    uid = F.col(uid_col) if uid_col else F.monotonically_increasing_id()
    norm = docs.select(uid.alias("uid"), F.col(id_col).alias("doc_id"),
                       F.regexp_replace(text_of(text_col), BLANKS, " ").alias("norm"))
    return cut_lineage(norm.select(
        F.spark_partition_id().alias("run"), "uid", "doc_id",
        F.xxhash64("norm").alias("digest"), F.unhex(F.sha2("norm", 256)).alias("sha"),
        F.length("norm").alias("n")))


def merge_runs(rows: DataFrame, fan_in: int = 16) -> DataFrame:
    """(digest, sha, n) -> keep (smallest (doc_id nulls last, uid)), size."""
    bits = fan_in.bit_length() - 1
    if 1 << bits != fan_in or bits < 1:
        raise ValueError("fan_in must be a power of two, 2 at least")
    left = (rows.agg(F.max("run")).first()[0] or 0) + 1
    level = rows.select("run", *ENTRY, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid").alias("keep"),
                        F.lit(1).cast("long").alias("size"))
    while True:
        level = (level.withColumn("run", F.shiftright("run", bits)).groupBy("run", *ENTRY)
                 .agg(F.min("keep").alias("keep"), F.sum("size").alias("size")))
        left = -(-left // fan_in)
        if left <= 1:
            return level.select(*ENTRY, "keep", "size")


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16,
            uid_col: str | None = None) -> DataFrame:
    """Every row's small record with the winner of its text."""
    rows = digests(docs, id_col, text_col, uid_col)
    return lookup_by_run(rows, ENTRY, merge_runs(rows, fan_in))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Texts are equal when identical after each run of ASCII white space became
    one space (null counts as empty).  Of equal texts the row with the smallest
    identifier stays; a null identifier ranks last, and of rows equal in text
    and identifier exactly one stays."""
    return winners(docs, id_col, text_col, fan_in).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("uid") == F.col("keep.uid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, with all their columns.  The rows are numbered
    and written first, so that the kept numbers name the same rows."""
    number, = free_names(docs, "_uid")
    base = cut_lineage(docs.withColumn(number, F.monotonically_increasing_id()))
    kept = (winners(base, id_col, text_col, uid_col=number).where(F.col("uid") == F.col("keep.uid"))
            .select(F.col("uid").alias(number)))
    return base.join(kept, number, "left_semi").select(*docs.columns)
