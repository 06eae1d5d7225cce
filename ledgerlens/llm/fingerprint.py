"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct 64-bit hashes of a text's shingles of
``shingle`` words (a shorter text is one shingle, a text without words has
none), in ascending order.  Sketches of parts merge into the sketch of the
union; two sketches estimate the texts' resemblance and containment, one
estimates the number of distinct shingles.  All of it is column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import BLANKS, cut_lineage, text_of
from ledgerlens.session import shuffle_partitions

K, SHINGLE = 128, 5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), BLANKS)

    def shingles(h: Column) -> Column:
        many = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (shingle - 1), F.lit(0))),
                           lambda x, i: F.xxhash64(x, *[F.get(h, i + d) for d in range(1, shingle)]))
        return F.when(F.size(h) >= shingle, many).otherwise(F.array(F.xxhash64(h)))

    hashes = _let(F.transform(words, lambda w: F.xxhash64(w)), shingles)
    return F.when(F.btrim(text, F.lit(" \t\n\x0b\f\r")) == "", F.array().cast("array<bigint>")).otherwise(
        F.slice(F.sort_array(F.array_distinct(hashes)), 1, k))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the union's k smallest hashes
    that both have; exact where both sketches hold every shingle.  Two sketches
    without shingles are alike (1)."""
    whole = (F.size(a) < k) & (F.size(b) < k)
    least = F.when(whole, F.array_union(a, b)).otherwise(merge(a, b, k))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        _let(least, lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th
    smallest hash's place in the hash range."""
    place = F.element_at(a, -1) / F.lit(2.0 ** 64) + 0.5
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / (1 + j) / na))


def as_string(a: Column) -> Column:
    """The sketch's hashes, eight bytes each, in base64."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


KEY = ["no_id", "id", "tie"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with their place in the order: identifier (null last), then a hash
    of the text, so that equal keys are equal rows."""
    t = text_of(text_col)
    zero = F.lit(0).cast(dict(docs.dtypes)[id_col])
    return docs.select(F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col), zero).alias("id"),
                       F.xxhash64(t).alias("tie"), t.alias("text"))


def following(keys: DataFrame) -> DataFrame:
    """Every key with the key after it in order (the first after the last).

    The keys are dealt out by range and written, so a bucket is a range; the
    next key is found inside the bucket, and the last one of a bucket takes the
    first of the next bucket from a table with one row per bucket."""
    spark = keys.sparkSession
    dealt = cut_lineage(keys.repartitionByRange(shuffle_partitions(spark), *KEY).withColumn("bucket", F.spark_partition_id()))
    k = F.struct(*KEY)
    heads = dealt.groupBy("bucket").agg(F.min(k).alias("head"))
    by_bucket = W.orderBy("bucket")
    heads = heads.select("bucket", F.coalesce(F.lead("head").over(by_bucket), F.first("head").over(
        by_bucket.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("head"))
    inside = W.partitionBy("bucket").orderBy(*KEY)
    return (dealt.withColumn("after", F.lead(k).over(inside)).join(heads, "bucket")
            .withColumn("after", F.coalesce("after", "head")).drop("head", "bucket"))


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                           shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, distinct_shingles for every row.

    The edited text replaces the last n_chars/2 (rounded down) code points by
    the first as many of the next document, in order of identifiers (null last;
    of equal identifiers by a hash of the text), the first after the last.
    Equal rows follow one another: all but the last of them have their own text
    as the next one.  Null counts as empty.

    The texts are shuffled once, by key; each sends half a text's length and a
    sketch to the document before it."""
    base = _keyed(docs, id_col, text_col)
    keys = base.withColumn("n", F.length("text")).groupBy(*KEY, "n").agg(F.count("*").alias("copies"))
    order = following(keys)
    # one row per key; the exchange below them serves both joins
    texts = base.groupBy(*KEY).agg(F.first("text").alias("text"))
    asked = order.select(F.col("after.*"), F.col("n").alias("asker_n"), F.struct(*KEY).alias("asker"))
    heads = (texts.join(asked, KEY)
             .select("asker.*", F.expr("substring(text, 1, asker_n div 2)").alias("head"),
                     sketch(F.col("text"), k, shingle).alias("next")))
    own = texts.join(order.select(*KEY, "n", "copies", (F.struct(*KEY) == F.col("after")).alias("alone")), KEY).join(heads, KEY)
    cut = lambda head: F.concat(F.expr("substring(text, 1, n - n div 2)"), head)
    # the last of equal rows meets the next key; the ones before it meet their own text
    turns = F.when((F.col("copies") > 1) & ~F.col("alone"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    own = own.withColumn("mine", sketch(F.col("text"), k, shingle)).withColumn("last", F.explode(turns))
    own = own.withColumn("edited", cut(F.when(F.col("last"), F.col("head")).otherwise(F.expr("substring(text, 1, n div 2)"))))
    own = own.withColumn("next", F.when(F.col("last"), F.col("next")).otherwise(F.col("mine")))
    own = own.select(*KEY, "n", "copies", "alone", "last", "mine", "next", F.sha2("edited", 256).alias("edited_sha256"),
                     sketch(F.col("edited"), k, shingle).alias("changed"))
    rows = F.when(~F.col("last"), F.col("copies") - 1).when(F.col("alone"), F.col("copies")).otherwise(F.lit(1).cast("long"))
    out = own.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "edited_sha256",
                     as_string(F.col("mine")).alias("fingerprint"), as_string(F.col("changed")).alias("edited_fingerprint"),
                     resemblance(F.col("mine"), F.col("changed"), k).alias("near_edited"),
                     resemblance(F.col("mine"), F.col("next"), k).alias("near_next"),
                     distinct_shingles(F.col("mine"), k).alias("distinct_shingles"), rows.alias("_rows"))
    return out.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows")))).drop("_row", "_rows")
