"""Mixing sources to target weights.

Documents of a source form one word stream, in a pseudorandom but fixed order;
the stream is packed into blocks of ``block`` words (the last may be shorter).
A source's target in words becomes a number of block slots.  Every output shard
draws its sources slot by slot with the target weights, so its counts are
multinomial; draws beyond a source's number of slots go to the sources that
came out short, so that the totals hold exactly.  The slots of a source, counted
through, run through its blocks once per epoch, each epoch in the order of
another pseudorandom index permutation, and meet the blocks by an equi-join on
(source, block).  The very last slot of a source is cut so that its words add up.

Everything is DataFrame expressions.  Offsets along a stream are two-level
prefix sums (bucket totals, then a window inside (source, bucket)), so a source
with a third of all words spans many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD, cut_lineage, free_names, text_of

#: rounds of the index permutation; cells of the draw's lookup table
ROUNDS, CELLS = 12, 4096
#: weights of the sources in order, repeating
WEIGHTS = (5.0, 2.0, 1.0)
#: a target is at most this many times its source's size
EPOCHS = 3


def _number(*parts: Column | str | int) -> Column:
    """A 60-bit number from the MD5 of the parts, the same in any SQL engine."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def word_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               uid_col: str | None = None) -> DataFrame:
    """(uid, doc_id, source, sk, size) for every row, written once."""
    uid = F.col(uid_col) if uid_col else F.monotonically_increasing_id()
    return cut_lineage(docs.select(
        uid.alias("uid"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("sk"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size")))


def source_targets(sizes: DataFrame, block: int, seed: int) -> DataFrame:
    """One row per source: source_size, target, slots n, blocks nb, the words of
    the cut last slot, and the permutation keys of every epoch.

    Targets share the whole size by weight and stop at EPOCHS times the source's
    size; the excess is shared again by weight.  With the sources ordered by
    cap/weight the capped ones are a prefix: the share per weight is taken at
    the first source that it does not lift above its cap."""
    src = sizes.groupBy("sk").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").isNull(), "source")               # one row per source here
    rank = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), rank + 1))
    src = src.withColumn("cap", EPOCHS * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = W.orderBy("ratio", "sk")
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    src = (src.withColumn("left", F.sum("source_size").over(W.partitionBy()).cast("double")
                          - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
           .withColumn("of", F.sum("weight").over(after)))
    src = src.withColumn("first", F.min_by(
        F.struct("left", "of", "ratio", "sk"),
        F.when(F.col("left") <= F.col("ratio") * F.col("of"), F.struct("ratio", "sk"))).over(W.partitionBy()))
    src = src.withColumn("target", F.when(F.struct("ratio", "sk") < F.struct("first.ratio", "first.sk"), F.col("cap"))
                         .otherwise(F.least("cap", F.col("first.left") * F.col("weight") / F.col("first.of"))))
    src = src.select("sk", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("words"),
                     F.expr(f"(source_size + {block - 1}) div {block}").alias("nb"))
    src = src.withColumn("full", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)))
    src = src.withColumn("rest", F.col("words") - F.col("full") * F.col("source_size"))
    keys = F.transform(F.sequence(F.lit(0), F.lit(EPOCHS)), lambda e: F.transform(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        lambda r: F.when(F.col("nb") > 0, _number(seed, "k", F.col("sk"), e, r) % F.col("nb")).otherwise(F.lit(0))))
    src = src.withColumn("keys", keys)
    # where the short last block comes in the epoch that is cut: the permutation backwards
    src = permute(src.withColumn("at", F.col("nb") - 1).withColumn("epoch", F.col("full")), seed, backwards=True)
    short = F.lit(block) * F.col("nb") - F.col("source_size")
    k0 = F.expr(f"(rest + {block - 1}) div {block}")
    more = (F.col("at") < k0) & (k0 * block - short < F.col("rest"))
    src = src.withColumn("k", F.when(F.col("rest") <= 0, F.lit(0)).otherwise(k0 + more.cast("long")))
    upto = (F.col("k") - 1) * block - F.when(F.col("at") < F.col("k") - 1, short).otherwise(F.lit(0))
    return src.select("sk", "source_size", "target", "nb", "keys",
                      (F.col("full") * F.col("nb") + F.col("k")).alias("n"),
                      F.when(F.col("k") > 0, F.col("rest") - upto).otherwise(F.lit(block)).alias("last_words"))


def permute(df: DataFrame, seed: int, backwards: bool = False) -> DataFrame:
    """Apply the permutation of (sk, epoch) on 0..nb-1 to the column ``at``.

    Each round pairs index i with (key - i) mod nb and swaps the pair when a
    hash bit of its larger member says so.  Every round is its own inverse, so
    the rounds in reverse order undo the permutation."""
    of = F.element_at("keys", F.least(F.col("epoch"), F.lit(EPOCHS)).cast("int") + 1)

    def step(at, r):
        pair = F.pmod(F.element_at(of, r + 1) - at, F.col("nb"))
        swap = _number(seed, "b", F.col("sk"), F.col("epoch"), r, F.greatest(at, pair)) % 2 == 1
        return F.when(swap, pair).otherwise(at)

    order = F.array(*[F.lit(r) for r in (reversed(range(ROUNDS)) if backwards else range(ROUNDS))])
    return df.withColumn("at", F.when(F.col("nb") > 0, F.aggregate(order, F.col("at"), step)).otherwise(F.col("at")))


def draw_slots(src: DataFrame, per_shard: int, block: int, seed: int, group: int = 1 << 13) -> DataFrame:
    """(slot, shard, sk, epoch, block, words): which block fills each output slot."""
    spark = src.sparkSession
    total = src.agg(F.sum("n")).first()[0] or 0
    order = W.orderBy("sk")
    cum = src.withColumn("hi", F.sum("n").over(order)).withColumn("lo", F.col("hi") - F.col("n")).where("n > 0")
    cell = lambda c: F.expr(f"({c} * {CELLS}) div {max(total, 1)}")
    cells = cum.select("sk", "lo", "hi", F.explode(F.sequence(cell("lo"), cell("(hi - 1)"))).alias("cell"))
    drawn = (spark.range(total).withColumnRenamed("id", "slot")
             .withColumn("u", _number(seed, "d", F.col("slot")) % max(total, 1)).withColumn("cell", cell("u"))
             .join(cells, "cell").where("u >= lo and u < hi")
             .select("slot", "sk", F.expr(f"slot div {group}").alias("part")))
    # draws of a source counted through: totals per (source, part), then inside the part
    parts = drawn.groupBy("sk", "part").agg(F.count("*").alias("c"))
    through = W.partitionBy("sk").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("c").over(through), F.lit(0)))
    got = parts.groupBy("sk").agg(F.sum("c").alias("d"))
    src = src.join(got, "sk", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    past = order.rowsBetween(W.unboundedPreceding, -1)
    src = (src.withColumn("over", F.greatest(F.col("d") - F.col("n"), F.lit(0)))
           .withColumn("lack", F.greatest(F.col("n") - F.col("d"), F.lit(0)))
           .withColumn("over_at", F.coalesce(F.sum("over").over(past), F.lit(0)))
           .withColumn("lack_at", F.coalesce(F.sum("lack").over(past), F.lit(0))))
    fill = ["n", "nb", "keys", "last_words"]
    parts = parts.join(src.select("sk", "over_at", *fill), "sk")
    inside = W.partitionBy("sk", "part").orderBy("slot")
    ranked = (drawn.withColumn("rn", F.row_number().over(inside)).join(parts.drop("c"), ["sk", "part"])
              .withColumn("j", F.col("base") + F.col("rn") - 1))
    stay = ranked.where("j < n").select("slot", "sk", "j", *fill)
    surplus = ranked.where("j >= n").select("slot", (F.col("over_at") + F.col("j") - F.col("n")).alias("x"))
    lacks = (src.where("lack > 0").withColumn("i", F.explode(F.expr("sequence(0L, lack - 1)")))
             .select((F.col("lack_at") + F.col("i")).alias("x"), "sk", (F.col("d") + F.col("i")).alias("j"), *fill))
    slots = stay.unionByName(surplus.join(lacks, "x").drop("x"))
    slots = (slots.withColumn("epoch", F.expr("j div nb")).withColumn("at", F.col("j") % F.col("nb"))
             .withColumn("words", F.when(F.col("j") == F.col("n") - 1, F.col("last_words")).otherwise(F.lit(block))))
    return permute(slots, seed).select("slot", F.expr(f"slot div {per_shard}").alias("shard"), "sk", "epoch",
                                       F.col("at").alias("block"), "words")


def stream_offsets(sizes: DataFrame, src: DataFrame, bucket_rows: int, seed: int) -> DataFrame:
    """Every row with its start in its source's stream, its source's size and target."""
    buckets = max(1, (sizes.count() + bucket_rows - 1) // bucket_rows)
    h = _number(seed, "o", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size"))
    rows = sizes.withColumn("h", h).withColumn("bucket", F.expr(f"((h >> 28) * {buckets}) >> 32"))
    totals = rows.groupBy("sk", "bucket").agg(F.sum("size").alias("c"))
    through = W.partitionBy("sk").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("base", F.coalesce(F.sum("c").over(through), F.lit(0))).drop("c")
    totals = totals.join(src.select("sk", "source_size", "target"), "sk")
    inside = W.partitionBy("sk", "bucket").orderBy("h", "doc_id", "uid").rowsBetween(W.unboundedPreceding, -1)
    return (rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(totals, ["sk", "bucket"])
            .withColumn("start", F.col("start") + F.col("base")).drop("h", "bucket", "base"))


def mix_plan(sizes: DataFrame, block: int = 256, per_shard: int = 1024, seed: int = 7,
             bucket_rows: int = 2_000) -> DataFrame:
    """One row per piece of a document in a block and slot that takes it (a row
    with a null slot where none does): uid, doc_id, source, size, source_size,
    target, shard, slot, epoch, block, word range [lo, hi) of the document."""
    src = cut_lineage(source_targets(sizes, block, seed))
    slots = draw_slots(src, per_shard, block, seed)
    rows = stream_offsets(sizes, src, bucket_rows, seed)
    ends = F.col("start") + F.col("size")
    spans = F.when(F.col("size") > 0, F.expr(f"sequence(start div {block}, (start + size - 1) div {block})"))
    pieces = rows.withColumn("block", F.explode_outer(spans))
    begin = F.col("block") * block
    pieces = (pieces.withColumn("a", F.greatest(begin, F.col("start")))
              .withColumn("b", F.least(begin + block, ends)))
    met = pieces.join(slots, ["sk", "block"], "left")
    cut = F.when(F.col("words").isNotNull(), F.least(F.col("b"), F.col("block") * block + F.col("words")))
    return met.select("uid", "doc_id", "source", "size", "source_size", "target", "shard", "slot", "epoch", "block",
                      (F.col("a") - F.col("start")).alias("lo"),
                      F.greatest(F.col("a") - F.col("start"), F.coalesce(cut, F.col("a")) - F.col("start")).alias("hi"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                block: int = 256, per_shard: int = 1024, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row.

    Null sources are one source of their own (last in order); empty texts have
    size 0 and are never taken; a source of empty texts has target 0; rows with
    equal identifiers are separate documents."""
    plan = mix_plan(word_sizes(docs, id_col, text_col, source_col), block, per_shard, seed)
    return (plan.groupBy("uid", "doc_id", "size", "source_size", "target")
            .agg(F.sum(F.coalesce(F.col("hi") - F.col("lo"), F.lit(0))).alias("taken")).drop("uid"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    block: int = 256, per_shard: int = 1024, seed: int = 7) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: per document and
    epoch that takes words of it one row with the words taken (the whole text
    where all are); n_chars, where there is one, follows the text."""
    number, size, taken, parts, cut = free_names(docs, "_uid", "_size", "_words", "_parts", "_cut")
    base = cut_lineage(docs.withColumn(number, F.monotonically_increasing_id()))
    plan = mix_plan(word_sizes(base, id_col, text_col, source_col, number), block, per_shard, seed)
    kept = (plan.where("hi > lo").groupBy(F.col("uid").alias(number), "epoch", F.col("size").alias(size))
            .agg(F.sum(F.col("hi") - F.col("lo")).alias(taken),
                 F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias(parts))
            .select(number, size, taken, parts))
    words = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD}" + r"[\x20\x09-\x0D]*)"), F.lit(1))
    out = base.join(kept, number).withColumn(cut, F.when(F.col(taken) < F.col(size), words))
    part = F.array_join(F.flatten(F.transform(F.col(parts), lambda p: F.slice(
        F.col(cut), p["lo"].cast("int") + 1, (p["hi"] - p["lo"]).cast("int")))), "")
    out = out.withColumn(text_col, F.when(F.col(taken) < F.col(size), F.rtrim(part)).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast("long"))
    return out.select(*docs.columns)
