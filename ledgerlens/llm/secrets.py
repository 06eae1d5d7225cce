"""Secret scans with multipart credential linking.

Base kinds are found by pattern: assignments, access identifiers, long hex
runs.  The parts of a credential are often spread over a few lines, and each
alone is weak evidence: a bare mixed token may be anything, and so may a host
name.  Weak candidates are therefore reported only when a complementary part
stands within ``scope`` code points, from the end of one to the start of the
other: an interval join of the parts of a document, done as running windows over
their positions in both directions, so no pairs are formed.

* ``key``: a token of 32 or more letters, digits, +, /, - or _ with both cases and
  digits, and its padding (one or two =); reported beside an access identifier, an
  assignment or an endpoint.  There is no upper length.
* ``endpoint``: an http(s) address or a connection address; reported beside an
  access identifier, an assignment or a ``key``.

Everything is DataFrame expressions; a document's text never leaves its row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut_lineage, text_of

#: fixed patterns: kind -> (pattern, least length, group whose length counts)
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    "access": (r"AKIA[A-Z0-9]+", 20, 0),
    "hex": (r"[0-9a-f]+", 24, 0),
}
WEAK = {
    "endpoint": (r"(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|ftp)://[A-Za-z0-9.:@/_%+~?=&#-]+", 12, 0),
    "key": (r"[A-Za-z0-9+/_-]+={0,2}", 32, 0),
}
KINDS = [*BASE, *WEAK]
#: the kinds that complete a weak part
COMPLETES = {"endpoint": ("access", "assign", "key"), "key": ("access", "assign", "endpoint")}
SCOPE = 200


def search_pattern(kind: str) -> str:
    """A run of one class is matched whole or not at all, so its pattern may ask
    for the least length itself."""
    return {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}", "key": r"[A-Za-z0-9+/_-]{32,}={0,2}"}.get(
        kind, {**BASE, **WEAK}[kind][0])


def found(text: Column, kind: str) -> Column:
    """Array of (rank, i, gap, len, ok) for all leftmost non-overlapping matches:
    the code points between the match before and this one, its own, and whether
    it passes its kind's checks."""
    _, least, group = {**BASE, **WEAK}[kind]
    pattern = search_pattern(kind)
    # splitting at the matches leaves the gaps between them
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"),
                          F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("counts"))

    def one(x: Column, i: Column) -> Column:
        ok = F.length(x["counts"]) >= least
        if kind == "key":
            ok = ok & x["m"].rlike("[0-9]") & x["m"].rlike("[a-z]") & x["m"].rlike("[A-Z]")
        return F.struct(F.lit(KINDS.index(kind)).alias("rank"), i.alias("i"), F.length(x["gap"]).alias("gap"),
                        F.length(x["m"]).alias("len"), ok.alias("ok"))

    return F.transform(F.filter(zipped, lambda x: x["m"].isNotNull()), one)


def find_parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, doc_id, parts) for every row, written once: the only pass over the
    texts.  ``parts`` holds base spans and weak candidates."""
    base = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    return cut_lineage(base.select("uid", "doc_id", F.concat(*[found(F.col("t"), k) for k in KINDS]).alias("parts")))


def place_parts(rows: DataFrame) -> DataFrame:
    """(uid, start, end, rank): a match starts after all gaps and matches of its
    kind before it."""
    upto = W.partitionBy("uid", "rank").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = rows.select("uid", F.explode("parts").alias("p")).select("uid", "p.*")
    parts = parts.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto))
    return parts.where("ok").select("uid", (F.col("end") - F.col("len")).alias("start"), "end", "rank")


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The spans that are reported: all base spans, and the weak candidates with a
    complementary part at most ``scope`` code points away (from the end of one to
    the start of the other; parts that touch or overlap are 0 away).

    Of the parts that start before a candidate the one that ends last is nearest,
    of those after it the one that starts first: two running windows, whose work
    grows with the parts, however many lie within the scope."""
    before = W.partitionBy("uid").orderBy("start", "rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    after = W.partitionBy("uid").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rank = {k: i for i, k in enumerate(KINDS)}
    # a candidate that starts inside a base span is that span, not a part of its own
    parts = parts.withColumn("inside", F.max(F.when(F.col("rank") < len(BASE), F.col("end"))).over(before)).where(
        (F.col("rank") < len(BASE)) | F.col("inside").isNull() | (F.col("inside") <= F.col("start")))
    for kind, others in COMPLETES.items():
        fits = F.col("rank").isin([rank[k] for k in others])
        parts = parts.withColumn(f"{kind}_near", F.coalesce(F.col("start") - F.max(F.when(fits, F.col("end"))).over(before) <= scope, F.lit(False))
                                 | F.coalesce(F.min(F.when(fits, F.col("start"))).over(after) - F.col("end") <= scope, F.lit(False)))
    keep = reduce(lambda c, kind: c.when(F.col("rank") == rank[kind], F.col(f"{kind}_near")), COMPLETES, F.when(F.lit(False), False))
    return parts.where(keep.otherwise(True)).select("uid", "start", "end", "rank")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked for every
    row (null text: no spans, the digest of an empty string)."""
    rows = find_parts(docs, id_col, text_col)
    kept = link_parts(place_parts(rows), scope).groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("s"))
    out = rows.select("uid", "doc_id").join(kept, "uid", "left").withColumn(
        "s", F.coalesce("s", F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")))
    names = F.array(*map(F.lit, KINDS))
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(
        ":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("s", lambda x: x["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("s", lambda x: x["rank"] == KINDS.index(k))).cast("long")
    return out.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                      F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"),
                      F.size(F.filter("s", lambda x: x["rank"] >= len(BASE))).cast("long").alias("n_linked"))
