"""Driver tables and the ``payments`` view built from them.

The payments view maps the star schema onto the payment model:

=====================  ==========================================
payments column        source
=====================  ==========================================
record_id              md5 over every lineitem column (whole rows are unique)
recipient_id           orders.o_custkey
recipient_type         customer.c_mktsegment
recipient_state        nation.n_name (via c_nationkey)
specialty              part.p_type
payer_id / payer_name  lineitem.l_suppkey / supplier.s_name
amount                 lineitem.l_extendedprice
number_of_payments     l_quantity truncated to bigint
date_of_payment        lineitem.l_shipdate
form                   lineitem.l_returnflag
nature                 orders.o_orderpriority
=====================  ==========================================

All joins start from lineitem and are LEFT joins, so a payment never vanishes
because a dimension row is missing.  No join carries a broadcast hint: the
optimizer broadcasts a side only when its size statistics (or, with AQE, its
run-time size) are under ``spark.sql.autoBroadcastJoinThreshold`` and falls
back to a sort-merge join beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

#: stands for NULL in a row key
NULL_MARK = "\\N"

PAYMENT_COLS = ["record_id", "recipient_id", "recipient_type", "recipient_state", "specialty", "payer_id",
                "payer_name", "amount", "number_of_payments", "date_of_payment", "form", "nature"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def record_key(li: DataFrame) -> "F.Column":
    """md5 of the whole lineitem row: doubles with nine decimals, dates as date,
    NULL as a marker of its own (so a value never moves into another column)."""
    parts = []
    for c, t in li.select(*LINEITEM_COLS).dtypes:
        col = F.col(c)
        if t == "double":
            col = col.cast("decimal(30,9)")
        elif t.startswith("timestamp"):
            col = col.cast("date")
        parts.append(F.coalesce(col.cast("string"), F.lit(NULL_MARK)))
    return F.md5(F.concat_ws("|", *parts))


# Which dimension joins each payments column needs (lineitem alone serves the rest).
_NEEDS = {"recipient_id": {"orders"}, "nature": {"orders"}, "recipient_type": {"orders", "customer"},
          "recipient_state": {"orders", "customer", "nation"}, "specialty": {"part"}, "payer_name": {"supplier"}}


def payments(spark: SparkSession, sf_dir: str, columns: list[str] | tuple[str, ...] | None = None) -> DataFrame:
    """The payments view; with ``columns``, only the joins those columns need
    (an empty list keeps the rows and no join; None means every column).

    LEFT joins are never removed by the optimizer (a right side could
    duplicate rows), so a query that reads no supplier column should not pay
    for the supplier join — at scale, that is a shuffle of the largest table.
    """
    cols = list(PAYMENT_COLS) if columns is None else list(columns)
    need = set().union(*[_NEEDS.get(c, set()) for c in cols])
    li = table(spark, sf_dir, "lineitem")
    j = li.select(*([F.unhex(record_key(li)).alias("record_id")] if "record_id" in cols else []), *LINEITEM_COLS)
    if need & {"orders", "customer", "nation"}:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        # the recipient's columns hang on the orders: line items move once, with a key of 16 bytes
        if need & {"customer", "nation"}:
            cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
            if "nation" in need:
                nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
                cust = cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            orders = orders.join(cust, F.col("o_custkey") == F.col("c_custkey"), "left")
        j = j.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if "part" in need:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
        j = j.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    if "supplier" in need:
        supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
        j = j.join(supp, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    exprs = {
        **({"record_id": F.lower(F.hex("record_id"))} if "record_id" in cols else {}),
        "recipient_id": F.col("o_custkey"),
        "recipient_type": F.col("c_mktsegment"),
        "recipient_state": F.col("n_name"),
        "specialty": F.col("p_type"),
        "payer_id": F.col("l_suppkey"),
        "payer_name": F.col("s_name"),
        "amount": F.col("l_extendedprice"),
        "number_of_payments": F.col("l_quantity").cast("bigint"),
        "date_of_payment": F.col("l_shipdate"),
        "form": F.col("l_returnflag"),
        "nature": F.col("o_orderpriority"),
    }
    return j.select(*[exprs[c].alias(c) for c in cols])


# The same view for DuckDB, written independently for the oracle queries.
PAYMENTS_SQL = """
payments AS (
  SELECT md5(concat_ws('|', coalesce(CAST(l.l_orderkey AS VARCHAR), '\\N'),
             coalesce(CAST(l.l_partkey AS VARCHAR), '\\N'),
             coalesce(CAST(l.l_suppkey AS VARCHAR), '\\N'),
             coalesce(CAST(l.l_linenumber AS VARCHAR), '\\N'),
             coalesce(CAST(CAST(l.l_quantity AS DECIMAL(30,9)) AS VARCHAR), '\\N'),
             coalesce(CAST(CAST(l.l_extendedprice AS DECIMAL(30,9)) AS VARCHAR), '\\N'),
             coalesce(CAST(CAST(l.l_discount AS DECIMAL(30,9)) AS VARCHAR), '\\N'),
             coalesce(CAST(CAST(l.l_tax AS DECIMAL(30,9)) AS VARCHAR), '\\N'),
             coalesce(CAST(l.l_returnflag AS VARCHAR), '\\N'),
             coalesce(CAST(l.l_linestatus AS VARCHAR), '\\N'),
             coalesce(CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR), '\\N'))) AS record_id,
         o.o_custkey AS recipient_id,
         c.c_mktsegment AS recipient_type,
         n.n_name AS recipient_state,
         p.p_type AS specialty,
         l.l_suppkey AS payer_id,
         s.s_name AS payer_name,
         l.l_extendedprice AS amount,
         CAST(trunc(l.l_quantity) AS BIGINT) AS number_of_payments,
         l.l_shipdate AS date_of_payment,
         l.l_returnflag AS form,
         o.o_orderpriority AS nature
  FROM lineitem l
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
)"""


def with_payments(sql: str) -> str:
    """Prefix an oracle query with the payments CTE (``WITH`` or ``, name AS``)."""
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + PAYMENTS_SQL.strip() + ",\n" + body[5:]
    return "WITH " + PAYMENTS_SQL.strip() + "\n" + body
