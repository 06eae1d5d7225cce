"""Small helpers shared by the text operators.

Conventions of every operator in this folder: a null text counts as empty;
extra input columns are ignored (only the named ones are selected, so clashing
names cannot reach the plan); an empty table gives an empty result with the
same schema; rows are never dropped, capped or sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage, ensure_checkpoint_dir, ship_package  # noqa: F401

#: white space and words of the contracts (ASCII blanks only)
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> None:
    """Shared checkpoint folder and the package on the workers' path."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Column names that ``docs`` does not have yet, whatever the case: the given
    ones, with underscores added where they are taken."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan (file bytes for a scan); 0 where
    it knows nothing, as for rows that came from the driver."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def lookup_by_run(rows: DataFrame, keys: list[str], answers: DataFrame) -> DataFrame:
    """Left join of ``rows`` with ``answers`` (one row per key) that no hot key
    can overload.

    ``rows`` carries ``run``, the input partition it came from.  The distinct
    (key, run) pairs are formed with a map-side combine, so a key that holds a
    third of all rows shrinks to at most one pair per input partition before
    the first shuffle; only these pairs meet the answers.  The rows then join
    on (key, run): the rows of one pair are part of one input partition."""
    asked = rows.select("run", *keys).distinct()
    answered = asked.join(answers, keys, "left")
    return rows.join(answered, ["run", *keys], "left")
