"""Session helpers: one place that builds a session and finds shared storage.

Lineage is cut only with reliable ``checkpoint()`` or a written table under
``spark.checkpoint.dir``; the folder is read from the session.  A folder of
our own is chosen only when the setting is absent *and* the master is local
(tests, laptops); on a cluster an absent setting is an error, because a
machine-local folder is not visible to other executors.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings
import zipfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # larger Arrow batches: fewer Python round trips in the grouped/partition passes
    "spark.sql.execution.arrow.maxRecordsPerBatch": "50000",
    "spark.ui.enabled": "false",
    # local mode runs everything in the driver JVM; on a cluster the
    # submitter's settings win (the builder only fills what is unset)
    "spark.driver.memory": "16g",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "ledgerlens",
                  extra: dict | None = None) -> SparkSession:
    """A session with our defaults.  What the submitter has set (master, memory,
    shuffle partitions, ...) stays: a default only fills what is unset."""
    conf = {**DEFAULT_CONF, "spark.master": master, "spark.app.name": app,
            "spark.sql.shuffle.partitions": str(shuffle_partitions), **(extra or {})}
    given = _submitted()
    builder = SparkSession.builder
    for k, v in conf.items():
        if k not in given:
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def _submitted() -> set[str]:
    """Keys the submitter has set: under spark-submit the JVM is up already and
    holds them."""
    if "PYSPARK_GATEWAY_PORT" not in os.environ:
        return set()
    SparkContext._ensure_initialized()
    return {k for k, _ in SparkConf().getAll()}


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``ledgerlens`` importable in the Python workers.

    Grouped and partition passes (``applyInPandas``/``mapInPandas``) pickle
    their functions by module reference, so every worker must import this
    package.  A session built elsewhere (a notebook, a job driver) may not
    have it on the workers' path; ``addPyFile`` of a zip of the package is
    the run-time form of ``--py-files`` and reaches every executor, also
    ones started later.  Once per application."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:                      # a session without a driver context (Spark Connect)
        app = None
    if (app or id(spark)) in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="ledgerlens-pkg-"), "ledgerlens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    try:
        if app is not None:
            spark.sparkContext.addPyFile(out)
        else:
            spark.addArtifacts(out, pyfile=True)
    except Exception as e:                 # workers may import it already (package on their path)
        warnings.warn(f"could not ship ledgerlens to the Python workers: {e}")
    _SHIPPED.add(app or id(spark))


def _is_local(spark: SparkSession) -> bool:
    """All tasks in the driver's own process (``local-cluster`` is not that)."""
    return spark.sparkContext.master.split("[")[0] == "local"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting it from the session conf.

    Order: the context's folder, then ``spark.checkpoint.dir``; only on a
    local master do we fall back to a fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written intermediate table, beside the checkpoints."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_SCRATCH: dict[str, list[str]] = {}


def scratch_tables(spark: SparkSession) -> list[str]:
    """Intermediate tables this application has written and not dropped."""
    return list(_SCRATCH.get(spark.sparkContext.applicationId, []))


def drop_scratch(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete intermediate tables (by default all this application has written);
    call it once the results that read them are stored.  Lazy results still need
    them, so nothing is deleted behind a caller's back.  Returns how many went."""
    mine = _SCRATCH.get(spark.sparkContext.applicationId, [])
    gone = [p for p in (mine if paths is None else paths) if p in mine]
    for p in list(gone):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        mine.remove(p)
    return len(gone)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder
    and read it back.

    One job (an eager ``checkpoint()`` computes the plan twice: once to count,
    once to write), the files survive executor loss, and later readers get
    column pruning and filter pushdown on the materialised table."""
    path = scratch_path(df.sparkSession, "t")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def fitted_params(df: DataFrame, max_rows: int = 10_000) -> list:
    """Collect a fitted-parameter table (one row per column or group of a
    fixed, small set — e.g. quantiles of the feature columns).  The bound is
    checked: parameter tables never grow with the data."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"parameter table exceeds {max_rows} rows")
    return rows


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: bytes of a generated method above which HotSpot only interprets it
METHOD_BYTES = 8000
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def compiled_methods(spark: SparkSession) -> None:
    """Let Spark split a stage's code where its one method would be too large to be
    compiled (its documented setting for HotSpot): stages over many nested expressions
    are several times faster.  What the submitter has set stays."""
    if spark.conf.get(_METHOD_LIMIT, "65535") == "65535":
        spark.conf.set(_METHOD_LIMIT, str(METHOD_BYTES))


#: rows of a task that sorts or hashes them, so that it stays in memory
TASK_ROWS = 500_000


def sized_partitions(spark: SparkSession, df: DataFrame) -> int:
    """Partitions for an exchange of ``df``: the session's number, more for a table
    whose tasks would hold over ``TASK_ROWS`` rows.  Counts the rows."""
    return max(shuffle_partitions(spark), -(-df.count() // TASK_ROWS))


os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")
