"""Incremental intake of capture files (survey §2.8, ST1).

The reference re-lists and re-reads every capture file on a daily schedule.
Here a Structured Streaming file source remembers what it has read (in its
checkpoint), ``trigger(availableNow=True)`` processes whatever is new and
stops — the daily job — and ``foreachBatch`` parses each micro-batch (A16)
and writes it under ``batch=<id>`` with overwrite, so a retried batch
replaces its own output instead of appending twice.  An optional baseline
turns every batch into a drift report (G21).  With ``state_dir`` every batch also
stores its monitoring state there, and with ``baseline_dir`` (a state kept by an
earlier intake or by ``baseline.store_batch``) it is checked against that state's
statistics and constraints; old rows are not read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import baseline as B
from ledgerlens.operators import monitor as MON
from ledgerlens.sources.files import parse_capture


def run_intake(spark: SparkSession, source_dir: str, out_dir: str, checkpoint_dir: str, record_schema: str,
               files_per_batch: int | None = None, baseline: DataFrame | None = None,
               drift_cols: Sequence[str] = (), state_dir: str | None = None, baseline_dir: str | None = None,
               category_cols: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Process every capture file not yet seen; returns the output tables (empty
    ones before the first file).  ``files_per_batch`` splits the intake into
    micro-batches; by default all waiting files form one.  ``drift`` needs a
    baseline (``baseline``: statistics, else the state in ``baseline_dir``) and
    ``drift_cols``; ``violations`` needs ``baseline_dir``.  The two folders must
    differ, or a batch would be checked against itself."""
    if state_dir and state_dir == baseline_dir:
        raise ValueError("state_dir and baseline_dir must differ")
    kept = B.read_state(spark, baseline_dir) if baseline_dir else None
    if baseline is None and kept is not None:
        baseline = B.merged_stats(kept)
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.load(source_dir)

    def batch(df: DataFrame, epoch_id: int) -> None:
        lines = df.persist()
        try:
            records, status = parse_capture(lines, record_schema)
            records.write.mode("overwrite").parquet(f"{out_dir}/records/batch={epoch_id}")
            status.write.mode("overwrite").parquet(f"{out_dir}/status/batch={epoch_id}")
            state = B.batch_state(records, drift_cols, category_cols) if kept is not None or state_dir else None
            if baseline is not None and drift_cols:
                cur = MON.baseline_stats(records, drift_cols) if kept is None else B.merged_stats(state)
                MON.feature_drift(baseline, cur).write.mode("overwrite").parquet(f"{out_dir}/drift/batch={epoch_id}")
            if kept is not None:
                B.violations(B.constraints(kept), kept, state).write.mode("overwrite").parquet(f"{out_dir}/violations/batch={epoch_id}")
            if state_dir:
                B.store_batch(records, state_dir, epoch_id, drift_cols, category_cols)
        finally:
            lines.unpersist()

    q = (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    none = spark.createDataFrame([], "value string")
    records, status = parse_capture(none, record_schema)
    empty = {"records": records, "status": status}
    if baseline is not None and drift_cols:
        empty["drift"] = MON.feature_drift(baseline, baseline).limit(0)
    if kept is not None:
        empty["violations"] = B.violations(B.constraints(kept), kept, kept).limit(0)
    return {name: _written(spark, f"{out_dir}/{name}", df) for name, df in empty.items()}


def _written(spark: SparkSession, path: str, empty: DataFrame) -> DataFrame:
    """The table at ``path``, or ``empty`` where nothing was written yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else empty


def capture_lines(events: DataFrame) -> DataFrame:
    """Capture-log lines for the events table: one JSON envelope per event,
    payload a JSON string holding the record — an object for even event ids,
    a one-element list for odd ones (the log holds both shapes)."""
    rec = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    payload = F.when(F.col("event_id") % 2 == 0, rec).otherwise(F.concat(F.lit("["), rec, F.lit("]")))
    env = F.struct(F.struct(F.struct(payload.alias("data"), F.lit("JSON").alias("encoding")).alias("endpointInput"))
                   .alias("captureData"),
                   F.struct(F.col("event_id").cast("string").alias("eventId"),
                            F.col("ts").cast("string").alias("inferenceTime")).alias("eventMetadata"))
    return events.select(F.to_json(env).alias("value"))


EVENT_RECORD = "struct<event_id: bigint, user_id: bigint, event_type: string, value: double>"
