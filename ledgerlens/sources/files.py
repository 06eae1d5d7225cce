"""Sources and sinks (survey §2.1, A1–A17).

Raw files are read with explicit schemas (no full-table inference), written
to a partitioned Parquet lake, registered as session views and validated —
all as Spark jobs.  File metadata (sizes) comes from the ``binaryFile``
source with the ``content`` column pruned, so no file body is read.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.stats import unit_hash

# Fragments of a lower-case column name that force the column to
# text whatever its inferred type (A3), and those that schema validation checks.
FORCE_STRING_PATTERNS = (
    "_name", "_address", "_city", "_state", "_country", "_province",
    "_zip", "_postal", "_code", "_ccn", "_npi", "_id",
    "first_name", "last_name", "middle_name", "suffix",
    "street", "covered_recipient_type", "nature_of", "form_of",
    "physician_specialty", "recipient_primary_", "business_street",
    "teaching_hospital", "applicable_manufacturer", "making_payment")
TEXT_CHECK_PATTERNS = ("name", "address", "city", "id", "npi", "ccn", "zip", "postal")


def normalise_columns(df: DataFrame) -> DataFrame:
    """Lower-case column names (the lake's convention)."""
    return df.toDF(*[c.lower() for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, limit: int | None = None,
             corrupt_col: str | None = "_corrupt_record") -> DataFrame:
    """A1/A2: CSV with header, RFC-4180 quoting (quoted commas stay inside a
    field — T16), empty field = NULL, malformed rows kept with the raw line in
    ``corrupt_col``.  ``limit`` reads the first rows (order not guaranteed)."""
    reader = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
              .option("multiLine", False).option("nullValue", "").option("mode", "PERMISSIVE"))
    if schema is not None:
        if corrupt_col and isinstance(schema, T.StructType) and corrupt_col not in schema.fieldNames():
            schema = T.StructType(list(schema.fields) + [T.StructField(corrupt_col, T.StringType())])
        reader = reader.schema(schema)
        if corrupt_col:
            reader = reader.option("columnNameOfCorruptRecord", corrupt_col)
    df = normalise_columns(reader.csv(path))
    return df.limit(limit) if limit else df


def force_string(schema: T.StructType, patterns: Sequence[str] = FORCE_STRING_PATTERNS) -> T.StructType:
    """A3: every field whose lower-case name contains a pattern becomes STRING."""
    out = []
    for f in schema.fields:
        hit = any(p in f.name.lower() for p in patterns)
        out.append(T.StructField(f.name, T.StringType(), True) if hit else f)
    return T.StructType(out)


def infer_schema(spark: SparkSession, path: str, sample_rows: int = 1000) -> T.StructType:
    """A3: types inferred from the first ``sample_rows`` lines (the scan stops
    there), then names that say text forced to STRING."""
    lines = spark.read.text(path)
    header = lines.first()[0]
    rows = lines.where(F.col("value") != header).limit(sample_rows)       # every part file repeats the header
    sample = (spark.read.option("inferSchema", True).option("quote", '"').option("escape", '"')
              .csv(rows.rdd.map(lambda r: r[0])))
    return force_string(normalise_columns(sample.toDF(*next(csv.reader([header])))).schema)


def register_view(spark: SparkSession, name: str, path: str, fmt: str = "parquet", options: dict | None = None
                  ) -> DataFrame:
    """A4/A5: register files as a session view (no metastore, no server) and
    return ``DESCRIBE`` of it."""
    opts = ", ".join(f"{k} '{v}'" for k, v in {"path": path, **(options or {})}.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} USING {fmt} OPTIONS ({opts})")
    return spark.sql(f"DESCRIBE {name}")


def _name(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def create_external_table(spark: SparkSession, name: str, path: str, schema: T.StructType, fmt: str = "parquet",
                          partition_cols: Sequence[str] = (), options: dict | None = None, replace: bool = False) -> DataFrame:
    """A4: a table of the session's own catalog over files that stay where they
    are (CSV, Parquet, JSON, ...).  ``schema`` names all columns; those of
    ``partition_cols`` come from the folder names, and the partitions that exist
    are found at once.  An existing table of that name is an error unless
    ``replace``.  Returns the table; dropping it leaves the files."""
    quoted = lambda text: "'" + str(text).replace("\\", "\\\\").replace("'", "\\'") + "'"
    if replace:
        drop_table(spark, name)
    columns = ", ".join(f"{_name(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    given = ", ".join(f"{quoted(k)} = {quoted(v)}" for k, v in (options or {}).items())
    spark.sql(f"CREATE TABLE {_name(name)} ({columns}) USING {fmt}" + (f" OPTIONS ({given})" if given else "")
              + (f" PARTITIONED BY ({', '.join(map(_name, partition_cols))})" if partition_cols else "") + f" LOCATION {quoted(path)}")
    if partition_cols:
        recover_partitions(spark, name)
    return spark.table(_name(name))


def recover_partitions(spark: SparkSession, name: str) -> None:
    """A5: take up partition folders that were added since."""
    spark.sql(f"ALTER TABLE {_name(name)} RECOVER PARTITIONS")


def show_tables(spark: SparkSession, pattern: str = "*") -> DataFrame:
    """A5: (name, temporary) of the current database's tables and views."""
    return spark.sql("SHOW TABLES LIKE '" + pattern.replace("'", "\\'") + "'").select(
        F.col("tableName").alias("name"), F.col("isTemporary").alias("temporary"))


def describe_table(spark: SparkSession, name: str) -> DataFrame:
    """A5: (column, data_type, partition) of a table's columns."""
    cols = spark.catalog.listColumns(_name(name))
    return spark.createDataFrame([(c.name, c.dataType, c.isPartition) for c in cols], "column string, data_type string, partition boolean")


def show_partitions(spark: SparkSession, name: str) -> DataFrame:
    """A5: the partitions the catalog knows, as ``column=value`` text."""
    return spark.sql(f"SHOW PARTITIONS {_name(name)}")


def drop_table(spark: SparkSession, name: str) -> None:
    """A5: drop a table if it exists; an external table's files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {_name(name)}")


def schema_violations(df: DataFrame, patterns: Sequence[str] = TEXT_CHECK_PATTERNS) -> DataFrame:
    """Columns whose name says text (ids, codes, names) but whose type is numeric."""
    rows = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType) and force_string(T.StructType([f]), patterns)[0].dataType == \
                T.StringType():
            rows.append((f.name, f.dataType.simpleString(), "text-like column typed numeric"))
    return df.sparkSession.createDataFrame(rows, "column string, data_type string, problem string")


def write_lake(df: DataFrame, path: str, partition_cols: Sequence[str] = ("program_year",),
               mode: str = "overwrite") -> DataFrame:
    """Partitioned Parquet (snappy); returns the table read back, so
    later filters on the partition columns prune directories."""
    (df.write.mode(mode).option("compression", "snappy").partitionBy(*partition_cols).parquet(path))
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with header and quoting."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def storage_sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """A10: files and bytes per labelled folder, and % saved against the first
    label.  Only file metadata is read (``content`` is pruned)."""
    parts = []
    for label, p in paths.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p)
        parts.append(files.where(~F.col("path").rlike(r"/(_SUCCESS|\.[^/]*)$")).agg(
            F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes")).withColumn("label", F.lit(label)))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    first = parts[0].select("bytes").scalar()
    return out.select("label", "n_files", "bytes",
                      F.round((1 - F.col("bytes") / first) * 100, 2).alias("pct_saved_vs_first"))


def validate_lake(df: DataFrame, expected_cols: Sequence[str], partition_col: str | None = None) -> DataFrame:
    """(check, passed, detail) rows: readable, non-empty, columns present,
    partitions present — every statistic from one aggregate."""
    spark = df.sparkSession
    missing = [c for c in expected_cols if c not in df.columns]
    aggs = [F.count(F.lit(1)).alias("n")]
    if partition_col and partition_col in df.columns:
        aggs.append(F.countDistinct(partition_col).alias("parts"))
    a = df.agg(*aggs)
    n = a.select("n").scalar()
    checks = [spark.range(1).select(F.lit("table_readable").alias("check"), F.lit(True).alias("passed"),
                                    F.lit(f"{len(df.columns)} columns").alias("detail")),
              spark.range(1).select(F.lit("has_rows").alias("check"), (n > 0).alias("passed"),
                                    F.concat(n.cast("string"), F.lit(" rows")).alias("detail")),
              spark.range(1).select(F.lit("columns_present").alias("check"), F.lit(not missing).alias("passed"),
                                    F.lit(",".join(missing) or "all present").alias("detail"))]
    if partition_col and partition_col in df.columns:
        parts = a.select("parts").scalar()
        checks.append(spark.range(1).select(F.lit("partitions_present").alias("check"), (parts > 0).alias("passed"),
                                            F.concat(parts.cast("string"), F.lit(" partitions")).alias("detail")))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def sequential_extract(df: DataFrame, n: int) -> DataFrame:
    """The first n rows in file order (file path, then row index inside
    the file, from the hidden ``_metadata`` column)."""
    rows = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"))
    # a file's first n rows are enough of it: the sort never sees more
    return rows.where(F.col("_i") < n).orderBy("_f", "_i").limit(n).drop("_f", "_i")


def random_extract(df: DataFrame, key: str, n: int, seed: int = 42, require: str | None = None) -> DataFrame:
    """N rows by md5(key ‖ seed), optionally only rows where
    ``require`` is not NULL (``WHERE amount IS NOT NULL ORDER BY RAND()``)."""
    src = df.where(F.col(require).isNotNull()) if require else df
    return src.withColumn("_h", unit_hash(key, seed)).orderBy("_h", key).limit(n).drop("_h")


# ---------------------------------------------------------------- A15, G26
DICTIONARY_SCHEMA = ("data struct<fields: array<struct<name: string, description: string, type: string, "
                     "constraints: string>>>")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Data-dictionary JSON (``data.fields[]``) → one row per field."""
    raw = spark.read.option("multiLine", True).schema(DICTIONARY_SCHEMA).json(path)
    return raw.select(F.explode("data.fields").alias("f")).select("f.name", "f.description", "f.type", "f.constraints")


def dictionary_lookup(fields: DataFrame, name: str | None = None, keyword: str | None = None) -> DataFrame:
    """One field by its exact name (whole description; the accessors'
    defaults where an entry is missing), or a case-insensitive keyword search
    over names and descriptions (first 100 characters + '...')."""
    out = fields
    if name is not None:
        out = out.where(F.col("name") == name)
    if keyword is not None:
        k = keyword.lower()
        out = out.where(F.lower("name").contains(k) | F.lower(F.coalesce("description", F.lit(""))).contains(k))
    if keyword is not None:
        text = F.concat(F.substring(F.coalesce("description", F.lit("")), 1, 100), F.lit("..."))
    else:
        text = F.coalesce("description", F.lit("No description available"))
    return out.select("name", F.coalesce("type", F.lit("Unknown")).alias("type"),
                      F.coalesce("constraints", F.lit("{}")).alias("constraints"), text.alias("description"))


# ---------------------------------------------------------------- A16
CAPTURE_SCHEMA = "struct<captureData: struct<endpointInput: struct<data: string, encoding: string>>, " \
                 "eventMetadata: struct<eventId: string, inferenceTime: string>>"


def parse_capture(lines: DataFrame, record_schema: str, text_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Capture-log lines → one row per scored record, plus (status, n)
    counts of good and bad lines.  The payload is a JSON *string* holding one
    object or a list of objects: parse the envelope, then the payload as an
    array (wrapping a single object)."""
    env = lines.select(F.from_json(F.col(text_col), CAPTURE_SCHEMA).alias("e"), F.col(text_col).alias("_raw"))
    payload = F.trim(F.col("e.captureData.endpointInput.data"))
    as_array = F.when(payload.startswith("["), payload).otherwise(F.concat(F.lit("["), payload, F.lit("]")))
    parsed = env.select(F.col("e.eventMetadata.eventId").alias("capture_id"),
                        F.from_json(as_array, f"array<{record_schema}>").alias("_recs"))
    good = parsed.where(F.col("_recs").isNotNull())
    records = good.select("capture_id", F.explode("_recs").alias("r")).select("capture_id", "r.*")
    status = parsed.groupBy(F.when(F.col("_recs").isNull(), "bad").otherwise("ok").alias("status")).agg(
        F.count(F.lit(1)).alias("n_lines"))
    return records, status
