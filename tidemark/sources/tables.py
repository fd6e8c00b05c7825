"""Reading and writing partitioned tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F


def scan(spark: SparkSession, root: str, cutoff: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """SRC-01: a date-partitioned table up to a date; the filter prunes partitions."""
    df = spark.read.parquet(root)
    df = df.where(F.col("date") <= F.lit(cutoff).cast("date")) if cutoff else df
    return df.select(*columns) if columns else df


def optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC-04: a table, or an empty one of this schema if the path isn't there or holds none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def multi_root(spark: SparkSession, roots: list[str], schema: T.StructType, start: str, end: str) -> DataFrame:
    """SRC-02, SET-01: several roots by name as one table within the dates; missing roots and corrupt files are left out."""
    out = spark.createDataFrame([], schema)
    for r in roots:
        try:
            part = spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(r)
        except AnalysisException:
            continue
        out = out.unionByName(part, allowMissingColumns=True)
    return out.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def partition_report(spark: SparkSession, roots: list[str], schema: T.StructType, key: str = "date", expected: DataFrame | None = None) -> DataFrame:
    """SRC-04: root, part, files, read_files, bytes, rows, status of every partition `key`=part below the roots, and of the expected ones (a column part).

    Files are listed without their contents; rows are counted by the file that they come from. status: read, partly (some
    file gave no row), skipped (no file did: unreadable or empty), missing (expected, and not there in that root). Roots
    that aren't there have no files.
    """
    same = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")  # noqa: E731  the two sources write authorities differently
    part = F.regexp_extract("file", rf"/{key}=([^/]+)/", 1)
    report = None
    for root in roots:
        try:
            listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(same(F.col("path")).alias("file"), "length")
            rows = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).option("recursiveFileLookup", True).parquet(root)
            counted = rows.groupBy(same(F.col("_metadata.file_path")).alias("file")).agg(F.count("*").alias("rows"))
        except AnalysisException:
            listed = spark.createDataFrame([], "file string, length bigint")
            counted = spark.createDataFrame([], "file string, rows bigint")
        x = listed.join(counted, "file", "left").withColumn("part", F.url_decode(part)).where("part <> ''")
        x = x.groupBy("part").agg(F.count("*").alias("files"), F.count("rows").alias("read_files"), F.sum("length").alias("bytes"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
        if expected is not None:
            x = x.join(expected.select(F.col("part").cast("string").alias("part")).distinct(), "part", "full")
        x = x.select(F.lit(root).alias("root"), "part", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "read_files", "bytes", "rows")))
        report = x if report is None else report.unionByName(x)
    status = F.when(F.col("files") == 0, "missing").when(F.col("read_files") == 0, "skipped").when(F.col("read_files") < F.col("files"), "partly").otherwise("read")
    return report.withColumn("status", status)


def write_by_date(df: DataFrame, root: str, changed: DataFrame | None = None) -> None:
    """SNK-01: partitioned by date; only the dates in df (or changed) are rewritten."""
    x = df.join(changed.select("date").distinct(), "date", "left_semi") if changed is not None else df
    x.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(root)


def coerced(df: DataFrame, schema: T.StructType) -> DataFrame:
    """SNK-06: columns of the schema in its types; what doesn't convert, or isn't there, is null; other columns go."""
    have = set(df.columns)
    return df.select(*((F.col(f.name).cast("string").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def compact(spark: SparkSession, root: str, staging: str, order: list[str], dry_run: bool = False) -> DataFrame:
    """SNK-05: per date rows in, rows kept and duplicates dropped; unless dry, the compacted table is written to staging, never in place."""
    df = spark.read.parquet(root)
    kept = df.dropDuplicates()
    if not dry_run:
        kept.repartition("date").sortWithinPartitions("date", *order).write.mode("overwrite").partitionBy("date").parquet(staging)
    a, b = df.groupBy("date").agg(F.count("*").alias("rows_in")), kept.groupBy("date").agg(F.count("*").alias("rows_written"))
    return a.join(b, "date").withColumn("duplicates_dropped", F.col("rows_in") - F.col("rows_written"))


def sorted_output(df: DataFrame, root: str, order: list[str]) -> None:
    """SRT-01: one folder a date, each in canonical order: equal tables give equal files whatever order their rows came in."""
    df.repartition("date").sortWithinPartitions("date", *order).write.mode("overwrite").partitionBy("date").parquet(root)


def write_artifacts(frames: dict[str, DataFrame], root: str) -> DataFrame:
    """SNK-07: each named table (predictions, targets, prices, equity) below root; artifact, rows and columns of what was written. A row a table."""
    out = None
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        one = df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}").agg(F.lit(name).alias("artifact"), F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


def contract(spark: SparkSession, tables: dict[str, DataFrame], required: dict[str, list[str]]) -> DataFrame:
    """SNK-08: per dataset its rows, latest date, number of columns, missing required columns and state. A row a dataset."""
    out = None
    for name, df in tables.items():
        missing = [c for c in required.get(name, []) if c not in df.columns]
        latest = F.max("date") if "date" in df.columns else F.lit(None).cast("date")
        one = df.agg(F.lit(name).alias("dataset"), F.count("*").alias("rows"), latest.alias("latest"), F.lit(len(df.columns)).alias("columns"), F.lit(",".join(missing)).alias("missing"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("state", F.when(F.col("missing") != "", "schema_mismatch").when(F.col("rows") == 0, "empty").otherwise("available"))
