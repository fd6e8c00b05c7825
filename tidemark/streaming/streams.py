"""Incremental forms of the archive operators with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import curation


def deduplicated(stream: DataFrame, keys: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """STR-01: rows of a stream without repeats of their keys that come within the delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def coarse_bars(ticks: DataFrame, minutes: int = 5, delay: str | None = None) -> DataFrame:
    """STR-02: bars of so many minutes from ticks (symbol, ts, seq, price); the same function for a stream and a table."""
    x = ticks.withWatermark("ts", delay) if delay else ticks
    order = F.struct("ts", "seq")
    g = x.groupBy(F.window("ts", f"{minutes} minutes"), "symbol").agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("n_ticks"))
    return g.select(F.col("window.start").alias("bar_at"), "symbol", "open", "high", "low", "close", "n_ticks")


def merge_latest(stream: DataFrame, root: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """STR-03: each batch merged by key and date into root, the last by `order` winning; only touched dates are rewritten."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(root).join(batch.select("date").distinct(), "date", "left_semi").select(*batch.columns)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            old = batch.limit(0)
        best = curation.prefer(old.unionByName(batch), keys, [F.desc(c) for c in order])
        staged = f"{checkpoint}-staged/{epoch}"
        best.write.mode("overwrite").parquet(staged)  # never read and overwrite one path in one plan
        spark.read.parquet(staged).repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(root)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def available_from(df: DataFrame, at: str, days: int) -> DataFrame:
    """STR-04: the first date on which a row may be used: so many days after the day of its time."""
    return df.withColumn("available_at", F.date_add(F.to_date(at), days))
