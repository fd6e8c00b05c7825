"""Sources, sinks and streams on temporary folders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import curation
from tidemark.sources import tables as io
from tidemark.streaming import streams

D = dt.date
SCHEMA = T.StructType([T.StructField("date", T.DateType()), T.StructField("symbol", T.StringType()), T.StructField("v", T.LongType())])


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_only_changed_dates_are_rewritten(spark, tmp_path):
    root = str(tmp_path / "t")
    io.write_by_date(rows(spark, (D(2026, 1, 1), "A", 1), (D(2026, 1, 2), "A", 2)), root)
    io.write_by_date(rows(spark, (D(2026, 1, 1), "A", 9), (D(2026, 1, 2), "A", 8)), root, rows(spark, (D(2026, 1, 2), "A", 0)))
    assert sorted((r.date.day, r.v) for r in io.scan(spark, root).collect()) == [(1, 1), (2, 8)]
    assert io.scan(spark, root, "2026-01-01", ["v"]).count() == 1


def test_missing_tables_are_empty(spark, tmp_path):
    assert io.optional(spark, str(tmp_path / "none"), SCHEMA).count() == 0
    io.write_by_date(rows(spark, (D(2026, 1, 1), "A", 1)), str(tmp_path / "a"))
    got = io.multi_root(spark, [str(tmp_path / "none"), str(tmp_path / "a")], SCHEMA, "2026-01-01", "2026-01-31")
    assert got.count() == 1


def test_compaction(spark, tmp_path):
    root, staging = str(tmp_path / "news"), str(tmp_path / "staging")
    a, b = rows(spark, (D(2026, 1, 1), "A", 1), (D(2026, 1, 1), "B", 2)), rows(spark, (D(2026, 1, 1), "A", 1), (D(2026, 1, 1), "C", 3))
    a.write.partitionBy("date").parquet(root)
    b.write.mode("append").partitionBy("date").parquet(root)
    r = io.compact(spark, root, staging, ["symbol"], dry_run=True).first()
    assert (r.rows_in, r.rows_written, r.duplicates_dropped) == (4, 3, 1)
    io.compact(spark, root, staging, ["symbol"]).collect()
    assert spark.read.parquet(staging).count() == 3


def test_upsert_and_append(spark):
    old, new = rows(spark, (D(2026, 1, 1), "A", 1), (D(2026, 1, 1), "B", 2)), rows(spark, (D(2026, 1, 1), "B", 5))
    assert sorted((r.symbol, r.v) for r in curation.upsert(old, new, ["date", "symbol"]).collect()) == [("A", 1), ("B", 5)]
    m = old.withColumn("m", F.create_map(F.lit("k"), "v"))
    assert curation.append_distinct(m, m).count() == 2


def test_stream_dedup_and_bars(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1, 10)
    ticks = [("A", t0 + dt.timedelta(minutes=m), m, float(m)) for m in (0, 1, 4, 6, 6, 12)]
    df = spark.createDataFrame(ticks, "symbol string, ts timestamp, seq int, price double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.deduplicated(stream, ["symbol", "seq"], "ts").writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("dedup").count() == 5
    q = streams.coarse_bars(stream, 5, "1 minute").writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("bars").collect())) == sorted(map(tuple, streams.coarse_bars(df).collect()))


def test_stream_merge_keeps_the_latest(spark, tmp_path):
    schema = "date date, symbol string, v bigint, seen int"
    for i, data in enumerate(([(D(2026, 1, 1), "A", 1, 1), (D(2026, 1, 2), "A", 5, 1)], [(D(2026, 1, 1), "A", 2, 2), (D(2026, 1, 1), "A", 7, 1)])):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = streams.merge_latest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), ["date", "symbol"], ["seen"])
        q.awaitTermination(60)
        assert q.exception() is None, i
    assert sorted((r.date.day, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 2), (2, 5)]
