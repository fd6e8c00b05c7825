"""Queries on sinks, sources of several roots and streams: tables are written to the shared folder and read again, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import panel
from ..sources import payloads as p
from ..sources import tables as io
from ..sources.folders import fresh, written
from ..streaming import streams
from . import tables as t
from .tables import query, rounded

_MONTHLY = "m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_orderpriority AS symbol, count(*) AS v FROM orders GROUP BY 1, 2)"
_SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("v", T.LongType()), T.StructField("date", T.DateType())])


def _monthly(spark, d):
    """Orders by month and priority: one partition a month."""
    return t.table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("date"), F.col("o_orderpriority").alias("symbol")).agg(F.count("*").alias("v"))


@query(f"WITH {_MONTHLY} SELECT date, symbol, CASE WHEN date >= DATE '1997-01-01' THEN 2 * v ELSE v END AS v FROM m")
def snk_01_rewrite_changed(spark, d):
    """SNK-01: a table by date, of which only the changed dates are rewritten."""
    root, m = fresh(spark, "by-date"), _monthly(spark, d)
    io.write_by_date(m, root)
    io.write_by_date(m.withColumn("v", F.col("v") * 2), root, m.where("date >= DATE '1997-01-01'"))
    return io.scan(spark, root).select("date", "symbol", "v")


@query(f"WITH {_MONTHLY} SELECT date, 2 * count(*) AS rows_in, count(*) AS rows_written, count(*) AS duplicates_dropped, string_agg(symbol, ',' ORDER BY symbol) AS symbols FROM m GROUP BY 1")
def snk_05_srt_01_compaction(spark, d):
    """SNK-05, SRT-01: an archive with every row twice, compacted into one sorted file a date."""
    root, staging, m = fresh(spark, "archive"), fresh(spark, "compacted"), _monthly(spark, d)
    for _ in range(2):
        m.write.mode("append").partitionBy("date").parquet(root)
    counts = io.compact(spark, root, staging, ["symbol"])
    ordered = spark.read.parquet(staging).withColumn("_file", F.input_file_name()).withColumn("_at", F.monotonically_increasing_id())
    kept = ordered.groupBy("date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_file", "_at", "symbol"))), lambda x: x["symbol"]), ",").alias("symbols"))
    return counts.join(kept, "date")


@query(f"WITH {_MONTHLY} SELECT date, symbol, v FROM m")
def srt_01_canonical_output(spark, d):
    root = fresh(spark, "sorted")
    io.sorted_output(_monthly(spark, d), root, ["symbol"])
    return spark.read.parquet(root).select("date", "symbol", "v")


@query("SELECT 'predictions' AS artifact, count(*) AS rows, 3 AS columns FROM scores UNION ALL SELECT 'targets', count(*), 3 FROM scores UNION ALL SELECT 'prices', count(*), 3 FROM bars")
def snk_07_artifacts(spark, d):
    b = written(t.bars(spark, d).select("date", "symbol", "close"), "bars")
    s = written(t.scores(spark, d, b), "scores")  # two artifacts are made of it
    frames = {"predictions": s.select("date", "symbol", F.col("score").alias("prediction")), "targets": s.select("date", "symbol", "label_5d"), "prices": b}
    return io.write_artifacts(frames, fresh(spark, "artifacts"))


@query(f"WITH {_MONTHLY} SELECT date, symbol, v, CASE WHEN date >= DATE '1998-01-01' THEN 'late' END AS note FROM m WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")
def src_02_multi_root(spark, d):
    """SRC-02, SET-01: two roots with other columns and a missing one, within dates."""
    a, b, m = fresh(spark, "root"), fresh(spark, "root"), _monthly(spark, d)
    m.where("date < DATE '1998-01-01'").write.partitionBy("date").parquet(a)
    m.where("date >= DATE '1998-01-01'").withColumn("note", F.lit("late")).write.partitionBy("date").parquet(b)
    x = io.multi_root(spark, [a, fresh(spark, "missing"), b], _SCHEMA, "1996-01-01", "2000-12-31")
    return x.select("date", "symbol", "v", "note")


@query(f"WITH {_MONTHLY} SELECT 'there' AS source, date, symbol, v FROM m")
def src_04_optional(spark, d):
    """SRC-04: a table that is there and one that isn't, of the same schema."""
    root = fresh(spark, "optional")
    _monthly(spark, d).write.partitionBy("date").parquet(root)
    one = io.optional(spark, root, _SCHEMA).select(F.lit("there").alias("source"), "date", "symbol", "v")
    return one.unionByName(io.optional(spark, fresh(spark, "missing"), _SCHEMA).select(F.lit("missing").alias("source"), "date", "symbol", "v"))


@query("SELECT event_id, ts, user_id FROM events")
def str_01_stream_dedup(spark, d):
    """STR-01: a stream that brings every event twice, by a file sink."""
    source, sink, check = fresh(spark, "stream"), fresh(spark, "archive"), fresh(spark, "stream-state")
    e = t.table(spark, d, "events").select("event_id", "ts", "user_id")
    e.unionByName(e).write.parquet(source)
    stream = spark.readStream.schema(e.schema).parquet(source)
    q = streams.deduplicated(stream.withColumn("ts", F.col("ts").cast("timestamp")), ["event_id"], "ts").writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(sink).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id")


@query(f"WITH {_MONTHLY} SELECT date, symbol, CASE WHEN date >= DATE '1997-01-01' THEN v + 1 ELSE v END AS v, CASE WHEN date >= DATE '1997-01-01' THEN 2 ELSE 1 END AS seen FROM m")
def str_03_stream_merge(spark, d):
    """STR-03: two batches merged into a table by date, the later seen value winning."""
    source, root, check, m = fresh(spark, "stream"), fresh(spark, "canonical"), fresh(spark, "stream-state"), _monthly(spark, d)
    first = m.select("date", "symbol", "v", F.lit(1).alias("seen"))
    second = m.where("date >= DATE '1997-01-01'").select("date", "symbol", (F.col("v") + 1).alias("v"), F.lit(2).alias("seen"))
    for batch in (first, second.unionByName(first)):
        batch.write.mode("append").parquet(source)
        streams.merge_latest(spark.readStream.schema(first.schema).parquet(source), root, check, ["date", "symbol"], ["seen"]).awaitTermination()
    return spark.read.parquet(root).select("date", "symbol", "v", "seen")


@query("SELECT date, symbol, close FROM bars WHERE symbol IN (SELECT DISTINCT symbol FROM bars ORDER BY symbol LIMIT 5)")
def prj_18_first_events(spark, d):
    """PRJ-18: the rows of the first five ids; a limit is the feature."""
    return p.first_events(t.bars(spark, d).select("date", "symbol", "close"), "symbol", 5)


_ITEMS = ("3.02", "4.01", "2.04")
_FAMILIES = {"3.02": "dilution", "4.01": "auditor", "2.04": "default"}
# what tag stripping, entities and white space make of a text, in SQL
_CLEAN = r"trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({}, '<(script|style)\b.*?</(script|style)>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))".replace('\\"', '"')


@query(f"""
WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '3.02' WHEN 1 THEN '4.01' ELSE '2.04' END AS item, text FROM conversations),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, item ORDER BY turn) AS rn FROM c),
sections AS (SELECT conv_id, 'item_section' AS snippet_kind, '8-K' AS document_type, 'complete.txt' AS filename, item, substr({_CLEAN.format("'Item ' || item || ' ' || text")}, 1, 300) AS text, item AS route FROM u WHERE rn = 1),
exhibits AS (SELECT a.conv_id, 'exhibit' AS snippet_kind, 'EX-99.' || a.turn AS document_type, 'ex' || a.turn || '.htm' AS filename, NULL AS item, substr({_CLEAN.format("a.text")}, 1, 300) AS text, b.item AS route FROM conversations a JOIN u b ON b.conv_id = a.conv_id AND b.rn = 1 WHERE a.turn % 4 = 1 AND {_CLEAN.format("a.text")} <> ''),
every AS (SELECT * FROM sections UNION ALL SELECT * FROM exhibits),
named AS (SELECT *, 'sec8k_semantic_' || substr(sha256(conv_id || ':' || snippet_kind || ':' || coalesce(item, 'None') || ':' || document_type || ':' || filename || ':' || sha256(text)), 1, 20) AS snippet_id, CASE route WHEN '3.02' THEN 'dilution' WHEN '4.01' THEN 'auditor' ELSE 'default' END AS route_family, 'sec_item_' || route || '_targeted_for_semantic_mvp' AS route_reason FROM every)
SELECT snippet_id, min(conv_id) AS conv_id, min(snippet_kind) AS snippet_kind, min(document_type) AS document_type, min(filename) AS filename, min(item) AS item, sha256(min(text)) AS text_sha, arg_min(route_family, route_reason) AS route_family, min(route_reason) AS route_reason FROM named GROUP BY 1
""")
def evt_05_semantic_queue(spark, d):
    """EVT-05: complete filings made of conversations (an item section a turn, some turns as exhibits), routed to three item families."""
    c = t.table(spark, d, "conversations").select("conv_id", "turn", "text")
    item = F.element_at(F.array(*map(F.lit, _ITEMS)), (F.col("turn") % 3 + 1).cast("int"))
    heading = F.concat(F.lit("Item "), item, F.lit(" "), F.coalesce("text", F.lit("")))
    block = lambda kind, name, body: F.concat(F.lit("<DOCUMENT>\n<TYPE>"), kind, F.lit("\n<FILENAME>"), name, F.lit("\n<TEXT>"), body, F.lit("</TEXT>\n</DOCUMENT>"))
    number = F.col("turn").cast("string")
    exhibit = F.when(F.col("turn") % 4 == 1, block(F.concat(F.lit("EX-99."), number), F.concat(F.lit("ex"), number, F.lit(".htm")), F.coalesce("text", F.lit("")))).when(F.col("turn") % 4 == 2, block(F.lit("EX-101.INS"), F.lit("x.xml"), F.col("text")))
    parts = F.array_sort(F.collect_list(F.struct("turn", heading.alias("h"), exhibit.alias("e"))))
    g = c.groupBy("conv_id").agg(parts.alias("parts"))
    text = F.concat(block(F.lit("8-K"), F.lit("main.htm"), F.array_join(F.transform("parts", lambda x: x["h"]), "\n")), F.lit("\n"), F.array_join(F.transform("parts", lambda x: x["e"]), "\n"))
    candidates = c.select("conv_id", item.alias("sec_item"), F.lit("2025-04-01").cast("date").alias("accepted_at")).distinct()
    x = p.semantic_snippets(g.select("conv_id", text.alias("complete")), candidates, "conv_id", "complete", "sec_item", _FAMILIES, 300)
    return x.select("snippet_id", "conv_id", "snippet_kind", "document_type", "filename", "item", F.sha2("text", 256).alias("text_sha"), "route_family", "route_reason")


@query("""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'evidence_quote_not_exact:0:@@ not there @@,evidence_supports_missing:0' WHEN 2 THEN 'contract_award_not_marked_material_candidate,field_value_blank:dates:0,missing_evidence,missing_materiality_evidence_for_contract_award,promotable_event_not_material_candidate'
  WHEN 3 THEN 'invalid_certainty:null,missing_required_keys:certainty,fields_not_object,numeric_confidence_key_forbidden:score,short_rationale_not_string,unexpected_keys:extra' WHEN 4 THEN 'evidence_not_object:0,field_not_string_list:dates,field_value_blank:dates:0,invalid_event_type:OTHER,missing_field_keys:counterparties' END AS errors,
  CASE doc_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 6 WHEN 4 THEN 4 ELSE -1 END AS n_blocking FROM documents
""".replace("'invalid_certainty:null,missing_required_keys:certainty,fields_not_object,", "'fields_not_object,invalid_certainty:null,missing_required_keys:certainty,"))
def evt_06_payload_validation(spark, d):
    """EVT-06: payloads with faults of every kind about the documents' texts."""
    x = t.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("doc_id") % 6
    names = lambda skip=(): [n for n in p.FIELDS if n not in skip]
    fields = lambda changed, skip=(): "{" + ", ".join(f'"{n}": {changed.get(n, "[]")}' for n in names(skip)) + "}"
    good = ("DILUTIVE_FINANCING", "clear", "yes")
    body = lambda values, f, evidence, rest='"exclusion_reasons": [], "short_rationale": "so"': '{' + ", ".join(f'"{a}": "{b}"' for a, b in zip(p.PAYLOAD_KEYS, values)) + f', "fields": {f}, "evidence": {evidence}, {rest}' + '}'
    quote = F.to_json(F.struct(F.substring(F.trim(F.substring_index("text", "\n", 1)), 1, 12).alias("quote"), F.lit("x").alias("supports")))
    exact = F.concat(F.lit(body(good, fields({}), "@@")).substr(F.lit(1), F.lit(1 << 20)))
    exact = F.replace(exact, F.lit("@@"), F.concat(F.lit("["), F.when(F.trim(F.substring_index("text", "\n", 1)) != "", quote).otherwise(F.lit('{"quote": "?", "supports": "x"}')), F.lit("]")))
    third = '{"event_type": "ROUTINE_NO_EVENT", "is_material_candidate": "no", "fields": [1, {"score": 2}], "evidence": [], "exclusion_reasons": [], "short_rationale": 5, "extra": "a \\"probability\\": 1"}'
    json = (
        F.when(k == 0, exact).when(k == 1, F.lit(body(good, fields({}), '[{"quote": "@@ not there @@", "supports": " "}]')))
        .when(k == 2, F.lit(body(("MATERIAL_CONTRACT_AWARD", "mixed", "no"), fields({"dates": '[" "]'}), "[]"))).when(k == 3, F.lit(third))
        .when(k == 4, F.lit(body(("OTHER", "clear", "no"), fields({"dates": "[1]"}, ("counterparties",)), '["a"]'))).otherwise(F.lit("no answer"))
    )
    y = x.withColumn("payload", json).withColumn("errors", p.payload_errors("payload", "text"))
    return y.select("doc_id", F.array_join("errors", ",").alias("errors"), F.coalesce(F.size(p.blocking_errors(F.col("errors"))), F.lit(-1)).alias("n_blocking"))
