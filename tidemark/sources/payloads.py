"""Landed payloads to tables: JSON, XML and submission text, all with built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import first_existing, reasons, short_id


def bars_from_json(df: DataFrame, payload: str) -> DataFrame:
    """SRC-05: {"bars": {symbol: [{t (epoch ms), o, h, l, c, v, vw, n}]}} to date, symbol, open, high, low, close, volume, vwap, trade_count."""
    kind = "struct<bars: map<string, array<struct<t: bigint, o: double, h: double, l: double, c: double, v: bigint, vw: double, n: bigint>>>>"
    x = df.select(F.explode(F.from_json(payload, kind)["bars"]).alias("symbol", "rows")).select("symbol", F.explode("rows").alias("b"))
    return x.select(F.to_date(F.timestamp_millis("b.t")).alias("date"), "symbol", F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.v").alias("volume"), F.col("b.vw").alias("vwap"), F.col("b.n").alias("trade_count"))


def ticks_with_ids(df: DataFrame, source: str, kind: str) -> DataFrame:
    """SRC-06: ticks (symbol, ts, price) with an id that depends on their content alone."""
    return df.withColumn("event_id", F.sha2(F.concat_ws("|", F.lit(source), F.lit(kind), F.col("symbol").cast("string"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.format_string("%.4f", "price")), 256))


def flat_snapshots(df: DataFrame, payload: str) -> DataFrame:
    """SRC-07: nested snapshots in camel or snake case to one flat row; greeks if there are any."""
    trade, quote = "struct<p: double, s: bigint>", "struct<bp: double, ap: double>"
    x = F.from_json(payload, f"struct<symbol: string, latestTrade: {trade}, latest_trade: {trade}, latestQuote: {quote}, latest_quote: {quote}, greeks: map<string, double>>")
    s = df.select(x.alias("x"))
    return s.select("x.symbol", F.coalesce("x.latestTrade.p", "x.latest_trade.p").alias("trade_price"), F.coalesce("x.latestQuote.bp", "x.latest_quote.bp").alias("bid"), F.coalesce("x.latestQuote.ap", "x.latest_quote.ap").alias("ask"), F.try_element_at("x.greeks", F.lit("delta")).alias("delta"))


def news_rows(df: DataFrame, symbols: str) -> DataFrame:
    """SRC-08: a symbols value (comma list or array) to sorted upper-case symbols and the primary one."""
    raw = F.col(symbols) if dict(df.dtypes)[symbols].startswith("array") else F.split(symbols, ",")
    x = F.array_sort(F.array_distinct(F.filter(F.transform(raw, lambda s: F.upper(F.trim(s))), lambda s: s != "")))
    return df.withColumn("symbols", x).withColumn("primary_symbol", F.try_element_at("symbols", F.lit(1)))


def split_ratio(value) -> F.Column:
    """SRC-09: "a:b" as b / a (a price factor), a plain number n as 1 / n; null if neither."""
    parts = F.split(value, ":")
    pair = F.try_divide(F.try_element_at(parts, F.lit(2)).try_cast("double"), F.try_element_at(parts, F.lit(1)).try_cast("double"))
    return F.when(F.size(parts) == 2, pair).otherwise(F.try_divide(F.lit(1.0), value.try_cast("double")))


def metrics_from_maps(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """SRC-10, PRJ-17: a JSON object of metrics to long rows; values that are no numbers are left out."""
    x = df.select(*keys, F.explode(F.from_json(payload, "map<string, string>")).alias("metric_name", "raw"))
    return x.select(*keys, "metric_name", F.col("raw").try_cast("double").alias("metric_value")).where("metric_value IS NOT NULL")


def filings_of_forms(df: DataFrame, start: str, end: str, forms: tuple[str, ...] = ("8-K", "10-K", "10-Q")) -> DataFrame:
    """SRC-11: filings of these forms within the dates."""
    return df.where(F.col("form").isin(*forms) & F.col("filing_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def company_facts(df: DataFrame, payload: str, concepts: list[str]) -> DataFrame:
    """SRC-12: namespace, concept, unit and facts to long rows of the listed concepts, available the day after filing."""
    fact = "struct<end: date, filed: date, val: double, form: string>"
    kind = f"struct<cik: string, facts: map<string, map<string, struct<units: map<string, array<{fact}>>>>>>"
    x = df.select(F.from_json(payload, kind).alias("j")).select("j.cik", F.explode("j.facts").alias("ns", "c")).select("cik", "ns", F.explode("c").alias("concept", "u")).where(F.col("concept").isin(concepts))
    x = x.select("cik", "ns", "concept", F.explode("u.units").alias("unit", "f")).select("cik", "ns", "concept", "unit", F.explode("f").alias("f"))
    return x.select("cik", F.col("f.end").alias("metric_date"), F.concat_ws(":", "ns", "concept", "unit").alias("metric_name"), F.col("f.val").alias("metric_value"), F.date_add("f.filed", 1).alias("available_at"))


def index_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: line, file, file_hash of every line of index files: text is scanned by line, the SHA-256 of each file's content comes from one scan of whole files."""
    whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("file_hash"))
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    name = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")  # noqa: E731  the two sources write authorities differently
    return lines.withColumn("_f", name("file")).join(whole.select(name("file").alias("_f"), "file_hash"), "_f").drop("_f")


def index_manifest(df: DataFrame, line: str, forms: tuple[str, ...]) -> DataFrame:
    """SRC-13: index lines to manifest rows of these forms; other columns of df stay, other lines are left out.

    A line's layout is its own: `cik|company|form|date|file`, or columns of spaces in the order form, company, cik, date,
    file. The accession is the file's name in its path.
    """
    f = F.split(line, r"\|")
    piped = F.contains(line, F.lit("|"))
    fixed = lambda i: F.regexp_extract(F.trim(line), r"^(\S+(?: \S+)*?)\s{2,}(.+?)\s{2,}(\d{1,10})\s+(\d{4}-\d{2}-\d{2})\s+(edgar/data/\d+/.+?\.txt)\s*$", i)
    part = lambda at, group: F.when(piped, F.trim(F.get(f, at))).otherwise(fixed(group))
    kept = [F.col(c) for c in df.columns if c != line]
    x = df.where(~piped | (F.size(f) == 5)).select(*kept, part(0, 3).alias("cik"), part(1, 2).alias("company"), part(2, 1).alias("form"), F.try_to_date(part(3, 4), "yyyy-MM-dd").alias("filed_date"), part(4, 5).alias("filename"))
    in_path = F.regexp_extract("filename", r"edgar/data/\d+/(?:\d+/)?([^/]+)\.txt$", 1)
    accession = F.when(in_path != "", in_path).otherwise(F.regexp_extract("filename", r"(\d{10}-\d{2}-\d{6})", 1))
    return x.where(F.col("form").isin(*forms) & F.col("filed_date").isNotNull()).withColumn("accession", accession).withColumn("accession_no_dashes", F.replace("accession", F.lit("-"), F.lit("")))


def document_blocks(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """SRC-14, EVT-02: a complete submission to its document blocks: number, type, file name, body, item numbers in the body."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?is)<DOCUMENT>(.*?)</DOCUMENT>"), 1)
    x = df.select(*keys, F.posexplode(blocks).alias("number", "block"))
    tag = lambda t: F.trim(F.regexp_extract("block", rf"(?i)<{t}>([^\n<]*)", 1))
    body = F.regexp_extract("block", r"(?is)<TEXT>(.*)</TEXT>", 1)
    return x.select(*keys, "number", tag("TYPE").alias("type"), tag("FILENAME").alias("filename"), body.alias("body"), items(body).alias("items"))


def items(text) -> F.Column:
    """Sorted item numbers (d.dd) that a text names after the word item."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)\bItem\s+([1-9]\.\d{2})\b"), 1)))


def ownership_transactions(df: DataFrame, keys: list[str], xml: str) -> DataFrame:
    """SRC-15: ownership XML to its non-derivative transactions; shares and price stay exact decimals."""
    value = "struct<value: string>"
    row = f"struct<securityTitle: {value}, transactionDate: {value}, transactionCoding: struct<transactionCode: string>, transactionAmounts: struct<transactionShares: {value}, transactionPricePerShare: {value}>>"
    kind = f"struct<issuer: struct<issuerCik: string, issuerTradingSymbol: string>, nonDerivativeTable: struct<nonDerivativeTransaction: array<{row}>>>"
    x = df.select(*keys, F.from_xml(xml, kind).alias("d")).select(*keys, "d.issuer.*", F.posexplode("d.nonDerivativeTable.nonDerivativeTransaction").alias("line", "t"))
    return x.select(
        *keys, F.col("issuerCik").alias("issuer_cik"), F.col("issuerTradingSymbol").alias("ticker"), "line", F.col("t.securityTitle.value").alias("title"), F.col("t.transactionDate.value").try_cast("date").alias("traded_on"),
        F.col("t.transactionCoding.transactionCode").alias("code"), F.col("t.transactionAmounts.transactionShares.value").try_cast("decimal(38,10)").alias("shares"), F.col("t.transactionAmounts.transactionPricePerShare.value").try_cast("decimal(38,10)").alias("price"),
    )


SEMANTIC = "struct<event_type: string, certainty: string, is_material_candidate: string, evidence: array<struct<quote: string, supports: string>>, short_rationale: string>"


def model_payloads(df: DataFrame, raw: str) -> DataFrame:
    """SRC-16: a model's answer to its JSON object: what stands from the first opening to the last closing brace."""
    return df.withColumn("payload", F.from_json(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), SEMANTIC))


def batch_ids(expected: DataFrame, got: DataFrame, key: str, item: str) -> DataFrame:
    """SRC-16: per batch the ids missing, unexpected and given twice."""
    a = expected.groupBy(key).agg(F.collect_set(item).alias("want"))
    b = got.groupBy(key).agg(F.collect_set(item).alias("have"), (F.count(item) - F.count_distinct(item)).alias("twice"))
    none = F.array().cast(dict(a.dtypes)["want"])
    x = a.join(b, key, "full").select(key, F.coalesce("want", none).alias("want"), F.coalesce("have", none).alias("have"), F.coalesce("twice", F.lit(0)).alias("twice"))
    return x.select(key, F.size(F.array_except("want", "have")).alias("missing"), F.size(F.array_except("have", "want")).alias("unexpected"), "twice")


def contradictions(payload: str, excerpt: str) -> F.Column:
    """SRC-16: sorted contradictions of a parsed payload (model_payloads): no payload or type, a quote that isn't an exact part of the excerpt, a promotable type that isn't material."""
    p = F.col(payload)
    quotes = F.forall(p["evidence"], lambda e: F.contains(F.col(excerpt), e["quote"]))
    return reasons(
        [("missing_payload", p.isNull()), ("missing_event_type", p.isNotNull() & p["event_type"].isNull()), ("quote_not_in_excerpt", ~F.coalesce(quotes, F.lit(True))), ("promotable_not_material", (p["event_type"] != "none") & (p["is_material_candidate"] != "yes"))]
    )


# Keys, values and error names of the semantic payload format.
EVENT_TYPES = ("DILUTIVE_FINANCING", "AUDITOR_TROUBLE", "DEBT_DEFAULT_COVENANT_STRESS", "CUSTOMER_LOSS", "MATERIAL_CONTRACT_AWARD", "ROUTINE_NO_EVENT", "NEEDS_REVIEW")
PROMOTABLE_TYPES = EVENT_TYPES[:5]
CERTAINTIES = ("clear", "mixed", "ambiguous", "insufficient")
MATERIAL = ("yes", "no", "unknown")
FIELDS = ("money_amounts", "share_or_warrant_terms", "counterparties", "dates", "trigger_terms", "materiality_evidence")
PAYLOAD_KEYS = ("event_type", "certainty", "is_material_candidate", "fields", "evidence", "exclusion_reasons", "short_rationale")
FORBIDDEN_KEYS = ("confidence", "confidence_score", "probability", "probabilities", "score", "scores", "numeric_confidence")
NOT_BLOCKING = ("field_value_not_exact:", "field_value_blank:")
BLOCKING_FIELD = "materiality_evidence"


def payload_errors(payload: str, excerpt: str, expected_type: str | None = None, expected_material: str | None = None) -> F.Column:
    """EVT-06: sorted errors of a semantic payload (a JSON object as text) about an excerpt; null where there is no object.

    Missing and unexpected keys, values outside of the format's, keys of forbidden names at any depth, lists that aren't
    lists of strings, evidence that isn't an exact part of the excerpt, promotable types that aren't material. The expected
    values are names of columns; a null there expects nothing.
    """
    text = F.coalesce(F.col(excerpt), F.lit(""))
    value = F.try_parse_json(payload)
    at = lambda path, kind: F.try_variant_get(value, path, kind)
    kind = lambda path: F.coalesce(F.schema_of_variant(at(path, "variant")), F.lit("MISSING"))
    strings = lambda path: kind(path).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.coalesce(F.exists(at(path, "array<string>"), lambda x: x.isNull()), F.lit(False))
    named = lambda holds, name: F.when(holds, F.array(F.lit(name) if isinstance(name, str) else name)).otherwise(F.array().cast("array<string>"))

    def keys(have: F.Column, want: tuple[str, ...], lacks: str, extra: str) -> list[F.Column]:
        want_ = F.array(*map(F.lit, want))
        joined = lambda x: F.array_join(F.array_sort(x), ",")
        return [named(F.size(F.array_except(want_, have)) > 0, F.concat(F.lit(lacks), joined(F.array_except(want_, have)))), named(F.size(F.array_except(have, want_)) > 0, F.concat(F.lit(extra), joined(F.array_except(have, want_))))]

    top = F.json_object_keys(payload)
    inner = F.json_object_keys(F.to_json(at("$.fields", "variant")))
    type_, certainty, material = (F.coalesce(at(f"$.{k}", "string"), F.lit("null")) for k in PAYLOAD_KEYS[:3])
    parts = [
        *keys(top, PAYLOAD_KEYS, "missing_required_keys:", "unexpected_keys:"),
        *(named(~v.isin(*allowed), F.concat(F.lit(name), v)) for v, allowed, name in ((type_, EVENT_TYPES, "invalid_event_type:"), (certainty, CERTAINTIES, "invalid_certainty:"), (material, MATERIAL, "invalid_material_candidate:"))),
        named(inner.isNull(), "fields_not_object"),
        *(F.when(inner.isNotNull(), x).otherwise(F.array().cast("array<string>")) for x in keys(F.coalesce(inner, F.array().cast("array<string>")), FIELDS, "missing_field_keys:", "unexpected_field_keys:")),
        *(named(F.array_contains(F.coalesce(inner, F.array().cast("array<string>")), F.lit(k)) & ~strings(f"$.fields.{k}"), f"field_not_string_list:{k}") for k in FIELDS),
        named(~kind("$.evidence").startswith("ARRAY"), "evidence_not_array"),
        named(~strings("$.exclusion_reasons"), "exclusion_reasons_not_string_list"),
        named(kind("$.short_rationale") != "STRING", "short_rationale_not_string"),
        # a quoted name before a colon is a key; within a string its quotes would be escaped
        F.transform(F.array_distinct(F.transform(F.regexp_extract_all(F.col(payload), F.lit(r'(?i)(?<!\\)"(' + "|".join(FORBIDDEN_KEYS) + r')"\s*:'), 1), F.lower)), lambda k: F.concat(F.lit("numeric_confidence_key_forbidden:"), k)),
    ]
    evidence = F.coalesce(at("$.evidence", "array<variant>"), F.array().cast("array<variant>"))
    string = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    of = lambda e, k: string(F.try_variant_get(e, f"$.{k}", "variant"))
    blank = lambda v: v.isNull() | (F.trim(v) == "")

    def of_evidence(e, i):
        quote, supports = of(e, "quote"), of(e, "supports")
        index = i.cast("string")
        wrong = F.when(blank(quote), F.concat(F.lit("evidence_quote_missing:"), index)).when(~F.contains(text, quote), F.concat_ws(":", F.lit("evidence_quote_not_exact"), index, F.substring(quote, 1, 80)))
        each = F.array_compact(F.array(wrong, F.when(blank(supports), F.concat(F.lit("evidence_supports_missing:"), index))))
        return F.when(F.schema_of_variant(e).startswith("OBJECT"), each).otherwise(F.array(F.concat(F.lit("evidence_not_object:"), index)))

    parts.append(F.flatten(F.transform(evidence, of_evidence)))
    needed = type_.isin(*PROMOTABLE_TYPES) | (material == "yes")
    parts.append(named(needed & (F.size(evidence) == 0), "missing_evidence"))

    def of_field(k: str):
        def check(v, i):
            s = string(v)
            return F.when(blank(s), F.concat_ws(":", F.lit("field_value_blank"), F.lit(k), i.cast("string"))).when(~F.contains(text, s), F.concat_ws(":", F.lit("field_value_not_exact"), F.lit(k), i.cast("string"), F.substring(s, 1, 80)))

        return check

    for k in FIELDS:
        values = F.coalesce(at(f"$.fields.{k}", "array<variant>"), F.array().cast("array<variant>"))
        parts.append(F.array_compact(F.transform(values, of_field(k))))
    for expected, got, name in ((expected_type, type_, "event_type_mismatch"), (expected_material, material, "material_candidate_mismatch")):
        if expected:
            parts.append(named(F.coalesce(F.col(expected) != got, F.lit(False)), F.concat(F.lit(f"{name}:expected="), F.coalesce(F.col(expected), F.lit("")), F.lit(":actual="), got)))
    award = type_ == "MATERIAL_CONTRACT_AWARD"
    proof = F.coalesce(F.exists(at(f"$.fields.{BLOCKING_FIELD}", "array<string>"), lambda v: ~blank(v)), F.lit(False))
    parts += [named(award & ~proof, "missing_materiality_evidence_for_contract_award"), named(award & (material != "yes"), "contract_award_not_marked_material_candidate"), named(type_.isin(*PROMOTABLE_TYPES) & (material != "yes"), "promotable_event_not_material_candidate")]
    return F.when(top.isNotNull(), F.array_sort(F.concat(*parts)))


def blocking_errors(errors) -> F.Column:
    """EVT-06: those errors that block a payload: all but values of fields that aren't exact or are blank, and these too for materiality evidence."""
    minor = lambda e: (F.startswith(e, F.lit(NOT_BLOCKING[0])) | F.startswith(e, F.lit(NOT_BLOCKING[1]))) & (F.split_part(e, F.lit(":"), F.lit(2)) != BLOCKING_FIELD)
    return F.filter(errors, lambda e: ~minor(e))


def routed(df: DataFrame, item: str, targets: dict[str, str] | None = None) -> DataFrame:
    """EVT-05: rows with route_family and route_reason: all of one broad family, or only those of targeted items (item to family)."""
    if targets is None:
        return df.withColumn("route_family", F.lit("broad_8k")).withColumn("route_reason", F.lit("broad_header_only_semantic_probe"))
    family = F.try_element_at(F.create_map(*(F.lit(x) for pair in targets.items() for x in pair)), F.col(item))
    return df.withColumn("route_family", family).where("route_family IS NOT NULL").withColumn("route_reason", F.concat(F.lit("sec_item_"), F.col(item), F.lit("_targeted_for_semantic_mvp")))


def semantic_snippets(filings: DataFrame, candidates: DataFrame, key: str, text: str, item: str, targets: dict[str, str] | None = None, chars: int = 4000, limit: int | None = None) -> DataFrame:
    """EVT-05: the snippet queue of candidates (key, item, accepted_at): item sections and exhibits of their filings (key, complete text).

    The section of an item runs from its first heading in the main 8-K document to the next item's heading; exhibits are the
    EX- documents but machine-readable ones. Tags are out, white space is collapsed, texts are bounded by chars. An id is
    that of the content, and equal ids come once. Sorted rank: sections first, then by time, key, item and file; a limit
    keeps the first ones. One exchange by key; a filing's documents are worked on within its row.
    """
    raw = F.regexp_extract_all(text, F.lit(r"(?is)<DOCUMENT>(.*?)</DOCUMENT>"), 1)
    tag = lambda b, t: F.trim(F.regexp_extract(b, rf"(?i)<{t}>([^\n<]*)", 1))
    body = lambda b: F.when(F.rlike(b, F.lit(r"(?is)<TEXT>.*</TEXT>")), F.regexp_extract(b, r"(?is)<TEXT>(.*?)</TEXT>", 1)).otherwise(b)
    blocks = F.transform(raw, lambda b: F.struct(F.upper(tag(b, "TYPE")).alias("type"), tag(b, "FILENAME").alias("filename"), plain_text(body(b)).alias("text")))
    x = filings.select(key, F.col(text).alias("_text"), blocks.alias("blocks"))
    main = F.filter("blocks", lambda b: b["type"] == "8-K")
    primary = F.when(F.size(main) > 0, F.try_element_at(main, F.lit(1))["text"]).otherwise(plain_text(F.col("_text")))
    cut = F.slice(F.split(F.regexp_replace(primary, r"(?i)\bItem\s+(?=[1-9]\.\d{2}\b)", "\u0001$0"), "\u0001"), 2, 1 << 30)
    sections = F.transform(cut, lambda s: F.struct(F.regexp_extract(s, r"(?i)^Item\s+([1-9]\.\d{2})", 1).alias("item"), F.trim(s).alias("text")))
    exhibits = F.filter("blocks", lambda b: F.startswith(b["type"], F.lit("EX-")) & ~F.startswith(b["type"], F.lit("EX-101")) & (b["type"] != "EX-104") & (b["text"] != ""))
    x = x.select(key, sections.alias("sections"), exhibits.alias("exhibits"))
    c = routed(candidates, item, targets).join(x, key)
    first = F.try_element_at(F.filter("sections", lambda s: s["item"] == F.col(item)), F.lit(1))["text"]
    kind = "array<struct<snippet_kind: string, document_type: string, filename: string, item: string, text: string>>"
    section = F.when(first.isNotNull(), F.array(F.struct(F.lit("item_section"), F.lit("8-K"), F.lit("complete.txt"), F.col(item), F.substring(first, 1, chars)))).otherwise(F.array()).cast(kind)
    others = F.transform("exhibits", lambda e: F.struct(F.lit("exhibit"), e["type"], e["filename"], F.lit(None).cast("string"), F.substring(e["text"], 1, chars))).cast(kind)
    y = c.select(key, "accepted_at", "route_family", "route_reason", F.explode(F.concat(section, others)).alias("s")).select(key, "accepted_at", "route_family", "route_reason", "s.*")
    name = F.concat_ws(":", F.col(key).cast("string"), "snippet_kind", F.coalesce("item", F.lit("None")), "document_type", "filename", F.sha2("text", 256))
    y = y.withColumn("snippet_id", F.concat(F.lit("sec8k_semantic_"), F.substring(F.sha2(name, 256), 1, 20)))
    y = y.groupBy("snippet_id").agg(*(F.min_by(n, F.struct("accepted_at", "route_reason")).alias(n) for n in y.columns if n != "snippet_id"))
    if limit is not None:  # a report of the first ones
        y = y.orderBy(F.desc("snippet_kind"), "accepted_at", key, F.coalesce("item", F.lit("")), "filename", "snippet_id").limit(limit)
    return y


def snippets(df: DataFrame, keys: list[str], text: str, chars: int, most: int) -> DataFrame:
    """PRJ-19, SRT-04: paragraphs as bounded snippets with ids of their content, the `most` longest of each text first."""
    from pyspark.sql import Window

    x = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("number", "part")).where(F.length(F.trim("part")) > 0)
    x = x.withColumn("snippet", F.substring("part", 1, chars)).withColumn("snippet_id", short_id("snp_", *(F.col(k) for k in keys), F.col("number"), F.col("snippet")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.length("part")), "number"))
    return x.withColumn("rank", rank).where(F.col("rank") <= most).drop("part")


def first_events(df: DataFrame, key: str, n: int) -> DataFrame:
    """PRJ-18: the rows of the first n keys. A limit is the feature; the list of keys has n rows."""
    return df.join(F.broadcast(df.select(key).distinct().orderBy(key).limit(n)), key, "left_semi")


def holders(docs: DataFrame, needles: DataFrame) -> DataFrame:
    """Section 2.8, exact evidence: (doc_id, item_id) of the documents (doc_id, text) that hold a needle (item_id, needle) as a substring.

    A needle of three or more words has an inner word, which a holder has as a whole word: candidates share the longest one.
    Others can begin and end within words, so their candidates share the first three characters (or all, if fewer) anywhere.
    """
    inner = F.split("needle", r"[ \n]")
    longest = F.element_at(F.array_sort(F.slice(inner, 2, F.size(inner) - 2), lambda a, c: F.length(c) - F.length(a)), 1)
    b = needles.withColumn("key", F.when(F.size(inner) > 2, longest))
    found = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", r"[ \n]"))).alias("key")).join(b.where("key IS NOT NULL").select("item_id", "key"), "key").select("doc_id", "item_id")
    short = b.where("key IS NULL").select("item_id", F.substring("needle", 1, 3).alias("key"))
    for n in (r[0] for r in short.select(F.length("key").alias("n")).distinct().collect()):  # at most three lengths
        grams = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))"), 1))).alias("key"))
        found = found.unionByName(grams.join(short.where(F.length("key") == n), "key").select("doc_id", "item_id"))
    return found.distinct().join(docs, "doc_id").join(needles, "item_id").where("contains(text, needle)").select("doc_id", "item_id")


def plain_text(html) -> F.Column:
    """Tags out, the five named entities in, white space collapsed."""
    x = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def mapped(df: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """SRC-20: a reference payload's columns by a declarative map of candidate names."""
    return df.select(*(first_existing(df, names).alias(out) for out, names in fields.items()))


def action_union(splits: DataFrame | None, dividends: DataFrame | None, combined: DataFrame | None) -> DataFrame | None:
    """SRC-19: corporate actions from three layouts as symbol, event_type, ex_date, ratio, amount."""
    parts = []
    if splits is not None:
        parts.append(splits.select("symbol", F.lit("split").alias("event_type"), "ex_date", F.col("ratio").cast("double").alias("ratio"), F.lit(None).cast("double").alias("amount")))
    if dividends is not None:
        parts.append(dividends.select("symbol", F.lit("dividend").alias("event_type"), "ex_date", F.lit(None).cast("double").alias("ratio"), F.col("amount").cast("double").alias("amount")))
    if combined is not None:
        parts.append(combined.select("symbol", "event_type", "ex_date", "ratio", "amount"))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out
