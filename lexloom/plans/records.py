"""Queries of sources, citations, scopes, queue, sync, recovery and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.packs import GENERIC, GENERIC_PAGES
from ..operators import acts, citations, contains, export, manifest, markers, quality, queueing, recovery, structure, sync
from ..sources import files, scratch
from ..streaming import capture
from .queries import _CITED, _FAILED, _FLAGS, _LINES, _VER, _failures
from .registry import ENC, found, merged_sql, n_of, query, table

# ---- sources and sinks: what is written is read back


@query("SELECT event_type AS operation, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, min(ts) AS first_at FROM events GROUP BY event_type")
def log_round_trip(spark, sf):
    path = scratch.folder(spark, "log")
    e = table(spark, sf, "events").select(F.col("event_id").alias("log_id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("operation"))
    files.append_log(e.where("log_id % 2 = 0"), path)
    files.append_log(e.where("log_id % 2 = 1"), path)
    return files.log(spark, path).groupBy("operation").agg(F.count("*").alias("n"), F.sum("log_id").alias("ids"), F.min("timestamp").alias("first_at"))


@query("SELECT source AS volume_number, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) FILTER (length(text) > 0) AS n_hashed FROM documents GROUP BY source")
def volume_files(spark, sf):
    path = scratch.folder(spark, "volumes")
    d = table(spark, sf, "documents").select(F.col("text").alias("content_raw"), F.col("source").alias("volume_number"), T.content_hash(F.col("text")).alias("content_raw_sha256"))
    files.write_by_volume(d, path)
    back = spark.read.schema(files.ACT).json(path)
    ok = F.sha2("content_raw", 256) == F.col("content_raw_sha256")
    return back.groupBy("volume_number").agg(F.count("*").alias("n"), F.sum(F.length("content_raw")).cast("long").alias("n_chars"), F.count(F.when(ok, 1)).alias("n_hashed"))


@query("SELECT CAST(user_id AS VARCHAR) AS act_number, 'failed' AS extraction_status, arg_max(event_type, (ts, event_id)) AS failure_reason, count(*) AS attempts FROM events WHERE value > 40 GROUP BY user_id")
def failed_files(spark, sf):
    path = scratch.folder(spark, "failed")
    e = table(spark, sf, "events").where("value > 40").groupBy(F.col("user_id").cast("string").alias("act_number")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("failure_reason"), F.count("*").alias("attempts"))
    files.write_failed(e.withColumns({"extraction_status": F.lit("failed"), "title": F.lit(None).cast("string")}), path)
    return files.failed(spark, path, multi_line=False).select("act_number", "extraction_status", "failure_reason", "attempts")


@query("SELECT count(*) AS total_acts, count(DISTINCT source) AS total_volumes, CAST(sum(n_chars) AS BIGINT) AS total_characters, CAST(0 AS BIGINT) AS missing_records FROM documents")
def manifest_file(spark, sf):
    path, schema = scratch.folder(spark, "manifest"), "total_acts bigint, total_volumes bigint, total_characters bigint"
    none = files.read_or_empty(spark, path, schema).count()  # there is none yet
    files.write_record(manifest.stats(table(spark, sf, "documents"), "source", "n_chars"), path)
    return files.read_or_empty(spark, path, schema).withColumn("missing_records", F.lit(none).cast("long"))


@query("SELECT count(*) AS n, TRUE AS second_choice FROM labels")
def readable_source(spark, sf):
    rows, other = files.first_readable(spark, [f"{sf}/no_such_table.parquet", f"{sf}/labels.parquet"])
    return rows.agg(F.count("*").alias("n")).withColumn("second_choice", F.lit(other))


@query("SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'Disabled' WHEN event_id % 6 = 1 THEN 'Setup required' WHEN event_id % 6 = 2 THEN 'Permission lost' WHEN event_id % 6 = 3 THEN 'Error' WHEN event_id % 6 = 4 THEN 'Syncing' ELSE 'Ready' END AS label, CASE WHEN event_id % 6 = 0 THEN 'neutral' WHEN event_id % 6 = 1 THEN 'warning' WHEN event_id % 6 IN (2, 3) THEN 'danger' WHEN event_id % 6 = 4 THEN 'info' ELSE 'success' END AS tone, event_id % 6 < 4 AS paused FROM events")
def sync_status(spark, sf):
    k = F.col("event_id") % 6
    text = lambda test: F.when(test, F.lit("x"))
    s = sync.status(k != 0, text(k != 1), F.when(k == 2, "denied").otherwise("granted"), text(k == 3), k == 4)
    return table(spark, sf, "events").select("event_id", s.alias("s")).select("event_id", "s.label", "s.tone", "s.paused")


# ---- text


@query("SELECT doc_id, length(text) || '_' || CAST(list_sum(list_transform(string_split(text, ''), lambda c: unicode(c))) AS BIGINT) AS checksum FROM documents WHERE length(text) > 0 UNION ALL SELECT doc_id, '0_0' FROM documents WHERE coalesce(length(text), 0) = 0")
def text_checksum(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.checksum(F.col("text")).alias("checksum"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN CAST(user_id AS VARCHAR) END AS said FROM events")
def first_nonblank(spark, sf):
    k = F.col("event_id") % 3
    return table(spark, sf, "events").select("event_id", T.first_of(F.when(k == 0, F.col("event_type")).otherwise("  "), F.when(k == 1, F.col("user_id").cast("string")).otherwise("\t")).alias("said"))


@query("SELECT doc_id, CAST(strpos(text, 'the ') - 1 AS INTEGER) AS first_the, CAST(CASE WHEN strpos(text, ' of ') = 0 THEN -1 ELSE strpos(text, 'of') - 1 END AS INTEGER) AS of_at FROM documents WHERE text IS NOT NULL")
def offsets(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    t = F.col("text")
    return d.select("doc_id", (F.call_function("locate", F.lit("the "), t) - 1).alias("first_the"), F.when(F.contains(t, F.lit(" of ")), T.offset_of(t, F.lit(" of "))).otherwise(-1).alias("of_at"))


@query(f"WITH {_CITED} SELECT doc_id, position, regexp_replace(substr(text, greatest(position - 50, 0) + 1, position - greatest(position - 50, 0)), '^\\s+|\\s+$', '', 'g') AS context_before, regexp_replace(substr(text, position + length(citation_text) + 1, 50), '^\\s+|\\s+$', '', 'g') AS context_after FROM z")
def citation_context(spark, sf):
    return citations.detect(table(spark, sf, "documents"), GENERIC).select("doc_id", "position", "context_before", "context_after")


@query(f"WITH {_CITED} SELECT doc_id, count(*) AS n_references, 'pattern_based' AS method, string_agg(citation_text, ';' ORDER BY position) AS citations FROM z GROUP BY doc_id")
def citation_envelope(spark, sf):
    e = citations.envelope(citations.detect(table(spark, sf, "documents"), GENERIC))
    return e.select("doc_id", F.col("count").alias("n_references"), "method", F.array_join(F.transform("references", lambda r: r["citation_text"]), ";").alias("citations"))


@query(f"SELECT doc_id, m.kind AS pattern_type, m.position AS position, m.text AS citation_text FROM (SELECT doc_id, unnest({found('text', _VER, 'versioned')}) AS m FROM documents)")
def citation_short(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(citations.short(F.col("text"), GENERIC, (("VERSIONED", "versioned"),))).alias("m"))
    return d.select("doc_id", F.col("m.kind").alias("pattern_type"), F.col("m.position").alias("position"), F.col("m.text").alias("citation_text"))


@query(f"""WITH n AS ({merged_sql(GENERIC.numeric)}), p AS ({merged_sql(GENERIC.protected, 50, 200)}) SELECT n.doc_id, n.region_start, n.region_end, bool_or(p.doc_id IS NOT NULL) AS overlaps_protected FROM n LEFT JOIN p ON n.doc_id = p.doc_id AND n.region_start < p.region_end AND p.region_start < n.region_end GROUP BY ALL""")
def region_overlap(spark, sf):
    c = F.col("text")
    d = table(spark, sf, "documents").where(c.rlike("[0-9]")).select("doc_id", markers.protected_regions(c, GENERIC).alias("p"), F.explode(markers.numeric_regions(c, GENERIC)).alias("n"))
    return d.select("doc_id", F.col("n.start").alias("region_start"), F.col("n.end").alias("region_end"), T.overlaps(F.col("p"), F.col("n.start"), F.col("n.end")).alias("overlaps_protected"))


@query("""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS position, 'link' AS source, CAST(l_partkey AS VARCHAR) AS citation_text FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_linenumber + 1, 'pattern', CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_linestatus = 'F'),
b AS (SELECT *, row_number() OVER (PARTITION BY k, position ORDER BY source, citation_text) AS n FROM a WHERE position >= 2) SELECT k, position, source, citation_text FROM b WHERE n = 1""")
def merged_references(spark, sf):
    li = table(spark, sf, "lineitem")
    at = lambda c: F.when(c >= 2, c).otherwise(-1)
    a = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), at(F.col("l_linenumber")).alias("position"), F.col("l_partkey").cast("string").alias("citation_text"))
    b = li.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("k"), at(F.col("l_linenumber") + 1).alias("position"), F.col("l_suppkey").cast("string").alias("citation_text"))
    return structure.merged_references(a, b, "k").select("k", "position", "source", "citation_text")


@query(f"""WITH l AS ({_LINES}), s AS (SELECT doc_id, line_number, line AS body FROM l WHERE contains(text, '***')), a AS (SELECT doc_id, trim(line) AS line FROM l WHERE contains(line, '***')) SELECT s.doc_id, s.line_number, count(*) AS n FROM s JOIN a ON s.doc_id = a.doc_id AND contains(s.body, a.line) WHERE a.line <> '' GROUP BY ALL""")
def amendments_in_sections(spark, sf):
    d = table(spark, sf, "documents").where("contains(text, '***')")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).select("doc_id", (F.col("at") + 1).alias("line_number"), "line")
    s = lines.withColumnRenamed("line", "body")
    a = lines.where("contains(line, '***')").select("doc_id", F.lit("***").alias("marker"), "line")
    return structure.amendments_in_sections(s, a, section="line_number").groupBy("doc_id", "line_number").agg(F.count("*").alias("n"))


@query("WITH b AS (SELECT DISTINCT trim(text) AS t FROM benchmark WHERE len(regexp_split_to_array(trim(text), '[ \n]')) >= 3) SELECT doc_id, count(DISTINCT t) AS n_items FROM documents JOIN b ON contains(text, t) GROUP BY doc_id")
def benchmark_overlap(spark, sf):
    """Whole items of three words or more inside documents, equal items as one."""
    b = table(spark, sf, "benchmark").select(F.trim("text").alias("line")).distinct().where(F.size(F.split("line", "[ \n]", -1)) >= 3)
    found = contains.pairs(table(spark, sf, "documents"), b.withColumn("line_id", F.sha2("line", 256)))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_items"))


@query(f"WITH l AS ({_LINES}) SELECT doc_id, '***' AS type, line_number, m.position AS position, substr(line, greatest(m.position - 20, 0) + 1, m.position + 23 - greatest(m.position - 20, 0)) AS context FROM (SELECT doc_id, line_number, line, unnest({found('line', '[*][*][*]', 'x')}) AS m FROM l)")
def amendment_records(spark, sf):
    return acts.formatted_amendments(table(spark, sf, "documents"), GENERIC)


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id || '.' END AS number, CASE WHEN event_id % 2 = 0 THEN event_type ELSE event_type || ' no number' END AS heading FROM events")
def section_heading(spark, sf):
    title = F.when(F.col("event_id") % 2 == 0, F.concat("event_type", F.lit(" "), "user_id", F.lit(". rest"))).otherwise(F.concat("event_type", F.lit(" no number")))
    number, heading = structure.heading(title, r"[0-9]+\.")
    return table(spark, sf, "events").select("event_id", number.alias("number"), heading.alias("heading"))


# ---- quality


@query(f"WITH {_FLAGS} SELECT lang, count(*) AS n, count(*) FILTER (NOT (missing OR enc OR ocr)) AS n_safe, count(*) FILTER (missing OR enc OR ocr) AS n_flagged FROM f GROUP BY lang")
def quality_report(spark, sf):
    return manifest.quality_report(quality.assess(table(spark, sf, "documents"), GENERIC), ["lang"])


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'missing html_content' WHEN 1 THEN 'representation must be raw_html' WHEN 2 THEN 'must not be processed' ELSE '' END AS errors FROM events")
def schedule_record_errors(spark, sf):
    k = F.col("event_id") % 4
    e = quality.schedule_errors(F.when(k != 0, F.lit("<table>")), F.when(k == 1, "text").otherwise("raw_html"), k == 2)
    return table(spark, sf, "events").select("event_id", F.array_join(e, ",").alias("errors"))


@query("SELECT o_orderkey, CAST(least(greatest(coalesce(v, 3000), 1000), 30000) AS INTEGER) AS delay, CAST(least(greatest(coalesce(v % 9, 3), 1), 5) AS INTEGER) AS attempts FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 50 * 1000 AS INTEGER) END AS v FROM orders)")
def settings(spark, sf):
    v = F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_orderkey") % 50 * 1000).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", queueing.setting("extraction_delay_ms", v).alias("delay"), queueing.setting("max_retry_attempts", v % 9).alias("attempts"))


@query("SELECT event_type, count(*) FILTER (event_type = 'error' AND user_id % 5 < 3) AS n_retryable, CAST(max(5000 * pow(2, greatest(user_id % 5 - 1, 0))) AS BIGINT) AS longest_delay FROM events GROUP BY event_type")
def retry_strategy(spark, sf):
    reason = F.when(F.col("event_type") == "error", "content_selector_mismatch").otherwise("network_error")
    again = queueing.retryable(reason, F.col("user_id") % 5, F.lit(3))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.when(again, 1)).alias("n_retryable"), F.max(queueing.retry_delay(F.col("user_id") % 5)).alias("longest_delay"))


@query(f"WITH f AS ({_FAILED}) SELECT count(*) AS total, count(*) FILTER (failure_reason IN ('network_error', 'dom_timeout') AND retry_count < 3) AS retryable, count(*) FILTER (NOT (failure_reason IN ('network_error', 'dom_timeout') AND retry_count < 3)) AS permanent FROM f")
def retry_stats(spark, sf):
    return queueing.retry_stats(queueing.retry_plan(_failures(spark, sf), 3))


@query("""WITH b AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem), q AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'O'), c AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT CASE WHEN q.k IS NOT NULL OR n > 1 AND c.k IS NULL THEN 'q' WHEN c.k IS NOT NULL THEN 'c' ELSE 'a' END AS o FROM b LEFT JOIN q USING (k) LEFT JOIN c USING (k))
SELECT count(*) FILTER (o = 'a') AS added, count(*) FILTER (o = 'q') AS skipped_in_queue, count(*) FILTER (o = 'c') AS skipped_captured FROM o""")
def queue_skip_counts(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "k")
    batch = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    return queueing.outcome_counts(queueing.add(batch, o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), "k", "l_linenumber"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def known_documents(spark, sf):
    return queueing.known(table(spark, sf, "documents"), table(spark, sf, "labels").where("toxic = 1"), "doc_id").select("doc_id", F.length("text").cast("long").alias("n"))


@query("""WITH r AS (SELECT doc_id, source, length(text) AS n, used FROM (SELECT *, sum(CASE WHEN length(text) >= 200 THEN n_chars ELSE 0 END) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents)),
s AS (SELECT CASE WHEN 100.0 * used / 1500000 >= 95 THEN 'waiting' WHEN n >= 200 THEN 'completed' ELSE 'failed' END AS state FROM r) SELECT state, count(*) AS n FROM s GROUP BY state""")
def queue_processed(spark, sf):
    d = table(spark, sf, "documents").withColumn("attempts", F.lit(1))
    return capture.processed(d, "text", "n_chars", 1_500_000, ["doc_id"], threshold=200).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id % 2 DESC) AS n FROM (SELECT * FROM events WHERE event_id % 4 < 2)) WHERE n = 1")
def upsert_latest(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.struct("event_type", "user_id"))
    return sync.upsert(sync.latest(e.where("event_id % 4 = 0"), "k", F.desc("ts")), sync.latest(e.where("event_id % 4 = 1"), "k", F.desc("ts")), "k", "ts").select("event_type", "user_id", "event_id")


@query(f"WITH f AS ({_FAILED}) SELECT user_id, failure_reason FROM f WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id % 20 = 0)")
def failures_left(spark, sf):
    done = table(spark, sf, "events").where("event_type = 'purchase' and event_id % 20 = 0")
    return sync.failures_left(_failures(spark, sf), done, "user_id").select("user_id", "failure_reason")


# ---- durability


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type = 'click' OR event_type = 'signup' AND event_id % 2 = 0 GROUP BY event_type")
def wal_accepted(spark, sf):
    kind = F.when(F.col("event_type") == "click", "intent").when(F.col("event_type") == "signup", "complete")
    e = table(spark, sf, "events").withColumns({"entry_type": kind, "content_hash": F.when(F.col("event_id") % 2 == 0, F.sha2("event_type", 256)).otherwise("short")})
    return recovery.wal_entries(e).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN length(text) > 0 AND lang <> 'fr' THEN 'persisted' ELSE 'integrity_error' END AS outcome, count(*) AS n FROM documents GROUP BY ALL")
def write_read_back(spark, sf):
    d = table(spark, sf, "documents")
    r = recovery.receipt(d, "doc_id", "text", F.lit("2024-01-01").cast("timestamp"))
    back = d.withColumn("text", F.when(F.col("lang") == "fr", F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return recovery.write_outcomes(back, r, "doc_id", "text").groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'missing receipt_id' WHEN 1 THEN 'invalid content_raw_sha256' WHEN 2 THEN 'invalid storage_backend' ELSE '' END AS errors FROM events")
def receipt_validation(spark, sf):
    k = F.col("event_id") % 4
    rows = table(spark, sf, "events").select("event_id", F.when(k != 0, F.lit("r")).alias("receipt_id"), F.col("user_id").cast("string").alias("act_id"), F.when(k == 1, "12").otherwise(F.sha2("event_type", 256)).alias("content_raw_sha256"), F.when(k == 2, "paper").otherwise("memory").alias("storage_backend"), F.col("ts").alias("persisted_at"), F.lit("3.1").alias("schema_version"))
    return rows.select("event_id", F.array_join(recovery.receipt_errors(), ",").alias("errors"))


@query("SELECT user_id AS act_id, event_id FROM events WHERE user_id = 7")
def receipts_of_act(spark, sf):
    return manifest.receipts_of(table(spark, sf, "events").withColumnRenamed("user_id", "act_id"), 7).select("act_id", "event_id")


@query("SELECT CASE WHEN l.doc_id IS NOT NULL THEN 'skipped_has_receipt' WHEN length(text) = 0 THEN 'skipped_no_content' WHEN lang = 'fr' THEN 'integrity_error' ELSE 'migrated' END AS outcome, count(*) AS n FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY ALL")
def migration_verified(spark, sf):
    d = table(spark, sf, "documents").withColumn("h", F.when(F.col("lang") == "fr", F.sha2(F.lit("other"), 256)).when(F.col("lang") == "en", F.concat(F.lit("sha256:"), F.sha2("text", 256))))
    return recovery.migration(d, table(spark, sf, "labels"), "doc_id", "text", "h").groupBy("outcome").agg(F.count("*").alias("n"))


# ---- exports


def _acts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("act_number"), F.col("lang").alias("title"), F.col("text").alias("content_raw"), F.concat(F.lit("u"), "doc_id").alias("url"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("volume_number"), F.when(F.col("doc_id") % 4 == 0, F.lit("<div class='pager'>page 1</div><div class='act-details'><table><tr></tr></table></div>")).alias("page"))


@query(f"""WITH RECURSIVE {_CITED}, o AS (SELECT doc_id, position, citation_text, row_number() OVER (PARTITION BY doc_id ORDER BY position, length(citation_text) DESC) AS n FROM z),
k AS (SELECT *, position + length(citation_text) AS e, TRUE AS kept FROM o WHERE n = 1 UNION ALL SELECT o.*, CASE WHEN o.position < k.e THEN k.e ELSE o.position + length(o.citation_text) END, o.position >= k.e FROM k JOIN o ON o.doc_id = k.doc_id AND o.n = k.n + 1), nc AS (SELECT doc_id, count(*) AS n FROM k WHERE kept GROUP BY doc_id), nm AS (SELECT doc_id, count(*) AS n FROM ({merged_sql(GENERIC.numeric)}) GROUP BY doc_id)
SELECT CAST(doc_id AS VARCHAR) AS internal_id, CASE WHEN doc_id % 3 > 0 THEN source ELSE 'unknown' END AS volume_number, CASE WHEN contains(text, 'trash') THEN 'repealed' ELSE 'active' END AS legal_status, coalesce(nc.n, 0) AS n_references, coalesce(nm.n, 0) AS n_regions, {n_of('text', 'the ')} AS n_the, CASE WHEN length(text) > 0 THEN sha256(text) END AS content_raw_sha256, CASE WHEN doc_id % 4 = 0 THEN 'pagination' ELSE 'none' END AS risk, CASE WHEN doc_id % 4 = 0 THEN '<table><tr></tr></table>' END AS schedule_html, 'string_match_only' AS reference_semantics,
  'bdlaws_html_only' AS source_authority, CAST(6 AS INTEGER) AS n_must_not_trust, CASE WHEN length(text) > 0 THEN 5 ELSE 3 END AS n_limitations, 'element.textContent' AS extraction_api, CAST(0 AS INTEGER) AS n_logged
FROM documents LEFT JOIN nc USING (doc_id) LEFT JOIN nm USING (doc_id)""")
def act_export(spark, sf):
    e = export.act(_acts(spark, sf), GENERIC, html="page", rules=GENERIC_PAGES)
    more = ["source_authority", F.size("trust_boundary.must_not_trust").alias("n_must_not_trust"), F.size("data_quality.known_limitations").alias("n_limitations"), "capture_environment.extraction_api", F.size("transformation_log").alias("n_logged")]
    return e.select("identifiers.internal_id", "volume_number", "legal_status", F.col("lexical_references.count").alias("n_references"), F.size("numeric_regions").cast("long").alias("n_regions"), F.col("marker_frequency")["the"]["count"].alias("n_the"), "content_raw_sha256", F.col("extraction_risk.reason").alias("risk"), F.col("schedules.html_content").alias("schedule_html"), "reference_semantics", *more)


@query(f"SELECT doc_id, json_valid('{{}}') AS valid, lang AS title, CAST(doc_id AS VARCHAR) AS act_number, sha256(text) AS content_sha256, {n_of('text', 'licen')} AS n_licence FROM documents")
def legacy_export(spark, sf):
    e = export.legacy_act(table(spark, sf, "documents"), GENERIC, "doc_id", "lang", "text")
    j = lambda p: F.get_json_object("json", p)
    return e.select("doc_id", export.json_valid(F.col("json")).alias("valid"), j("$.title").alias("title"), j("$.act_number").alias("act_number"), F.sha2(j("$.content"), 256).alias("content_sha256"), j("$.sections_detected.licence").cast("long").alias("n_licence"))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'n' || doc_id END AS act_number, lang AS title, sha256(text) AS content_sha256, '' AS url, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'unknown' END AS volume_number, CAST(0 AS BIGINT) AS n_the FROM documents")
def corpus_projection(spark, sf):
    even = F.col("doc_id") % 2 == 0
    d = table(spark, sf, "documents").select(F.when(even, F.col("doc_id")).alias("actNumber"), F.concat(F.lit("n"), "doc_id").alias("act_number"), F.col("lang").alias("title"), F.col("text").alias("content"), F.lit("").alias("volumeNumber"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("volume_number"))
    return export.corpus_act(d, GENERIC).select("act_number", "title", F.sha2("content", 256).alias("content_sha256"), "url", "volume_number", F.col("marker_frequency")["the"].alias("n_the"))


@query(f"WITH f AS ({_FAILED}), a AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT user_id, retry_count + 1 AS n_attempts, a AS first_attempt_at, b AS last_attempt_at, retry_count >= 3 AS max_retries_reached FROM f JOIN a USING (user_id)")
def failed_export(spark, sf):
    f = _failures(spark, sf).withColumn("attempts", F.transform("attempts", lambda x: F.struct(x["timestamp"]["ts"].alias("timestamp"), x["reason"].alias("reason"))))
    return export.failed_act(f).select("user_id", "n_attempts", "first_attempt_at", "last_attempt_at", "max_retries_reached")


@query("""SELECT e AS errors, count(*) AS n FROM (SELECT concat_ws(';', CASE WHEN doc_id % 11 = 0 THEN 'title is not a string' END, CASE WHEN lang = 'fr' AND doc_id % 2 = 0 THEN 'failed act should have content_raw as null' END, CASE WHEN lang = 'fr' AND doc_id % 3 = 0 THEN 'failed act missing failure_reason' END, CASE WHEN lang = 'fr' AND doc_id % 5 = 0 THEN 'failed act missing attempts count' END, CASE WHEN lang <> 'fr' AND doc_id % 2 = 1 THEN 'content is not a string' END, CASE WHEN lang <> 'fr' AND doc_id % 7 = 0 THEN 'volume_number is null or undefined' END) AS e FROM documents) GROUP BY e""")
def corpus_rules(spark, sf):
    k, failed = F.col("doc_id"), F.col("lang") == "fr"
    d = table(spark, sf, "documents").select(k.cast("string").alias("act_number"), F.when(k % 11 != 0, F.col("lang")).alias("title"), F.when(failed, "failed").alias("extraction_status"), F.when(k % 2 == 0, F.col("text")).alias("content_raw"), F.when(k % 2 == 0, F.col("text")).alias("content"), F.when(k % 3 == 0, "").otherwise("dom_timeout").alias("failure_reason"), F.when(k % 5 != 0, 1).alias("attempts"), F.lit("{}").alias("marker_frequency"), F.when(k % 7 != 0, F.col("source")).alias("volume_number"))
    return export.corpus_errors(d).groupBy(F.array_join("errors", ";").alias("errors")).agg(F.count("*").alias("n"))


_ABOUT = dict(title="Corpus", version="2.0", url="https://example.com", licence="CC-BY-4.0", authors=("A. Person",), keywords=("acts", "text corpus"))


@query("""WITH s AS (SELECT count(*) AS n, count(DISTINCT source) AS v, CAST(sum(n_chars) AS BIGINT) AS c, strftime(make_timestamp(min(doc_id) * 86400000000), '%Y-%m-%d') AS a, strftime(make_timestamp(max(doc_id) * 86400000000), '%Y-%m-%d') AS z FROM documents),
k AS (SELECT count(*) AS r, count(d.doc_id) AS i FROM (SELECT DISTINCT doc_id FROM labels) l LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en') d USING (doc_id)),
p AS (SELECT *, i || ' of ' || r || ' referenced acts are in the corpus (' || CAST(floor(100 * i / r + 0.5) AS BIGINT) || ' %).' AS said FROM s, k)
SELECT 'README.md' AS name, contains(content, said) AND contains(content, '| Acts | ' || n || ' |') AND contains(content, '| Volumes | ' || v || ' |') AND contains(content, '| Characters | ' || c || ' |') AND contains(content, '| Captured | ' || a || ' to ' || z || ' |') AS complete, length(content) AS n_chars FROM
  (SELECT *, '# Corpus' || chr(10) || chr(10) || '| | |' || chr(10) || '|---|---|' || chr(10) || '| Acts | ' || n || ' |' || chr(10) || '| Volumes | ' || v || ' |' || chr(10) || '| Characters | ' || c || ' |' || chr(10) || '| Captured | ' || a || ' to ' || z || ' |' || chr(10) || repeat('x', {rest}) || said AS content FROM p)
UNION ALL SELECT 'CITATION.cff', TRUE, length('cff-version: 1.2.0' || chr(10) || 'type: dataset' || chr(10) || 'title: "Corpus"' || chr(10) || 'version: "2.0"' || chr(10) || 'date-released: ' || z || chr(10) || 'url: "https://example.com"' || chr(10) || 'license: "CC-BY-4.0"' || chr(10) || 'abstract: ' || n || ' acts in ' || v || ' volumes, ' || c || ' characters' || chr(10) || 'keywords:' || chr(10) || '- "acts"' || chr(10) || '- "text corpus"' || chr(10) || 'authors:' || chr(10) || '- name: "A. Person"' || chr(10)) FROM p""".replace("{rest}", str(len("\n## Method\n\n\n## Coverage\n\n\n\n## Known limits\n\n\n## Licence and citation\n\nCC-BY-4.0 Version 2.0; cite it by CITATION.cff.\n") + sum(len(x) + 3 for x in (*export.METHOD, *export.LIMITS)))))
def corpus_documents(spark, sf):
    """README and citation of the corpus: whether all figures stand in them, and their lengths."""
    d = table(spark, sf, "documents").withColumn("at", F.timestamp_seconds(F.col("doc_id") * 86400))
    s = manifest.stats(d, "source", "n_chars", "at")
    out = export.documents(s, coverage=manifest.coverage(table(spark, sf, "labels"), d.where("lang = 'en'"), "doc_id"), **_ABOUT)
    row, has = s.first(), F.contains("content", F.lit(" %)."))
    for k, c in (("Acts", "total_acts"), ("Volumes", "total_volumes"), ("Characters", "total_characters")):
        has = has & F.contains("content", F.lit(f"| {k} | {row[c]} |"))
    return out.select("name", (has | (F.col("name") != "README.md")).alias("complete"), F.length("content").cast("long").alias("n_chars"))


@query("""WITH d AS (SELECT count(*) AS n, count(lang) AS lang, count(*) FILTER (length(text) > 0) AS full, count(*) FILTER (doc_id % 4 = 0) AS paged FROM documents)
SELECT 'title_raw' AS field, 'string' AS type, 'Title as captured' AS description, n AS n_rows, lang AS n_filled FROM d UNION ALL SELECT 'content_raw_sha256', 'string', 'SHA-256 of content_raw; null for empty text', n, "full" FROM d
UNION ALL SELECT 'schedules.html_content', 'string', 'Markup of the schedules as it is', n, paged FROM d UNION ALL SELECT 'identifiers.internal_id', 'string', 'Number of the act in its source; not a citation', n, n FROM d""".replace(" AS full,", ' AS "full",'))
def data_dictionary(spark, sf):
    """Some fields of the exported acts: types, what they mean, and in how many acts they are filled."""
    rows = export.data_dictionary(export.act(_acts(spark, sf), GENERIC, html="page", rules=GENERIC_PAGES))
    return rows.where(F.col("field").isin("title_raw", "content_raw_sha256", "schedules.html_content", "identifiers.internal_id"))


@query("SELECT CAST(doc_id AS VARCHAR) AS internal_id, lang || 'e' || chr(769) AS title_raw, lang || 'é' AS title_normalized FROM documents")
def title_layers(spark, sf):
    a = _acts(spark, sf).withColumn("title", F.concat("title", F.lit("e\u0301")))
    return export.act(a, GENERIC).select("identifiers.internal_id", "title_raw", "title_normalized")


@query(f"SELECT doc_id, CASE WHEN length(text) = 0 THEN 'content_empty' WHEN length(text) < 100 THEN 'content_below_threshold' END AS reason, CASE WHEN length(text) < 100 THEN 'permanent' END AS failure_class, length(text) >= 100 AS valid, {n_of('text', ENC)} AS n_wrong FROM documents")
def capture_outcomes(spark, sf):
    return capture.outcomes(table(spark, sf, "documents"), "text").select("doc_id", "reason", "failure_class", "valid", T.count(F.col("text"), ENC).alias("n_wrong"))
