"""Queries of stateful streams, the mirror, keyed tables, joins of intervals and files of acts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.packs import GENERIC
from ..operators import audit, intervals, markers, structure, sync
from ..sources import act_files, keyed, scratch
from ..streaming import intents, mirror, queue
from .queries import _SPANS
from .registry import found, merged_sql, query, table


def _staged(df, name):
    """df as a table of its own."""
    path = scratch.folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---- streams with state


@query("""WITH t AS (SELECT conv_id, turn, CASE length(text) % 5 WHEN 1 THEN 'network_error' WHEN 2 THEN 'act_not_found' WHEN 3 THEN 'dom_timeout' WHEN 4 THEN 'other' END AS reason FROM conversations),
d AS (SELECT conv_id, max(turn) FILTER (reason IS NULL) AS done FROM t GROUP BY conv_id), f AS (SELECT conv_id, count(t.turn) FILTER (reason IS NOT NULL AND turn > coalesce(done, -1)) AS n, arg_max(reason, turn) FILTER (turn > coalesce(done, -1)) AS failure_reason FROM t JOIN d USING (conv_id) GROUP BY conv_id),
c AS (SELECT *, greatest(n - 1, 0) AS retry_count, CASE WHEN n = 0 THEN 'completed' WHEN failure_reason NOT IN ('network_error', 'dom_timeout') THEN 'permanent' WHEN n - 1 < 3 THEN 'transient' ELSE 'transient_exhausted' END AS status FROM f)
SELECT CAST(conv_id AS VARCHAR) AS act_id, status, retry_count, failure_reason, CASE WHEN status = 'transient' THEN CAST(5000 * pow(2, retry_count) AS BIGINT) END AS next_retry_delay_ms FROM c""")
def queue_stream(spark, sf):
    """Each turn is an attempt. They arrive out of order in three parts, each taken by a stream that is started anew."""
    top, k = scratch.folder(spark, "queue"), F.length("text") % 5
    reason = F.when(k == 1, "network_error").when(k == 2, "act_not_found").when(k == 3, "dom_timeout").when(k == 4, "other")
    attempts = table(spark, sf, "conversations").select("conv_id", F.timestamp_seconds("turn").alias("at"), F.col("turn").cast("long").alias("event_id"), reason.alias("reason"))
    for i in (2, 0, 1):
        attempts.where(F.col("event_id") % 3 == i).write.mode("append").parquet(f"{top}/in")
        queue.run(spark, f"{top}/in", attempts.schema, f"{top}/out", f"{top}/checkpoint", "conv_id", "at").awaitTermination()
    return queue.states(spark, f"{top}/out").drop("due_at")


@query("SELECT conv_id, turn, sha256(text) AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1")
def mirror_buckets(spark, sf):
    """The last turn of each conversation. Turns arrive in four batches, not in the order of their numbers."""
    out = scratch.folder(spark, "mirror")
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("content_hash"))
    for n in range(4):
        mirror.merge(spark, out, t.where((F.col("turn") + 1) % 4 == n), n, "conv_id", "content_hash", "turn", 16)
    mirror.vacuum(spark, out)
    return mirror.current(spark, out, t.schema)


@query("SELECT conv_id, turn, CAST(row_number() OVER w AS INTEGER) AS version, lead(turn) OVER w AS archived_at, lead(turn) OVER w IS NULL AS is_current FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, sha256(text))")
def history_batches(spark, sf):
    """Each turn is a capture of its conversation. Batches come in another order than the turns, so that versions are split."""
    out = scratch.folder(spark, "history")
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("content_hash"))
    for n, part in enumerate((2, 0, 3, 1)):
        mirror.merge_history(spark, out, t.where(F.col("turn") % 4 == part), n, "conv_id", "turn", "content_hash", 16)
    return mirror.history_of(spark, out, t.schema, "turn").drop("content_hash")


@query("""WITH e AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 'intent' WHEN length(text) % 7 = 0 THEN 'complete' END AS kind, length(text) % 2 = 0 AS pruned FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS act_id, CAST(max(turn) AS VARCHAR) AS entry_id FROM e WHERE kind = 'intent' AND NOT pruned AND conv_id NOT IN (SELECT conv_id FROM e WHERE kind = 'complete') GROUP BY conv_id""")
def open_intents(spark, sf):
    """Entries of a log arrive in two parts, completions before some intents, each taken by a stream that is started anew."""
    top, n = scratch.folder(spark, "intents"), F.length("text")
    kind = F.when(n % 3 == 0, "intent").when(n % 7 == 0, "complete")
    e = table(spark, sf, "conversations").select(F.col("conv_id").alias("act_id"), kind.alias("entry_type"), F.timestamp_seconds("turn").alias("timestamp"), F.col("turn").cast("string").alias("entry_id"), (n % 2 == 0).alias("pruned"))
    for part in (1, 0):
        e.where(F.unix_seconds("timestamp") % 2 == part).write.mode("append").parquet(f"{top}/in")
        intents.run(spark, f"{top}/in", e.schema, f"{top}/out", f"{top}/checkpoint").awaitTermination()
    return intents.open_intents(spark, f"{top}/out").select("act_id", "entry_id")


@query("""WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'write_attempt' WHEN 'view' THEN 'read_success' WHEN 'error' THEN '' WHEN 'signup' THEN 'sign_up' END AS operation, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT CASE WHEN coalesce(operation, '') = '' THEN 'rejected' WHEN operation = 'sign_up' THEN 'accepted_unknown' ELSE 'accepted' END AS verdict, count(*) AS n, count(*) FILTER (k = 7) AS n_seven, CAST(sum(k) AS BIGINT) AS total FROM e GROUP BY 1""")
def audit_context(spark, sf):
    """Entries with their contexts as VARIANT values, asked by path; unknown operations are taken with a warning, missing ones rejected."""
    kind = F.col("event_type")
    name = F.when(kind == "click", "write_attempt").when(kind == "view", "read_success").when(kind == "error", "").when(kind == "signup", "sign_up")
    e = audit.typed(audit.checked(table(spark, sf, "events").select("event_id", name.alias("operation"), F.col("props").alias("context"))))
    k = audit.value("$.k", "bigint")
    return e.groupBy("verdict").agg(F.count("*").alias("n"), F.count(F.when(k == 7, 1)).alias("n_seven"), F.sum(k).alias("total"))


# ---- joins of intervals


def _regions(spark, sf, of, names=("start", "end")):
    d = table(spark, sf, "documents").select("doc_id", F.explode(of(F.col("text"), GENERIC)).alias("r"))
    return _staged(d.select("doc_id", F.col("r.start").alias(names[0]), F.col("r.end").alias(names[1])), "regions")


@query(f"""WITH m AS ({merged_sql(GENERIC.protected, 50, 200)}), x AS (SELECT doc_id, m.position AS position FROM (SELECT doc_id, unnest({found('text', '[0-9]+', 'n')}) AS m FROM documents))
SELECT x.doc_id, x.position, bool_or(m.doc_id IS NOT NULL) AS inside FROM x LEFT JOIN m ON x.doc_id = m.doc_id AND x.position >= m.region_start AND x.position < m.region_end GROUP BY ALL""")
def interval_points(spark, sf):
    points = table(spark, sf, "documents").where(F.col("text").rlike("[0-9]")).select("doc_id", F.explode(T.find_all(F.col("text"), "[0-9]+")["position"]).alias("position"))
    return intervals.inside(_staged(points, "points"), _regions(spark, sf, markers.protected_regions), "doc_id")


@query(f"""WITH n AS ({merged_sql(GENERIC.numeric)}), p AS ({merged_sql(GENERIC.protected, 50, 200)}) SELECT n.doc_id, n.region_start AS start, n.region_end AS "end", p.region_start AS other_start, p.region_end AS other_end FROM n JOIN p ON n.doc_id = p.doc_id AND n.region_start < p.region_end AND p.region_start < n.region_end""")
def interval_overlap(spark, sf):
    return intervals.overlapping(_regions(spark, sf, markers.numeric_regions), _regions(spark, sf, markers.protected_regions), "doc_id")


@query(f"""WITH s AS ({_SPANS}), r AS (SELECT doc_id, m.position AS position FROM (SELECT doc_id, unnest({found('text', '[Ll]icen', 'r')}) AS m FROM documents)), k AS (SELECT doc_id, m.position AS o, m.text AS t FROM (SELECT doc_id, unnest({found('text', '[%*]+', 'k')}) AS m FROM documents))
SELECT r.doc_id, r.position, any_value(s.section_number) AS section_number, arg_max(k.t, k.o) AS marker FROM r JOIN s ON r.doc_id = s.doc_id AND s.content_start <= r.position AND r.position < s.content_end LEFT JOIN k ON k.doc_id = r.doc_id AND k.o <= r.position AND k.o >= s.content_start AND k.o < s.content_end GROUP BY r.doc_id, r.position""")
def interval_scope(spark, sf):
    d = table(spark, sf, "documents")
    refs = _staged(structure.marks(d, "[Ll]icen").select("doc_id", F.col("marker_offset").alias("position")), "points")
    spans = _staged(structure.sections(d, "[0-9]+").select("doc_id", "section_number", "content_start", "content_end"), "spans")
    return intervals.anchored(refs, spans, _staged(structure.marks(d, "[%*]+"), "marks"), "doc_id").select("doc_id", "position", "section_number", "marker")


# ---- keyed tables


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def keyed_lookup(spark, sf):
    name = keyed.temporary(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return keyed.lookup(spark, name, "doc_id", table(spark, sf, "labels").where("toxic = 1"))


@query("SELECT CASE WHEN lang = 'es' THEN 'new' WHEN lang = 'fr' THEN 'content_changed' ELSE 'unchanged' END AS sync_reason, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def keyed_changes(spark, sf):
    """The diff of two captures in keyed tables, joined bucket by bucket."""
    now = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("act_number"), T.content_hash(F.concat(F.col("text"), F.lit("."))).alias("content_hash"), "lang")
    old = now.where("lang <> 'es'").withColumn("content_hash", F.when(F.col("lang") == "fr", "another").otherwise(F.col("content_hash")))
    a, b = (spark.table(keyed.temporary(x, "act_number")) for x in (now, old))
    return sync.changed(a, b).groupBy("sync_reason").agg(F.count("*").alias("n"))


# ---- files of acts


@query("SELECT s_suppkey AS act_number, s_name AS title, CAST(NULL AS VARCHAR) AS url, sha256(s_name || chr(10) || s_suppkey) AS content_sha256 FROM supplier")
def act_files_round_trip(spark, sf):
    """An act for each supplier, in a file of its own with several lines, read back as written."""
    path = scratch.folder(spark, "acts")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("act_number"), F.col("s_name").alias("title"), F.concat("s_name", F.lit("\n"), "s_suppkey").alias("content_raw"), F.lit(None).cast("string").alias("url"))
    act_files.write(s, f"{path}/acts", "act_number", indent=2)
    back = act_files.read(spark, f"{path}/acts", "act_number bigint, title string, content_raw string, url string")
    return back.where("_corrupt_record is null").select("act_number", "title", "url", F.sha2("content_raw", 256).alias("content_sha256"))
