"""The queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_clustering, decontamination, filter_audit, jaccard_join, language_id, line_dedup, packing, quality_classifier, quality_rules, sharding, token_files, toxicity, url_filter
from ._shared import delete_at_end, held_out, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs)
    return language_id.predict(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_deleted", "words_deleted", F.length("text").cast("long").alias("chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in a new store and are compacted; each with its shard and the hash of its text as read back."""
    store = sharding.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.append(table(spark, sf_dir, "documents"))
    version = store.compact()
    store.vacuum()
    delete_at_end(spark, store.path)
    return sharding.placed(store).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "shard_id", F.lit(version).cast("long").alias("version"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontamination.items_sha256().alias("items_sha256"), decontamination.contaminated().alias("contaminated"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = centroid_clustering.cluster(table(spark, sf_dir, "embeddings"))
    return centroid_clustering.described(found, centroids).drop("computed").withColumnRenamed("id", "vec_id")


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(filter_audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are written as token files in a new folder and read back from them."""
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    delete_at_end(spark, folder)
    token_files.write(table(spark, sf_dir, "documents"), folder)
    return token_files.read(spark, folder)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_language_id, op3_best_fit_packing, op4_quality_classifier, op5_url_filters, op6_line_dedup, op7_sharding, op8_ngram_jaccard_join, op9_toxicity, op10_decontamination, op11_centroid_clustering, op12_filter_interaction_audit, op13_token_files)}

#: Rounds of op11 in SQL: distances of all vectors to all centroids, then the means.
_ASSIGN = """a{i} AS (SELECT DISTINCT ON (r) r, vec_id, v, c, d FROM (SELECT k.r, k.vec_id, k.v, c.c, list_sum(list_transform(list_zip(k.v, c.v), x -> (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM k, c{i} c) ORDER BY r, d, c)"""
_MEANS = """m{i} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i),
c{j} AS (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM m{i} GROUP BY c) m USING (c))"""
_ROUNDS = ",\n".join(f"{_ASSIGN.format(i=i)},\n{_MEANS.format(i=i, j=i + 1)}" for i in range(3))

ORACLE_SQL = {
    "op1_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), x -> x <> '') AS w, list_filter(string_split(t, chr(10)), x -> regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
p AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM h WHERE n > 1) GROUP BY r),
m AS (SELECT w.r, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN p USING (r)),
x AS (SELECT r, doc_id, source, trim(unnest(string_split(regexp_replace(regexp_replace(lower(t), '[0-9]', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)))) AS l FROM d),
c AS (SELECT source, l, count(DISTINCT doc_id) AS n FROM x WHERE l <> '' GROUP BY source, l),
b AS (SELECT c.source, l FROM c JOIN (SELECT source, count(DISTINCT doc_id) AS n FROM d GROUP BY source) s ON c.source IS NOT DISTINCT FROM s.source WHERE c.n >= 20 AND c.n >= 0.01 * s.n),
k AS (SELECT x.r, sum(length(x.l)) AS line_chars, sum(CASE WHEN b.l IS NULL THEN 0 ELSE length(x.l) END) AS removed_chars FROM x LEFT JOIN b ON x.source IS NOT DISTINCT FROM b.source AND x.l = b.l GROUP BY x.r),
z AS (SELECT d.doc_id, m.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CAST(line_chars AS BIGINT) AS line_chars, CAST(removed_chars AS BIGINT) AS removed_chars FROM d JOIN m USING (r) JOIN k USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND line_chars - removed_chars >= 0.3 * line_chars AS kept, line_chars, removed_chars FROM z
""",
    "op6_line_dedup": r"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS p, unnest(ls) AS l FROM s),
f AS (SELECT doc_id, p, l, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS f FROM u),
n AS (SELECT doc_id, p, f, w, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i, sum(w) OVER (PARTITION BY doc_id ORDER BY p) AS c FROM (SELECT *, 1 + length(f) - length(replace(f, ' ', '')) AS w FROM f WHERE f <> '')),
g AS (SELECT a.doc_id, a.i AS a, b.i AS b FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 49 AND b.c - a.c + a.w >= 50),
t AS (SELECT doc_id, a AS a, min(b) AS b FROM g GROUP BY doc_id, a UNION SELECT doc_id, max(a), b FROM g GROUP BY doc_id, b),
k AS (SELECT t.doc_id, t.a, t.b, string_agg(n.f, chr(10) ORDER BY n.i) AS k FROM t JOIN n ON n.doc_id = t.doc_id AND n.i BETWEEN t.a AND t.b GROUP BY ALL),
o AS (SELECT doc_id, a, b, doc_id = first_value(doc_id) OVER e AND a = first_value(a) OVER e AS is_first FROM k WINDOW e AS (PARTITION BY k ORDER BY doc_id, a)),
x AS (SELECT DISTINCT n.doc_id, n.p, n.w FROM o JOIN n ON n.doc_id = o.doc_id AND n.i BETWEEN o.a AND o.b WHERE NOT o.is_first),
y AS (SELECT doc_id, count(*) AS n_deleted, CAST(sum(w) AS BIGINT) AS words_deleted FROM x GROUP BY doc_id),
z AS (SELECT f.doc_id, string_agg(f.l, chr(10) ORDER BY f.p) AS left_ FROM f LEFT JOIN x ON x.doc_id = f.doc_id AND x.p = f.p WHERE x.p IS NULL GROUP BY f.doc_id),
m AS (SELECT doc_id, count(*) AS n_lines FROM n GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(words_deleted, 0) AS words_deleted, CAST(length(CASE WHEN n_deleted > 0 THEN coalesce(left_, '') ELSE text END) AS BIGINT) AS chars_left, sha256(CASE WHEN n_deleted > 0 THEN coalesce(left_, '') ELSE text END) AS text_sha256
FROM documents LEFT JOIN m USING (doc_id) LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id)
""",
    "op8_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), x -> x <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM c JOIN n nx ON c.x = nx.r JOIN n ny ON c.y = ny.r WHERE 100 * k >= 90 * (nx.n + ny.n - k)),
t AS (SELECT r AS x, r AS y FROM d UNION SELECT t.x, l.y FROM t JOIN l ON t.y = l.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT t.x, min(e.doc_id) AS component_id FROM t JOIN d e ON t.y = e.r GROUP BY t.x) m ON m.x = d.r
""",
    "op10_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), x -> x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), x -> x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM p),
g AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
h AS (SELECT g.r, g.i, g.k, p.item_id FROM g JOIN p ON g.k = p.k AND g.g = p.g),
n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
""",
    "op11_centroid_clustering": f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, x -> CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, x -> x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT v, sha256('1:' || CAST(vec_id AS VARCHAR)) AS h FROM k ORDER BY h, v LIMIT 16)),
{_ROUNDS},
{_ASSIGN.format(i=3)}
SELECT vec_id, CAST(a3.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a3.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON a3.c = c3.c
""",
    "op12_filter_interaction_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), x -> x <> '') AS w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE)] AS f,
  coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, f, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
r AS (SELECT g.part, o AS filter_order, step, o[step] AS filter, list_transform(range(1, 6), i -> f[ascii(o[i]) - 64]) AS q, n, good, toxic, f FROM g, s),
y AS (SELECT part, filter_order, step, filter, sum(CASE WHEN NOT list_contains(q[1:step], TRUE) THEN n ELSE 0 END) AS kept, sum(CASE WHEN q[step] AND NOT list_contains(q[1:step - 1], TRUE) THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN q[step] AND list_contains(q[1:step - 1], TRUE) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN q[step] AND len(list_filter(q, z -> z)) = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN good AND q[step] AND NOT list_contains(q[1:step - 1], TRUE) THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN toxic AND q[step] AND NOT list_contains(q[1:step - 1], TRUE) THEN n ELSE 0 END) AS toxic_lost FROM r GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM y
""",
}
ORACLE_SQL = {k: re.sub(r"\b([xzi]) -> ", r"lambda \1: ", v) for k, v in ORACLE_SQL.items()}
