"""Quality rules: measures of single documents, and the frequency of lines across the documents of a host.

Lines are normalised (lower case, digits as 0, white space folded) and hashed. For each host, the distinct documents
of each line are counted. A line is over the limits if it stands in at least `min_docs` documents and at least
`min_share` of the documents of its host; such lines are removed, and a document that keeps less than `min_left` of
the characters of its lines is depleted.

All of it is DataFrame functions. The texts are read twice and never shuffled or staged: once for the counts of
(host, line hash), and once for the measures and the removal. In between only the lines over the limits are kept, one
row a host: at least `min_share` of a host's documents have each of them, so a host has at most 1 / `min_share` times
its documents' mean number of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WORD_CHAR, WORD_GAP, stage

MIN_DOCS, MIN_SHARE, MIN_LEFT = 20, 0.01, 0.3
#: Of the measures: the least number of words, and the most repeated words in 100.
MIN_WORDS, MAX_REPEATED = 20, 30
WINDOW = 8
#: Lines over the limits that are broadcast at most; where there are more, documents meet them in a salted join.
BROADCAST_LINES, SALTS = 2_000_000, 64
_GAP, _CHAR = (x.replace("\\", "\\\\") for x in (WORD_GAP, WORD_CHAR))


def n_repeat_words(words: str, window: int = WINDOW) -> str:
    """SQL for the number of words in windows of `window` words that occur twice or more among `words`.

    Windows are told apart by a 64-bit hash. Most texts have no window twice, which the number of distinct hashes
    shows; only for the others are the windows sorted to find the repeated ones and the words that they cover.
    """
    hashes = f"transform(sequence(1, size(ws) - {window - 1}), i -> xxhash64(slice(ws, i, {window})))"
    doubles = "array_sort(transform(filter(sequence(0, size(o) - 1), k -> coalesce(get(o, k).h = get(o, k - 1).h, false) or coalesce(get(o, k).h = get(o, k + 1).h, false)), k -> o[k].p))"
    covered = f"aggregate({doubles}, named_struct('c', 0L, 'e', 0L), (a, p) -> named_struct('c', a.c + p + {window} - greatest(a.e, cast(p as bigint)), 'e', cast(p + {window} as bigint)), a -> a.c)"
    ordered = f"transform(array(sort_array(transform(hs, (h, p) -> named_struct('h', h, 'p', p)))), o -> {covered})[0]"
    counted = f"transform(array({hashes}), hs -> if(size(array_distinct(hs)) = size(hs), 0L, {ordered}))[0]"
    return f"transform(array({words}), ws -> if(size(ws) <= {window}, 0L, {counted}))[0]"


def measures(text: str) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text column that is not null."""
    words = f"filter(split({text}, '{_GAP}+', -1), w -> w <> '')"
    lines = f"filter(split({text}, '\\n', -1), l -> l rlike '{_CHAR}')"
    return {
        "n_words": F.expr(f"cast(regexp_count({text}, '{_CHAR}+') as bigint)"),
        "word_chars": F.expr(f"cast(length(regexp_replace({text}, '{_GAP}+', '')) as bigint)"),
        "n_symbols": F.expr(f"cast(regexp_count({text}, '[#*$%&|<>]') as bigint)"),
        "n_dup_lines": F.expr(f"transform(array({lines}), ls -> cast(size(ls) - size(array_distinct(ls)) as bigint))[0]"),
        "n_repeat_words": F.expr(n_repeat_words(words)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def line_hashes(text: str) -> Column:
    """Hash of the normalised form, length and position of each line with a word, in order."""
    normal = f"regexp_replace(regexp_replace(lower({text}), '[0-9]', '0'), '[\\\\x20\\\\x09\\\\x0B-\\\\x0D]+', ' ')"
    return F.expr(f"transform(filter(transform(split({normal}, '\\n', -1), (l, p) -> named_struct('l', trim(l), 'p', p)), x -> x.l <> ''), x -> named_struct('h', xxhash64(x.l), 'c', length(x.l), 'p', x.p))")


def frequent_lines(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, h) of the lines over the limits. A null host is a host of its own.

    Rows that share a doc_id and host are one document; a row without doc_id is one of its own.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id()))
    rows = docs.select(F.col(host).cast("string").alias("host"), name.alias("doc"), F.col("text").cast("string").alias("t"))
    each = rows.select("host", "doc", F.explode(F.array_distinct(F.transform(line_hashes("t"), lambda x: x["h"]))).alias("h"))
    counts = each.distinct().groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    hosts = rows.select("host", "doc").distinct().groupBy("host").agg(F.count("*").alias("n_host"))
    return counts.join(hosts, counts["host"].eqNullSafe(hosts["host"])).where(F.col("n") >= min_share * F.col("n_host")).select(counts["host"], "h")


def without_frequent_lines(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """The columns of docs, `text` without its lines over the limits, then the measures of the whole text, line_chars and chars_left.

    Lines that stay are joined as they were, blank ones included. Null text stays null, and counts as empty. Columns of
    docs that are named as one of the counts are replaced. Rows that share a doc_id and host are one document for the
    counts of lines, a row without doc_id is one of its own. Texts of any length are read whole; a table without rows
    gives none. Needs doc_id, text and host.
    """
    bad = stage(frequent_lines(docs, host, min_docs, min_share), "frequent")
    small = bad.count() <= broadcast_lines
    bad = bad.groupBy(F.col("host").alias("of")).agg(F.collect_list("h").alias("bad"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(host).cast("string").alias("host"))
    if small:
        rows = rows.join(F.broadcast(bad), rows["host"].eqNullSafe(bad["of"]), "left")
    else:  # one host may hold a third of the rows
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("row.doc_id", "row.text"), F.lit(SALTS)).cast("int"))
        bad = bad.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(bad, rows["host"].eqNullSafe(bad["of"]) & (rows["salt"] == bad["to"]), "left")
    found = measures("coalesce(cast(row.text as string), '')")
    lines = line_hashes("coalesce(cast(row.text as string), '')")
    rows = rows.select("row", lines.alias("lines"), "bad", *[v.alias(k) for k, v in found.items()])
    rows = rows.withColumn("hit", F.when(F.col("bad").isNotNull(), F.array_intersect(F.transform("lines", lambda x: x["h"]), "bad")))
    rows = rows.withColumn("gone", F.when(F.size("hit") > 0, F.expr("transform(filter(lines, l -> array_contains(hit, l.h)), l -> l.p)")))
    left = F.expr("array_join(filter(split(cast(row.text as string), '\\n', -1), (l, p) -> not array_contains(gone, p)), '\n')")
    out = rows.withColumn("left", F.when(F.col("gone").isNull(), F.col("row.text").cast("string")).otherwise(left))
    chars = F.expr("aggregate(lines, 0L, (a, l) -> a + l.c)")
    again = F.aggregate(line_hashes("left"), F.lit(0).cast("long"), lambda a, x: a + x["c"])
    counts = {c: F.col(c) for c in found} | {"line_chars": chars, "chars_left": F.when(F.col("gone").isNull(), chars).otherwise(again)}
    return out.select(*[F.col("left").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in counts], *[v.alias(k) for k, v in counts.items()])


def judge(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """doc_id, the measures, base_failed, line_chars, removed_chars, kept of each row of docs.

    What was removed is counted from the remaining texts of without_frequent_lines(). Each row gets its own verdict.
    Only doc_id, text and host are read.
    """
    out = without_frequent_lines(docs.select(*dict.fromkeys(["doc_id", "text", host])), host, min_docs, min_share)
    out = out.withColumn("removed_chars", F.col("line_chars") - F.col("chars_left")).withColumn("base_failed", base_failed())
    enough = F.col("chars_left") >= min_left * F.col("line_chars")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & enough).alias("kept"), "line_chars", "removed_chars")
