"""Line dedup by winnowing over line hashes.

A line of a document is deleted if it lies in a run of consecutive lines, of at least `min_words` words together, that
also occurs at an earlier place: in a document that comes before by (doc_id, number of the row), or earlier in the
same one. Lines are compared after folding case and white space; blank lines are passed over.

A window is the shortest span of lines from a line on that has `min_words` words. Its line with the least hash is a
fingerprint, so any repeated run has the same fingerprints wherever it occurs. Positions of repeated fingerprints are
joined to the documents. From there the matches are extended both ways: of the windows that hold a repeated
fingerprint, forwards from each line and backwards from each line, those count whose content has an earlier place.
A repeated run is the union of its forward and backward windows, so runs are deleted in full, and the first place of
a window, a minimum, decides. So no line or passage is ever expanded into pairs, however often it occurs.

All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WORD_CHAR, WORD_GAP, numbered, stage

#: Words that a repeated run has at least.
MIN_WORDS = 50


def _sql(form: str, **parts: str) -> Column:
    for name, part in parts.items():
        form = form.replace("{" + name + "}", part)
    return F.expr(form)


def lines_of(text: str) -> Column:
    """The lines with a word: position, hash of the folded line, length in characters, number of words."""
    gap = WORD_GAP.replace("\\", "\\\\")
    fold = f"trim(regexp_replace(lower(l), '{gap}+', ' '))"
    return _sql(
        """filter(transform(split({text}, '\\n', -1), (l, p) -> transform(array({fold}),
             f -> named_struct('p', p, 'h', xxhash64(f), 'c', length(f), 'w', if(f = '', 0, 1 + length(f) - length(replace(f, ' ', '')))))[0]),
           x -> x.w > 0)""",
        fold=fold,
        text=text,
    )


def fingerprints(lines: str, min_words: int) -> Column:
    """Distinct hashes that are least in some window, with their index in `lines`."""
    return _sql(
        """array_distinct(filter(transform({lines}, (x, i) -> aggregate(slice({lines}, i + 1, {most}),
             named_struct('w', 0, 'h', cast(null as bigint), 'i', i, 'k', i),
             (a, y) -> if(a.w >= {most}, a, named_struct('w', a.w + y.w, 'h', least(a.h, y.h), 'i', if(a.h is null or y.h < a.h, a.k, a.i), 'k', a.k + 1)),
             a -> if(a.w >= {most}, named_struct('h', a.h, 'i', a.i), null))), x -> x is not null))""",
        lines=lines,
        most=str(min_words),
    )


def _windows(back: bool, min_words: int) -> Column:
    """Spans with `min_words` words, [first, last] by index in `lines`, that hold a hit; next_hit: the first one from each index on."""
    rows = f"reverse(slice(lines, greatest(i - {min_words} + 2, 1), least(i + 1, {min_words})))" if back else f"slice(lines, i + 1, {min_words})"
    size = f"aggregate({rows}, named_struct('w', 0, 'n', 0), (a, y) -> if(a.w >= {min_words}, a, named_struct('w', a.w + y.w, 'n', a.n + 1)), a -> if(a.w >= {min_words}, a.n, 0))"
    span = "named_struct('first', i - n + 1, 'last', i)" if back else "named_struct('first', i, 'last', i + n - 1)"
    return F.expr(
        f"""filter(transform(sequence(0, size(lines) - 1), i -> transform(array({size}), n -> if(n = 0, null, {span}))[0]),
              s -> s is not null and coalesce(get(next_hit, s.first) <= s.last, false))"""
    )


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Staged rows: `row` (a struct of docs' columns), `rid`, `lines`, and `deleted`, the indices in `lines` of repeated lines.

    Null and empty texts have no lines. Documents without id come first. Repeated rows count one after another.
    """
    rows = numbered(docs.select(F.struct(*docs.columns).alias("row")))
    rows = stage(rows.withColumn("lines", F.coalesce(lines_of("row.text"), F.array().cast("array<struct<p:int,h:bigint,c:int,w:int>>"))), "lines")
    marks = rows.select("rid", F.explode(fingerprints("lines", min_words)).alias("f")).select("rid", "f.h", "f.i")
    marks = stage(marks, "marks")
    seen = marks.groupBy("h").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.min("i").alias("first"), F.max("i").alias("last"))
    again = stage(seen.where("lo <> hi or first <> last").select("h"), "again")  # see below
    hits = marks.join(again, "h", "left_semi").groupBy("rid").agg(F.array_sort(F.collect_set("i")).alias("hits"))
    next_hit = F.expr("flatten(transform(hits, (h, k) -> array_repeat(h, h - coalesce(get(hits, k - 1), -1))))")
    spans = rows.select("rid", F.col("row.doc_id").alias("doc_id"), "lines").join(hits.select("rid", next_hit.alias("next_hit")), "rid")
    spans = spans.select("rid", "doc_id", "lines", F.explode(F.array_distinct(F.concat(_windows(False, min_words), _windows(True, min_words)))).alias("s"))
    content = F.transform(F.slice("lines", F.col("s.first") + 1, F.col("s.last") - F.col("s.first") + 1), lambda x: F.struct(x["h"], x["c"]))
    spans = stage(spans.select("rid", "doc_id", "s.first", "s.last", F.xxhash64(content).alias("k1"), F.xxhash64(F.lit(1), content).alias("k2")), "spans")
    # staged, so that both sides of the join are plain shuffles, of which a common window's is split
    start = spans.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "rid", "first")).alias("start"), F.count("*").alias("n")).where("n > 1").drop("n")
    start = stage(start, "starts")
    later = spans.join(start, ["k1", "k2"]).where((F.col("rid") != F.col("start.rid")) | (F.col("first") != F.col("start.first")))
    gone = later.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("first", "last")))).alias("deleted"))
    return rows.join(gone, "rid", "left").withColumn("deleted", F.coalesce("deleted", F.array().cast("array<int>")))


def deduped(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`row`, a struct of docs' columns, then `text` without its repeated lines, n_lines, n_deleted and words_deleted, of lines with a word.

    Lines that stay are joined as they were, blank ones included. Null text stays null. Needs doc_id and text.
    """
    out = repeated_lines(docs, min_words)
    left = F.expr(
        """transform(array(split(row.text, '\\n', -1)), ls -> array_join(
             transform(array_except(sequence(0, size(ls) - 1), transform(deleted, i -> lines[i].p)), p -> ls[p]), '\n'))[0]"""
    )
    text = F.when(F.size("deleted") == 0, F.col("row.text")).otherwise(left).alias("text")
    counts = (F.size("lines").cast("long").alias("n_lines"), F.size("deleted").cast("long").alias("n_deleted"), F.expr("aggregate(deleted, 0L, (a, i) -> a + lines[i].w)").alias("words_deleted"))
    return out.select("row", text, *counts)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of docs with the new text, and the counts of deduped(), which replace columns of their names."""
    counts = ("n_lines", "n_deleted", "words_deleted")
    return deduped(docs, min_words).select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in counts], *counts)
