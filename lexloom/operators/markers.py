"""Markers, preambles, schedules, footnotes, language and number scripts of a text. All are column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.packs import LEGAL, Pack


def literal(words) -> str:
    return "|".join(re.escape(w) for w in words)


def marker_positions(docs: DataFrame, markers, key: str = "doc_id", text: str = "text", width: int | None = None) -> DataFrame:
    """A row for each occurrence: key, line_number from 1, marker, position in its line and, with a width, the context in the line."""
    lines = docs.where(F.col(text).rlike(literal(markers))).select(key, F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    lines = lines.where(F.col("line").rlike(literal(markers)))
    found = T.find_each(F.col("line"), {m: re.escape(m) for m in markers})
    if width is not None:
        found = T.with_context(F.col("line"), found, width)
    out = lines.select(key, (F.col("at") + 1).alias("line_number"), F.explode(found).alias("m"))
    cols = [F.col(key), F.col("line_number"), F.col("m.kind").alias("marker"), F.col("m.position").alias("position")]
    return out.select(*cols, *([F.col("m.context").alias("context")] if width is not None else []))


def marker_counts(c: Column, pack: Pack = LEGAL) -> dict[str, Column]:
    return {name: T.total(c, list(patterns)) for name, patterns in pack.frequency.items()}


def marker_frequency(c: Column, pack: Pack = LEGAL, method: str = "raw_string_match") -> Column:
    """Marker to (count, method)."""
    return F.create_map(*[x for name, n in marker_counts(c, pack).items() for x in (F.lit(name), F.struct(n.alias("count"), F.lit(method).alias("method")))])


def content_language(c: Column, pack: Pack = LEGAL) -> Column:
    """bengali from one letter of that script on, else english, for empty and null text too."""
    return F.when(c.rlike(pack.native), "bengali").otherwise("english")


def language_ratios(c: Column, pack: Pack = LEGAL) -> tuple[Column, Column]:
    """Shares of native and Latin letters among both, with two decimals; 0 and 0 without any."""
    native, latin = T.letters(c, pack.native), T.letters(c, pack.latin)
    shares = F.transform(F.array(F.struct(native.alias("n"), latin.alias("l"))), lambda x: F.struct(_share(x["n"], x["l"]).alias("n"), _share(x["l"], x["n"]).alias("l")))[0]  # each counted once
    return shares["n"], shares["l"]


def _share(n: Column, rest: Column) -> Column:
    return F.when(n + rest == 0, F.lit(0.0)).otherwise(T.round2(n / F.greatest(n + rest, F.lit(1))))


def number_scripts(c: Column, pack: Pack = LEGAL) -> dict[str, Column]:
    bn, en = T.letters(c, pack.native_digits), T.letters(c, pack.latin_digits)
    scripts = F.array_compact(F.array(F.when(bn > 0, F.lit("bn_digits")), F.when(en > 0, F.lit("en_digits"))))
    return {"bn_digits": bn, "en_digits": en, "numeric_representation": scripts, "is_mixed": (bn > 0) & (en > 0)}


def clause(c: Column, patterns: dict[str, str]) -> dict[str, Column]:
    """Whether any of the patterns is there, the earliest position (or null), and the matches: kind, position, text."""
    found = T.find_each(c, patterns)
    return {"has": F.size(found) > 0, "position": F.array_min(F.transform(found, lambda m: m["position"])), "matches": found}


def preamble(c: Column, pack: Pack = LEGAL) -> dict[str, Column]:
    """As clause(); markers lists the matched words, those of the start and English patterns with repetitions."""
    out = clause(c, pack.preamble)
    again = [k for k in pack.preamble if "continuation" not in k and k != "label"]
    every = F.transform(F.filter(out["matches"], lambda m: m["kind"].isin(*again)), lambda m: m["text"])
    once = F.array_distinct(F.transform(F.filter(out["matches"], lambda m: ~m["kind"].isin(*again)), lambda m: m["text"]))
    return out | {"markers": F.concat(every, F.filter(once, lambda x: ~F.array_contains(every, x)))}


def enactment(c: Column, pack: Pack = LEGAL) -> dict[str, Column]:
    return clause(c, pack.enactment)


def footnotes(c: Column, pack: Pack = LEGAL) -> Column:
    return T.total(c, list(pack.footnotes))


def editorial(c: Column, pack: Pack = LEGAL) -> tuple[Column, Column]:
    """Whether there is editorial content, and its kinds."""
    kinds = F.array_compact(F.array(*[F.when(T.any_of(c, list(p)), F.lit(k)) for k, p in pack.editorial.items()]))
    return F.size(kinds) > 0, kinds


def schedule_references(c: Column, pack: Pack = LEGAL, apart: int = 5) -> Column:
    """Matches in the order of the patterns, less those nearer than `apart` to one taken before."""
    found = T.find_each(c, {str(i): p for i, p in enumerate(pack.schedules)})

    def take(acc, m):
        near = F.exists(acc, lambda x: F.abs(x["position"] - m["position"]) < apart)
        return F.when(near, acc).otherwise(F.concat(acc, F.array(F.struct(m["position"].alias("position"), m["text"].alias("text")))))

    return F.aggregate(found, F.array().cast(T.MATCH), take)


def schedule_distinction(c: Column, html: Column, pack: Pack = LEGAL) -> dict[str, Column]:
    """Textual references, tables in the page, and whether the schedules that are named are missing."""
    refs, tables = F.size(schedule_references(c, pack)).cast("long"), T.count(html, "(?i)<table[\\s>]")
    return {"schedule_references": refs, "schedule_tables": tables, "missing_schedule": (refs > 0) & (tables == 0)}


def legal_signal(c: Column, pack: Pack = LEGAL) -> tuple[Column, Column]:
    """Whether any signal is there, and the first kind in the order of the pack."""
    kind = F.coalesce(*[F.when(c.rlike(p), F.lit(k)) for k, p in pack.signals.items()])
    return kind.isNotNull(), kind


def legal_status(c: Column, pack: Pack = LEGAL) -> tuple[Column, Column]:
    """repealed or active, unknown for null; and the distinct first matches that say so."""
    first = [F.nullif(F.regexp_extract(c, f"({p})", 1), F.lit("")) for ps in pack.repealed.values() for p in ps]
    signs = F.array_distinct(F.array_compact(F.array(*first)))
    return F.when(c.isNull(), "unknown").when(F.size(signs) > 0, "repealed").otherwise("active"), signs


def numeric_regions(c: Column, pack: Pack = LEGAL) -> Column:
    return T.merge_regions(T.regions(c, pack.numeric))


def protected_regions(c: Column, pack: Pack = LEGAL, before: int = 50, after: int = 200) -> Column:
    return T.merge_regions(T.regions(c, pack.protected, before, after))


def protected_types(c: Column, pack: Pack = LEGAL) -> Column:
    return F.array_compact(F.array(*[F.when(T.any_of(c, list(p)), F.lit(k)) for k, p in pack.protected.items()]))


def content_stats(c: Column) -> dict[str, Column]:
    words = F.filter(F.split(c, f"[{T.WS}]+", -1), lambda w: w != "")
    return {"n_chars": F.length(c).cast("long"), "n_words": F.size(words).cast("long"), "n_lines": F.size(F.split(c, "\n", -1)).cast("long")}


def merged_spans(regions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Regions as rows (key, start, end, type) merged by gaps and islands; for documents with very many regions."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start") > before + 1), 1).otherwise(0)
    rows = regions.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"), F.count("*").alias("n_regions")).drop("island")
