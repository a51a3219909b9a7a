"""Citations with exact offsets: detection by line, parts, context, negation, relation, confidence, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.packs import LEGAL, Pack


def _group(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit("")) if k else F.lit(None).cast("string")


def detect(docs: DataFrame, pack: Pack = LEGAL, key: str = "doc_id", text: str = "text", width: int = 50, negation_width: int = 20) -> DataFrame:
    """A row for each match of each family, overlaps included; see deduplicated().

    Lines are searched one by one; position is absolute. Texts without any match are dropped before they are split,
    lines without one before rows are made of them, and a row carries its line with `width` characters on both sides.
    """
    anything = "|".join(f"(?:{c.pattern})" for c in pack.citations.values())
    whole, reach = F.col(text), max(width, negation_width)
    starts = F.concat(F.array(F.lit(0)), F.transform(T.find_all(whole, "\n"), lambda m: m["position"] + 1))
    lines = docs.where(whole.rlike(anything)).select(key, whole.alias("__c"), F.arrays_zip(F.split(whole, "\n", -1).alias("line"), starts.alias("start")).alias("__l"))

    def held(x):
        from_ = F.greatest(x["start"] - reach, F.lit(0))
        return F.struct(x["line"].alias("line"), x["start"].alias("line_start"), from_.alias("from"), F.substring(F.col("__c"), from_ + 1, x["start"] - from_ + F.length(x["line"]) + reach).alias("content"))

    numbered = F.transform(F.col("__l"), lambda x, i: F.struct(x["line"].alias("line"), x["start"].alias("start"), (i + 1).alias("n")))
    kept = F.filter(numbered, lambda x: x["line"].rlike(anything))
    lines = lines.select(key, F.explode(F.transform(kept, lambda x: F.struct(x["n"].alias("line_number"), held(x).alias("at")))).alias("x")).select(key, "x.line_number", "x.at.*")
    found = T.find_each(F.col("line"), {k: c.pattern for k, c in pack.citations.items()})
    rows = lines.select(key, "content", "from", "line_number", "line_start", F.explode(found).alias("m"))
    rows = rows.select(key, "content", "from", "line_number", (F.col("line_start") + F.col("m.position")).alias("position"), F.col("m.text").alias("citation_text"), F.col("m.kind").alias("pattern_type"))
    parts = {"act_name": [], "citation_year": [], "citation_serial": [], "script": []}
    for kind, c in pack.citations.items():
        here, ct = F.col("pattern_type") == kind, F.col("citation_text")
        years = [_group(ct, c.pattern, k) for k in c.years]
        for name, value in (("act_name", T.trim(_group(ct, c.pattern, c.name))), ("citation_year", F.coalesce(*years) if years else F.lit(None).cast("string")), ("citation_serial", _group(ct, c.pattern, c.serial)), ("script", F.lit(c.script))):
            parts[name].append(F.when(here, value))
    rows = rows.withColumns({name: F.coalesce(*v) for name, v in parts.items()})
    size = F.length("citation_text")
    at = F.col("position") - F.col("from")
    before, after = T.around(F.col("content"), at, size, width)
    near = F.substring("content", F.greatest(at - negation_width, F.lit(0)) + 1, F.least(at, F.lit(negation_width)) + negation_width)
    rows = rows.withColumns({"context_before": before, "context_after": after, "negation_word": negation(near, pack)})
    rows = rows.withColumn("negation_present", F.col("negation_word").isNotNull())
    rows = rows.withColumn("relation", F.when(F.col("negation_present"), "mention").otherwise(relation(F.concat_ws(" ", "context_before", "citation_text", "context_after"), pack)))
    return rows.withColumn("confidence", confidence(F.col("act_name"), F.col("citation_year"), F.col("citation_serial"))).drop("content", "from")


def short(c: Column, pack: Pack = LEGAL, kinds=(("BENGALI_ACT_SHORT", "bengali_citation"), ("ENGLISH_ACT_SHORT", "english_citation"))) -> Column:
    """The short citations of a text by position: kind, position, text; at one place in the order of kinds."""
    found = T.find_each(c, {name: pack.citations[kind].pattern for kind, name in kinds})
    order = F.transform(found, lambda m, i: F.struct(m["position"].alias("position"), i.alias("i"), m["kind"].alias("kind"), m["text"].alias("text")))
    return F.transform(F.array_sort(order), lambda m: F.struct(m["kind"].alias("kind"), m["position"].alias("position"), m["text"].alias("text")))


def negation(near: Column, pack: Pack = LEGAL) -> Column:
    """The longest negation that the text holds, anywhere in it, or null."""
    words = sorted(pack.negations, key=len, reverse=True)
    return F.coalesce(*[F.when(F.contains(near, F.lit(w)), F.lit(w)) for w in words]) if words else F.lit(None).cast("string")


def relation(context: Column, pack: Pack = LEGAL) -> Column:
    """The first kind of which a keyword is part of the context, whatever its case; else mention."""
    low, out = F.lower(context), F.lit("mention")
    for kind, words in reversed(pack.relations.items()):
        held = F.lit(False)
        for w in words:
            held = held | F.contains(low, F.lit(w.lower()))
        out = F.when(held, F.lit(kind)).otherwise(out)
    return out


def confidence(name: Column, year: Column, serial: Column) -> Column:
    has = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    return F.when(has(name) & has(year) & has(serial), "high").when(has(year) & has(serial), "medium").otherwise("low")


def deduplicated(refs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Overlaps go: from the left, the longest of those at one place first, each that starts before the last kept end."""
    fields = [c for c in refs.columns if c != key]
    one = F.struct(F.col("position").alias("__p"), (-F.length("citation_text")).alias("__l"), F.struct(*fields).alias("ref"))
    lists = refs.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("refs"))  # bounded by one document's text
    kept = F.aggregate(
        "refs",
        F.struct(F.lit(-1).alias("end"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("i")),
        lambda a, x: F.struct(
            F.when(x["__p"] < a["end"], a["end"]).otherwise(x["__p"] - x["__l"]).alias("end"),
            F.when(x["__p"] < a["end"], a["at"]).otherwise(F.concat(a["at"], F.array(a["i"]))).alias("at"),
            (a["i"] + 1).alias("i"),
        ),
        lambda a: a["at"],
    )
    lists = lists.withColumn("kept", kept)
    return lists.select(key, F.explode(F.transform("kept", lambda i: F.get("refs", i)["ref"])).alias("ref")).select(key, "ref.*")


def envelope(refs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The references of each document as one record, in order of position."""
    fields = [c for c in refs.columns if c != key]
    items = F.array_sort(F.collect_list(F.struct("position", F.struct(*fields).alias("ref"))))
    return refs.groupBy(key).agg(items.alias("items")).select(key, F.size("items").cast("long").alias("count"), F.lit("pattern_based").alias("method"), F.transform("items", lambda x: x["ref"]).alias("references"))
