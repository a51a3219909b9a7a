"""Sections, subsections and clauses of a text, and the scope that a reference stands in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import contains

# Section numbers end in U+09F7.
SECTION, SUBSECTION, CLAUSE = "[০-৯]+৷", r"\([০-৯]+\)", r"\([ক-ঢ]\)"


def sections(docs: DataFrame, pattern: str = SECTION, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section_at from 0, section_number, content_start and content_end of each section; it ends where the next starts."""
    rows = docs.where(F.col(text).rlike(pattern)).select(key, F.length(text).alias("size"), F.posexplode(T.find_all(F.col(text), pattern)).alias("section_at", "m"))
    after = F.lead("m.position").over(Window.partitionBy(key).orderBy("section_at"))
    return rows.select(key, "section_at", F.col("m.text").alias("section_number"), F.col("m.position").alias("content_start"), F.coalesce(after, F.col("size")).alias("content_end"))


def marks(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, marker and marker_offset of each subsection or clause."""
    return docs.where(F.col(text).rlike(pattern)).select(key, F.explode(T.find_all(F.col(text), pattern)).alias("m")).select(key, F.col("m.text").alias("marker"), F.col("m.position").alias("marker_offset"))


def tree(docs: DataFrame, section: str = SECTION, subsection: str = SUBSECTION, clause: str = CLAUSE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document with sections: the sections with their subsections and clauses, and totals.

    All marks of a document are put in order of their offset; a mark belongs to the last section before it.
    """
    c = F.col(text)
    kinds = T.find_each(c, {"0": section, "1": subsection, "2": clause})
    rows = docs.where(c.rlike(section)).select(key, F.length(c).alias("size"), F.explode(kinds).alias("m")).select(key, "size", F.col("m.kind").alias("kind"), F.col("m.position").alias("marker_offset"), F.col("m.text").alias("marker"))
    w = Window.partitionBy(key).orderBy("marker_offset", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section_at", F.sum(F.when(F.col("kind") == "0", 1).otherwise(0)).over(w).cast("int") - 1).where("section_at >= 0")
    lists = [F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("marker_offset", "marker")))).alias(name) for k, name in (("1", "subsections"), ("2", "clauses"))]
    is_section = F.col("kind") == "0"
    each = rows.groupBy(key, "section_at").agg(F.max("size").alias("size"), F.max(F.when(is_section, F.col("marker"))).alias("section_number"), F.max(F.when(is_section, F.col("marker_offset"))).alias("content_start"), *lists)
    each = each.withColumn("content_end", F.coalesce(F.lead("content_start").over(Window.partitionBy(key).orderBy("section_at")), "size"))
    item = F.struct("section_at", "section_number", "content_start", "content_end", "subsections", "clauses")
    return each.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("sections"), F.count("*").alias("total_sections"), F.sum(F.size("subsections")).alias("total_subsections"), F.sum(F.size("clauses")).alias("total_clauses"))


def anchored(refs: DataFrame, spans: DataFrame, points: DataFrame, key: str = "doc_id", at: str = "position") -> DataFrame:
    """Each reference with section_number, the section that it lies in, and marker, the last mark before it in that section.

    Sections don't overlap. Starts of sections, marks and references of a document are put in one order, in which a
    reference looks back to the last of each; nothing is paired.
    """
    none = F.lit(None)
    section = F.struct("section_number", "content_start", "content_end")
    ref = F.struct(*refs.columns)
    marked = F.struct("marker", "marker_offset")
    kinds = {"__s": section, "__m": marked, "__r": ref}
    types = {"__s": spans.select(section.alias("x")).schema["x"].dataType, "__m": points.select(marked.alias("x")).schema["x"].dataType, "__r": refs.select(ref.alias("x")).schema["x"].dataType}

    def part(df, name, offset, rank):
        return df.select(F.col(key).alias("__k"), F.col(offset).cast("long").alias("__at"), F.lit(rank).alias("__rank"), *[(kinds[k] if k == name else none.cast(types[k])).alias(k) for k in kinds])

    rows = part(spans, "__s", "content_start", 0).unionByName(part(points, "__m", "marker_offset", 1)).unionByName(part(refs, "__r", at, 2))
    w = Window.partitionBy("__k").orderBy("__at", "__rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"__s": F.last("__s", True).over(w), "__m": F.last("__m", True).over(w)}).where("__r is not null")
    inside = F.col("__at") < F.col("__s.content_end")
    rows = rows.withColumn("__s", F.when(inside, F.col("__s")))
    return rows.select("__r.*", F.col("__s.section_number").alias("section_number"), F.when(F.col("__m.marker_offset") >= F.col("__s.content_start"), F.col("__m.marker")).alias("marker"))


def merged_references(linked: DataFrame, matched: DataFrame, key: str = "doc_id") -> DataFrame:
    """Links first, then pattern matches; one for each offset, none for -1."""
    both = linked.withColumn("source", F.lit("link")).withColumn("rank", F.lit(0)).unionByName(matched.withColumn("source", F.lit("pattern")).withColumn("rank", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key, "position").orderBy("rank", "citation_text")
    return both.where("position >= 0").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "rank")


def amendments_in_sections(sections_: DataFrame, amendments: DataFrame, key: str = "doc_id", section: str = "section_at", body: str = "body") -> DataFrame:
    """Sections (key, section, body) with each amendment of their document whose trimmed line stands in the body: marker and line.

    The distinct lines of a document are looked for by their rarest words; see contains.pairs().
    """
    a = amendments.select(key, F.col("marker"), T.trim(F.col("line")).alias("line")).where("line <> ''").withColumn("__line", F.sha2("line", 256))
    found = contains.pairs(sections_, a.select(key, "__line", "line").distinct(), section, body, "__line", "line", [key])
    return sections_.join(found, [key, section]).join(a, [key, "__line"]).drop("__line")


def heading(title: Column, pattern: str = SECTION) -> tuple[Column, Column]:
    """Number and the text before it, from a section's title."""
    number = F.nullif(F.regexp_extract(title, f"({pattern})", 1), F.lit(""))
    return number, T.trim(F.when(number.isNull(), title).otherwise(F.call_function("substring_index", title, number, F.lit(1))))
