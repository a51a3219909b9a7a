"""What a page holds, by one parse: links, section rows, tables, schedules and signs that it shows less than all.

A pandas UDF parses each page once and returns typed lists; rows are made of them by column expressions. staged()
writes the lists once, for callers that want several kinds of rows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom
from ..functions.packs import LEGAL_PAGES, Pages
from ..functions.shipping import ship
from ..sources import scratch

LINK = "struct<title:string,href:string,act_id:string,section_at:int>"
SECTION = "struct<title:string,body:string,html:string,has_table:boolean>"
TABLE = "struct<data:array<array<string>>,has_merged_cells:boolean,row_count:int,col_count:int>"
SCHEDULE = "struct<selector:string,html:string,has_table:boolean>"
RISK = "struct<type:string,selector:string,element_count:int,sample_text:string,href:string,content_length:int>"
FACTS = f"links array<{LINK}>, sections array<{SECTION}>, tables array<{TABLE}>, schedules array<{SCHEDULE}>, names_schedules boolean, risks array<{RISK}>"


def _schedules(root: dom.Node, rules: Pages) -> list[dict]:
    """Schedule elements, then the tables in the first box of each kind; equal markup counts once."""
    out: dict[str, dict] = {}
    for sel in rules.schedule_elements:
        for n in dom.select(root, sel):
            out.setdefault(n.html(), {"selector": sel, "has_table": n.tag == "table" or dom.first(n, "table") is not None})
    for sel in rules.schedule_boxes:
        box = dom.first(root, sel)
        for n in dom.select(box, "table") if box is not None else ():
            out.setdefault(n.html(), {"selector": f"{sel} table", "has_table": True})
    return [{"html": markup, **what} for markup, what in out.items()]


def _sample(text: str) -> str:
    return text[:100].strip()


def _risks(root: dom.Node, rules: Pages) -> list[dict]:
    """Elements that page through the text, load it late, link to parts elsewhere or hide more than 50 characters."""
    out = []
    for sel in rules.pagination:
        nodes = dom.select(root, sel)
        said = next((t for n in nodes if re.search(rules.pagination_words, t := n.text()) or dom.first(n, "a") is not None), None)
        if said is not None:
            out.append({"type": "pagination", "selector": sel, "element_count": len(nodes), "sample_text": _sample(said)})
    late = next(((sel, nodes) for sel in rules.lazy if (nodes := dom.select(root, sel))), None)
    if late:
        out.append({"type": "lazy_load", "selector": late[0], "element_count": len(late[1])})
    for sel in rules.external:
        for n in dom.select(root, sel):
            href = n.attrs.get("href") or ""
            if not href.startswith(("#", "javascript:")):
                out.append({"type": "external_link", "selector": sel, "href": href, "sample_text": _sample(n.text())})
    for sel in rules.hidden:
        said = next((t for n in dom.select(root, sel) if len((t := n.text()).strip()) > 50), None)
        if said is not None:
            out.append({"type": "hidden_dom", "selector": sel, "content_length": len(said), "sample_text": _sample(said)})
    empty = dict.fromkeys(("element_count", "sample_text", "href", "content_length"))
    return [empty | r for r in out]


def read(page: str | None, rules: Pages) -> tuple:
    """The facts of one page, in the order of FACTS; null and empty pages have none."""
    root = dom.parse(page, rules.closed_references)
    text = lambda n, sel: "\n".join(x.text().strip() for x in dom.select(n, sel))
    rows = dom.select(root, rules.rows)
    sections = [{"title": text(n, rules.row_title), "body": text(n, rules.row_body), "html": n.html(), "has_table": dom.first(n, "table") is not None} for n in rows]
    links = []
    for a in dom.select(root, rules.links):
        m = re.search(rules.link_id, a.attrs.get("href") or "")
        links.append({"title": a.text().strip(), "href": a.attrs.get("href"), "act_id": m and m[1], "section_at": next((i for i, r in enumerate(rows) if a.within(r)), None)})
    tables = []
    for t in dom.select(root, "table"):
        data, merged = dom.matrix(t)
        tables.append({"data": data, "has_merged_cells": merged, "row_count": len(data), "col_count": len(data[0]) if data else 0})
    body = dom.first(root, "body") or root
    said = body.text()
    return links, sections, tables, _schedules(root, rules), any(re.search(p, said) for p in rules.schedule_words), _risks(root, rules)


def of(html: Column | str, rules: Pages = LEGAL_PAGES) -> Column:
    """The facts of a page as one column, a struct of lists."""

    @F.pandas_udf(FACTS)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(p, rules) for p in s], columns=["links", "sections", "tables", "schedules", "names_schedules", "risks"])

    return run(html)


def parsed(pages: DataFrame, rules: Pages = LEGAL_PAGES, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and the facts of each page."""
    return pages.select(key, of(html, rules).alias("f")).select(key, "f.*")


def staged(pages: DataFrame, rules: Pages = LEGAL_PAGES, key: str = "page_id", html: str = "html") -> DataFrame:
    """parsed(), written once and read from there by column, so that several kinds of rows cost one parse a page."""
    out = parsed(pages, rules, key, html)
    path = scratch.folder(pages.sparkSession, "facts")
    out.write.parquet(path)
    return pages.sparkSession.read.schema(out.schema).parquet(path)


def rows(facts: DataFrame, kind: str, key: str = "page_id") -> DataFrame:
    """key, the place of each fact of a kind (links, sections, tables, schedules, risks) as `at` from 0, and its fields."""
    return facts.select(key, F.posexplode(kind).alias("at", "x")).select(key, "at", "x.*")


def risk(risks: str = "risks") -> Column:
    """possible_truncation, reason (the kinds in order of detection, or none) and detected_risks."""
    kinds = F.array_join(F.array_distinct(F.transform(risks, lambda r: r["type"])), ", ")
    return F.struct((F.size(risks) > 0).alias("possible_truncation"), F.when(F.size(risks) > 0, kinds).otherwise("none").alias("reason"), F.col(risks).alias("detected_risks"))


def schedule(schedules: str = "schedules", named: str = "names_schedules") -> Column:
    """The capture of a page's schedules: markup as it is, how many, whether they have tables, and whether they are named but missing."""
    markup = F.array_join(F.transform(schedules, lambda s: s["html"]), "\n\n")
    elements = F.transform(schedules, lambda s: F.struct(s["selector"].alias("selector"), s["has_table"].alias("has_table"), F.length(s["html"]).alias("html_length")))
    return F.struct(
        F.lit("raw_html").alias("representation"), F.lit("verbatim_dom_capture").alias("extraction_method"), F.lit(False).alias("processed"), F.when(F.size(schedules) > 0, markup).alias("html_content"),
        F.size(schedules).alias("schedule_count"), F.exists(schedules, lambda s: s["has_table"]).alias("has_tables"), ((F.size(schedules) == 0) & F.col(named)).alias("missing_schedule_flag"), elements.alias("schedule_elements"),
    )


ship(__name__)
