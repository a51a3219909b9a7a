"""Acts from pages: the chain of places where a page may hold its text, section rows, links, structure and scope.

The element tree is walked once a page, in one pandas UDF; what follows from the text is column expressions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom
from ..functions import text as T
from ..functions.packs import LEGAL, LEGAL_PAGES, Pack, Pages
from . import citations, html, markers, structure
from ..functions.shipping import ship

ATTEMPT = "struct<selector_order:int,selector:string,matched:boolean,element_count:int>"
SECTION = "struct<dom_index:int,section_title:string,section_body:string,has_table:boolean>"
TABLE = "struct<section_index:int,data:array<array<string>>,has_merged_cells:boolean>"
LINK = "struct<citation_text:string,href:string,act_id:string,dom_section_index:int>"
READ = f"title string, content string, method string, selector string, attempts array<{ATTEMPT}>, metadata string, sections array<{SECTION}>, tables array<{TABLE}>, links array<{LINK}>, schedules array<string>"
_ENDS = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def _text(n: dom.Node | None) -> str:
    return n.text().strip(_ENDS) if n is not None else ""


def _title(root: dom.Node, rules: Pages) -> str:
    """The first selector whose first element has text, else the page's title without the site's name."""
    for sel in rules.title:
        if found := _text(dom.first(root, sel)):
            return found
    out = dom.first(root, "title")
    out = out.text() if out is not None else ""
    for p in rules.site_suffixes:
        out = re.sub(p, "", out)
    return out.strip(_ENDS)


def _tables(nodes: list[dom.Node], index: int | None) -> list[dict]:
    out = []
    for i, t in enumerate(nodes):
        data, merged = dom.matrix(t)
        if data:
            out.append({"section_index": i if index is None else index, "data": data, "has_merged_cells": merged})
    return out


def _rows(root: dom.Node, rules: Pages) -> tuple[list[str], str | None, list[dict], list[dict]]:
    """Parts before the first row, metadata, the section rows, and the tables in them."""
    box = dom.first(root, rules.container)
    if box is None:
        return [], None, [], []
    parts = [_text(dom.first(box, sel)) for sel in rules.opening]
    if rules.preamble:
        parts += [_text(n) for n in dom.select(box, rules.preamble) if rules.preamble_not not in (n.attrs.get("class") or "").split()]
    metadata = next((t for sel in rules.opening if (t := _text(dom.first(box, sel)))), None)
    sections, tables = [], []
    for i, row in enumerate(dom.select(box, rules.rows)):
        body = dom.first(row, rules.row_body)
        inside = dom.select(body, "table") if body is not None else []
        sections.append({"dom_index": i, "section_title": _text(dom.first(row, rules.row_title)), "section_body": _text(body), "has_table": bool(inside)})
        tables += _tables(inside, i)
    return [p for p in parts if p], metadata, sections, tables


def _links(root: dom.Node, rules: Pages) -> list[dict]:
    """Links in the container to other acts, with the section row that each stands in."""
    box = dom.first(root, rules.container)
    rows = dom.select(box, rules.rows) if box is not None else []
    out = []
    for a in dom.select(box, rules.links) if box is not None else []:
        if said := _text(a):
            m = re.search(rules.link_id, a.attrs.get("href") or "")
            out.append({"citation_text": said, "href": a.attrs.get("href"), "act_id": m and m[1], "dom_section_index": next((i for i, r in enumerate(rows) if a.within(r)), None)})
    return out


def read_page(page: str | None, rules: Pages, broader: bool = False) -> dict:
    """What one page holds. Section rows come first, then the content selectors, the fallback, the page's head matter,
    and the body without what is excluded; schedules that the text doesn't hold are added to it."""
    root = dom.parse(page, rules.closed_references)
    title, attempts = _title(root, rules), []
    before, metadata, sections, tables = _rows(root, rules)
    links, schedules = _links(root, rules), list(dict.fromkeys(n.html() for sel in rules.schedule for n in dom.select(root, sel)))
    out = {"title": title, "metadata": metadata, "sections": sections, "links": links, "attempts": attempts, "schedules": schedules}
    if sections:
        parts = ["\n".join(filter(None, (s["section_title"], s["section_body"]))) for s in sections]
        return out | {"content": "\n\n".join(filter(None, [*before, *parts])), "method": "structured", "selector": rules.container, "tables": tables}
    content = method = selector = None
    chain = (("broader", rules.broader),) if broader else (("primary", rules.content), ("fallback", rules.fallback), ("meta", rules.meta))
    for kind, group in chain:
        for sel in group if not content else ():
            nodes = dom.select(root, sel)
            texts = [t for n in nodes if (t := _text(n))]
            attempts.append({"selector_order": len(attempts) + 1, "selector": sel, "matched": bool(texts), "element_count": len(nodes)})
            if texts:
                content, method, selector = texts[0], kind, sel
                break
    all_schedules = "\n\n".join(t for sel in rules.schedule for n in dom.select(root, sel) if (t := _text(n)))
    tables = _tables(dom.select(root, "table"), None)
    if not content:
        content = _text(dom.without(dom.first(root, "body") or root, list(rules.excluded)))
        attempts.append({"selector_order": len(attempts) + 1, "selector": "body", "matched": bool(content), "element_count": 1})
        method, selector = ("body_fallback", "body") if content else (None, None)
    if all_schedules and all_schedules not in content:
        content = f"{content}\n\n{all_schedules}" if content else all_schedules
    return out | {"content": content, "method": method, "selector": selector, "tables": tables}


def act_content(pages: DataFrame, rules: Pages = LEGAL_PAGES, pack: Pack = LEGAL, html_column: str = "html", broader: bool = False) -> DataFrame:
    """pages with what read_page() finds, without noise, and extraction_success.

    Text from the body alone counts only with a legal signal in it. Null and empty pages have empty text and no
    success. broader: the wider list of selectors, for another try after the standard one found nothing.
    """

    @F.pandas_udf(READ)
    def run(s: pd.Series) -> pd.DataFrame:
        names = [x.split()[0] for x in READ.split(", ")]
        return pd.DataFrame([read_page(p, rules, broader) for p in s], columns=names)

    run = run.asNondeterministic()  # else each use of a field reads the page, and makes it, once more
    kept = [c for c in pages.columns if c not in {x.split()[0] for x in READ.split(", ")}]
    out = pages.select(*kept, run(html_column).alias("__x")).select(*kept, "__x.*")
    sections = F.transform("sections", lambda x: x.withField("section_body", html.noise_free(x["section_body"], rules.noise)))
    out = out.withColumns({"content": html.noise_free(F.col("content"), rules.noise), "sections": sections})
    signal = F.coalesce(markers.legal_signal(F.col("content"), pack)[0], F.lit(False))
    return out.withColumn("extraction_success", (F.length("content") > 0) & (~F.coalesce(F.col("method") == "body_fallback", F.lit(False)) | signal))


def strategy(broader: bool) -> str:
    """The name under which an attempt is logged."""
    return "broader_selectors" if broader else "standard_selectors"


def marked_content(pages: DataFrame, rules: Pages = LEGAL_PAGES, pack: Pack = LEGAL, html_column: str = "html") -> DataFrame:
    """act_content() with marker counts, preamble, enactment clause and the difference between named and present schedules."""
    out = act_content(pages, rules, pack, html_column)
    c = F.col("content")
    opening, enacted = markers.preamble(c, pack), markers.enactment(c, pack)
    named = markers.schedule_distinction(c, F.col(html_column), pack)
    return out.withColumns({"marker_frequency": markers.marker_frequency(c, pack), "has_preamble": opening["has"], "preamble_at": opening["position"], "has_enactment": enacted["has"], "enactment_at": enacted["position"], **named})


# ---- structure and references


def with_scope(read: DataFrame, pack: Pack = LEGAL, number: str = structure.SECTION, subsection: str = structure.SUBSECTION, clause: str = structure.CLAUSE) -> DataFrame:
    """read, from act_content(), with section_list and reference_list. All is made within the row; nothing is shuffled.

    A section has number and heading from its title, where its body is first found in the content (-1 if it isn't
    there), and its subsections and clauses by place in the body. References are links first, then short citations in
    section bodies, one for each offset of the content that is found, in order, with scope: the section of their row
    and the last subsection and clause before them in it. Null sections and links count as none.
    """
    content = F.col("content")

    def section(s):
        section_number, heading = structure.heading(s["section_title"], number)
        body = s["section_body"]
        start = T.offset_of(content, body)
        end = F.when(start >= 0, start + F.length(T.trim(body))).otherwise(-1)
        return F.struct(s["dom_index"].alias("dom_index"), section_number.alias("section_number"), F.nullif(heading, F.lit("")).alias("heading"), body.alias("body_text"), start.alias("content_start"), end.alias("content_end"), s["has_table"].alias("has_table"), T.find_all(body, subsection).alias("subsections"), T.find_all(body, clause).alias("clauses"))

    def link(x):
        return F.struct(T.offset_of(content, x["citation_text"]).alias("position"), x["citation_text"].alias("citation_text"), x["href"].alias("href"), x["act_id"].alias("act_id"), F.lit("link").alias("source"), x["dom_section_index"].alias("dom_section_index"))

    def cited(s):
        at = lambda m: F.when(s["content_start"] >= 0, s["content_start"] + m["position"]).otherwise(-1)
        none = F.lit(None).cast("string")
        return F.transform(citations.short(s["body_text"], pack), lambda m: F.struct(at(m).alias("position"), m["text"].alias("citation_text"), none.alias("href"), none.alias("act_id"), F.lit("pattern").alias("source"), s["dom_index"].alias("dom_section_index")))

    def scoped(own, r):
        at = r["position"] - own["content_start"]
        before = lambda c: F.try_element_at(F.filter(own[c], lambda m: m["position"] <= at), F.lit(-1))["text"]
        scope = F.struct(own["section_number"].alias("section_number"), before("subsections").alias("subsection"), before("clauses").alias("clause"), r["dom_section_index"].alias("dom_section_index"))
        return F.struct(*[r[c].alias(c) for c in ("position", "citation_text", "href", "act_id", "source")], scope.alias("scope"))

    def all_scoped(x):  # section rows are counted from 0, so a row's section is found by its place
        own = lambda r: F.array(F.get(x["sections"], r["dom_section_index"]))
        return F.transform(x["refs"], lambda r: F.get(F.transform(own(r), lambda o: scoped(o, r)), 0))

    def listed(links, sections):
        every = F.concat(F.coalesce(F.transform(links, link), F.array()), F.flatten(F.transform(sections, cited)))
        ordered = F.array_sort(F.transform(F.filter(every, lambda r: r["position"] >= 0), lambda r, i: F.struct(r["position"].alias("position"), i.alias("i"), r.alias("r"))))
        first = F.get(F.transform(F.array(ordered), lambda x: F.filter(x, lambda r, i: (i == 0) | (F.get(x, i - 1)["position"] != r["position"]))), 0)
        return F.transform(first, lambda x: x["r"])

    # each list is bound to the argument of a lambda, so that it is worked out once a row
    bound = F.array(F.coalesce(F.transform("sections", section), F.array()))
    refs = F.transform(bound, lambda s: F.struct(s.alias("sections"), listed(F.col("links"), s).alias("refs")))
    both = F.transform(refs, lambda x: F.struct(x["sections"].alias("section_list"), all_scoped(x).alias("reference_list")))
    return read.select("*", F.inline(both))  # a row for each, so that later columns name results and not the work anew


def dom_sections(read: DataFrame, key: str, *rules) -> DataFrame:
    """A row for each section row of a page; rules as for with_scope()."""
    return with_scope(read, *rules).select(key, F.explode("section_list").alias("s")).select(key, "s.*")


def references(read: DataFrame, key: str, *rules) -> DataFrame:
    """A row for each reference of a page."""
    return with_scope(read, *rules).select(key, F.explode("reference_list").alias("r")).select(key, "r.*")


def derived(read: DataFrame, *rules) -> DataFrame:
    """read with structure (sections and totals) and cross_references; without sections structure is null.

    unchanged compares the text's checksum with that from before.
    """
    out = with_scope(read.withColumn("__before", T.checksum(F.col("content"))), *rules)
    n = lambda c: F.aggregate("section_list", F.lit(0), lambda a, s: a + F.size(s[c])).cast("long")
    tree = F.struct(F.col("section_list").alias("sections"), F.size("section_list").cast("long").alias("total_sections"), n("subsections").alias("total_subsections"), n("clauses").alias("total_clauses"))
    same = T.checksum(F.col("content")) == F.col("__before")
    return out.withColumns({"structure": F.when(F.size("section_list") > 0, tree), "cross_references": F.col("reference_list"), "unchanged": same}).drop("__before", "section_list", "reference_list")


def snapshot(pages: DataFrame, pack: Pack = LEGAL, title: tuple[str, ...] = ("h1", "title"), structural: str = r"(?i)class\s*=\s*[\"'][^\"']*(?:lineremoves|bg-act-section)", html_column: str = "html") -> DataFrame:
    """pages with what readiness is decided on: has_title, has_enactment, has_section, has_structure, has_signal and content_length of the body's text."""
    page = F.col(html_column)
    body = html.plain(F.regexp_replace(F.coalesce(page, F.lit("")), r"(?is)^.*?<body[^>]*>|</body>.*$", ""))
    any_title = F.lit(False)
    for tag in title:
        any_title = any_title | F.coalesce(html.tag_text(page, tag).isNotNull(), F.lit(False))
    out = pages.withColumn("__body", body)
    c = F.col("__body")
    return out.withColumns({"has_title": any_title, "has_enactment": markers.enactment(c, pack)["has"], "has_section": c.rlike(markers.literal(pack.section_markers)), "has_structure": F.coalesce(page.rlike(structural), F.lit(False)), "has_signal": F.coalesce(markers.legal_signal(c, pack)[0], F.lit(False)), "content_length": F.length(c).cast("long")}).drop("__body")


# ---- projections


def formatted_tables(tables: Column) -> Column:
    """section_index, data and has_merged_cells of each table; no list counts as none."""
    return F.coalesce(F.transform(tables, lambda t: F.struct(F.coalesce(t["section_index"], F.lit(0)).alias("section_index"), F.coalesce(t["data"], F.array().cast("array<array<string>>")).alias("data"), F.coalesce(t["has_merged_cells"], F.lit(False)).alias("has_merged_cells"))), F.array().cast(f"array<{TABLE}>"))


def formatted_amendments(docs: DataFrame, pack: Pack = LEGAL, key: str = "doc_id", text: str = "text", width: int = 20) -> DataFrame:
    """type, line_number and context of each amendment mark, as rows."""
    found = markers.marker_positions(docs, pack.amendment_markers, key, text, width)
    return found.select(key, F.col("marker").alias("type"), "line_number", "position", "context")


ship(__name__)
