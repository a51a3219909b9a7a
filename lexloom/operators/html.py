"""Pages to rows: links and catalogs by native expressions; texts, sections and tables by an element tree in pandas UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dom
from ..functions import text as T
from ..functions.packs import LEGAL_PAGES
from . import urls
from ..functions.shipping import ship

ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
ANCHOR = r"(?is)<a\s[^>]*href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


def plain(fragment: Column) -> Column:
    """Text of a simple fragment: tags out, the common entities decoded."""
    out = F.regexp_replace(fragment, r"(?s)<[^>]*>", "")
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, link_at from 0, href and title of every anchor, duplicates included."""
    rows = pages.where(F.col(html).rlike("(?i)<a\\s")).select(key, F.posexplode(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0))).alias("link_at", "a"))
    return rows.select(key, "link_at", F.regexp_extract("a", ANCHOR, 1).alias("href"), T.trim(plain(F.regexp_extract("a", ANCHOR, 2))).alias("title"))


def volume_links(found: DataFrame, site: urls.Site, whole: bool = False) -> DataFrame:
    """The links to acts: id, title, year (see year_of()), absolute url of the details page."""
    rows = found.withColumn("act_number", urls.number(F.col("href"), r"act-(?:details-)?(\d+)\.html")).where("act_number is not null")
    url = F.regexp_replace(urls.absolute(F.col("href"), site.base), r"act-(\d+)\.html", "act-details-$1.html")
    return rows.withColumns({"url": url, "year": year_of(F.col("title"), whole)})


def year_of(title: Column, whole: bool = False) -> Column:
    """The first year of the 20th or 21st century in Latin digits, else in Bengali ones, else empty.

    whole: digits within a longer number are no year; else they are, as on the statute site.
    """
    before, after = ("(?<![0-9০-৯])", "(?![0-9০-৯])") if whole else ("", "")
    latin, bengali = (F.regexp_extract(title, f"{before}{p}{after}", 1) for p in ("(20[0-9]{2}|19[0-9]{2})", "(২০[০-৯]{2}|১৯[০-৯]{2})"))
    return F.when(latin != "", latin).otherwise(F.coalesce(bengali, F.lit("")))


def catalog(rows: DataFrame, key: str, title: str = "title", order: str = "link_at") -> DataFrame:
    """One row for each key, that with the longest title, the first of these; titles that are only a number or shorter than 5 go.

    by_number() puts the rows in order.
    """
    good = rows.where((F.length(title) >= 5) & ~F.col(title).rlike("^[0-9০-৯]+$"))
    w = Window.partitionBy(key).orderBy(F.length(title).desc(), order)
    return good.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def by_number(rows: DataFrame, key: str = "act_number") -> DataFrame:
    """Rows by the number that the key begins with, those without one last."""
    return rows.orderBy(F.expr(f"try_cast(regexp_extract({key}, '^[0-9]+', 0) as bigint)").asc_nulls_last(), key)


def chronological(rows: DataFrame, year: str = "year", key: str = "act_number") -> DataFrame:
    """Years falling, those that are no number last as 0; then ids rising."""
    return rows.orderBy(F.coalesce(F.expr(f"try_cast({year} as int)"), F.lit(0)).desc(), F.expr(f"try_cast({key} as bigint)"))


def alphabetical(rows: DataFrame, title: str = "title") -> DataFrame:
    return rows.orderBy(F.collate(title, "bn"))


def placed(rows: DataFrame, volume: str, year: str = "year", key: str = "act_number", title: str = "title", source: str | None = None) -> DataFrame:
    """rows with by_year and by_title: their places, from 1, in the lists of their volume as chronological() and alphabetical() order them.

    source: a name for what the list was taken from, as a column of its own. A volume's list is one sort group.
    """
    by_year = Window.partitionBy(volume).orderBy(F.coalesce(F.expr(f"try_cast({year} as int)"), F.lit(0)).desc(), F.expr(f"try_cast({key} as bigint)"))
    by_title = Window.partitionBy(volume).orderBy(F.collate(title, "bn"), key)
    out = rows.withColumns({"by_year": F.row_number().over(by_year), "by_title": F.row_number().over(by_title)})
    return out if source is None else out.withColumn("source", F.lit(source))


def noise_free(c: Column, noise=LEGAL_PAGES.noise) -> Column:
    """Without what the patterns match, in their order, then trimmed."""
    for p in noise:
        c = F.regexp_replace(c, p, "")
    return T.trim(c)


def tag_text(html: Column, tag: str) -> Column:
    """Text of the first element of a tag that doesn't nest, such as title or h1; null without one."""
    return F.nullif(T.trim(plain(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1))), F.lit(""))


def body_text(html: Column, excluded=("script", "style", "nav", "header", "footer", "aside", "form", "noscript")) -> Column:
    """Text of a page without comments and the elements of the excluded tags, white space folded; native variant of extract()."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in excluded:
        out = F.regexp_replace(out, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>", "")
    out = F.regexp_replace(out, r"(?is)<title[^>]*>.*?</title>", "")
    return T.trim(F.regexp_replace(plain(F.regexp_replace(out, r"(?i)</(?:p|div|h[1-6]|li|tr)>|<br\s*/?>", " ")), f"[{T.WS}]+", " "))


def extract(pages: DataFrame, selectors: list[str], fallback: list[str], excluded: list[str], html: str = "html", signal=None, closed_references: bool = False) -> DataFrame:
    """pages with content, method, selector, attempts, extraction_success.

    The selectors are tried in order, then the fallback, then the body without what is excluded; the first with text
    wins, its matches joined by blank lines. The body counts only with a signal in its text (signal: a column test).
    closed_references: see dom.parse().
    """
    schema = "content string, method string, selector string, attempts array<struct<selector_order:int,selector:string,matched:boolean,element_count:int>>"

    @F.pandas_udf(schema)
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for page in s:
            root, tries, hit = dom.parse(page, closed_references), [], None
            for method, group in (("primary", selectors), ("fallback", fallback)):
                for sel in group:
                    nodes = dom.select(root, sel)
                    texts = [t for n in nodes if (t := n.text().strip())]
                    tries.append({"selector_order": len(tries) + 1, "selector": sel, "matched": bool(texts), "element_count": len(nodes)})
                    if texts:
                        hit = ("\n\n".join(texts), method, sel)
                        break
                if hit:
                    break
            if not hit:
                body = dom.first(root, "body") or root
                hit = (dom.without(body, excluded).text().strip(), "body", "body")
                tries.append({"selector_order": len(tries) + 1, "selector": "body", "matched": bool(hit[0]), "element_count": 1})
            out.append((*hit, tries))
        return pd.DataFrame(out, columns=["content", "method", "selector", "attempts"])

    rows = pages.withColumn("__x", run(html)).select(*pages.columns, "__x.*")
    said = F.lit(True) if signal is None else signal(F.col("content"))
    return rows.withColumn("extraction_success", (F.length("content") > 0) & ((F.col("method") != "body") | said))


def section_rows(pages: DataFrame, row: str, head: str, body: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, section_at, title, body and has_table of each section element."""

    @F.pandas_udf("array<struct<title:string,body:string,has_table:boolean>>")
    def run(s: pd.Series) -> pd.Series:
        def one(page):
            text = lambda n, sel: "\n".join(x.text().strip() for x in dom.select(n, sel))
            return [{"title": text(n, head), "body": text(n, body), "has_table": bool(dom.select(n, "table"))} for n in dom.select(dom.parse(page), row)]

        return s.map(one)

    return pages.select(key, F.posexplode(run(html)).alias("section_at", "s")).select(key, "section_at", "s.*")


def tables(pages: DataFrame, key: str = "page_id", html: str = "html", selector: str = "table") -> DataFrame:
    """key, table_at, data (a grid of texts), has_merged_cells, row_count, col_count of each table."""

    @F.pandas_udf("array<struct<data:array<array<string>>,has_merged_cells:boolean,row_count:int,col_count:int>>")
    def run(s: pd.Series) -> pd.Series:
        def one(page):
            out = []
            for t in dom.select(dom.parse(page), selector):
                data, merged = dom.matrix(t)
                out.append({"data": data, "has_merged_cells": merged, "row_count": len(data), "col_count": len(data[0]) if data else 0})
            return out

        return s.map(one)

    return pages.where(F.col(html).rlike("(?i)<table")).select(key, F.posexplode(run(html)).alias("table_at", "t")).select(key, "table_at", "t.*")


def table_links(pages: DataFrame, selector: str = "table.table-search tbody tr", key: str = "page_id", html: str = "html") -> DataFrame:
    """Rows of a data table with three cells and a link: row_index, id (may be null), title, url, act_number as written."""

    @F.pandas_udf("array<struct<row_index:int,id:string,title:string,url:string,act_number:string>>")
    def run(s: pd.Series) -> pd.Series:
        import re

        def one(page):
            out = []
            for i, tr in enumerate(dom.select(dom.parse(page), selector)):
                cells, a = dom.select(tr, "td"), dom.select(tr, "a[href]")
                if len(cells) >= 3 and a and a[0].attrs.get("href"):
                    m = re.search(r"act-(?:details-)?(\d+)", a[0].attrs["href"])
                    out.append({"row_index": i, "id": m and m[1], "title": a[0].text().strip(), "url": a[0].attrs["href"], "act_number": cells[2].text().strip()})
            return out

        return s.map(one)

    return pages.select(key, F.explode(run(html)).alias("r")).select(key, "r.*")


def schedules(pages: DataFrame, selectors: list[str], key: str = "page_id", html: str = "html") -> DataFrame:
    """The distinct markup of schedule elements, in order."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        def one(page):
            root = dom.parse(page)
            return list(dict.fromkeys(n.html() for sel in selectors for n in dom.select(root, sel)))

        return s.map(one)

    return pages.select(key, run(html).alias("schedules"))


ship(__name__)
