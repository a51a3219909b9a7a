"""Addresses: page types, hosts, parts, absolute forms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Site:
    """Hosts of a site (themselves and what is below), and page types by path pattern, in the order in which they are tried."""

    hosts: tuple[str, ...]
    types: tuple[tuple[str, str, int], ...]  # name, pattern of the path, layer
    base: str = ""
    act: str = r"act-(?:details-|print-)?(\d+)"
    volume: str = r"volume-(\d+)"
    document: str = r"(?i)/act-(?:details-|print-)?\d+"


# The pages of the statute site.
LEGAL_SITE = Site(
    hosts=("bdlaws.minlaw.gov.bd",),
    types=(
        ("chronological_index", r"/laws-of-bangladesh-chronological-index\.html$", 1),
        ("alphabetical_index", r"/laws-of-bangladesh-alphabetical-index\.html$", 1),
        ("range_index", r"/laws-of-bangladesh\.html$", 1),
        ("volume", r"/volume-\d+\.html$", 2),
        ("act_details", r"/act-details-\d+\.html$", 4),
        ("act_summary", r"/act-(?!details)\d+\.html$", 3),
    ),
    base="http://bdlaws.minlaw.gov.bd",
)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def allowed(url: Column, site: Site) -> Column:
    h, ok = host(url), F.lit(False)
    for name in site.hosts:
        ok = ok | (h == name) | h.endswith("." + name)
    return F.coalesce(ok, F.lit(False))


def page_type(url: Column, site: Site) -> Column:
    p, out = path(url), F.lit("unsupported")
    for name, pattern, _ in reversed(site.types):
        out = F.when(p.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(~allowed(url, site), "invalid_domain").otherwise(out)


def layer(kind: Column, site: Site) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for n, _, k in site.types for x in (n, k)]), kind)


def label(kind: Column) -> Column:
    return F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))


def is_catalog(kind: Column) -> Column:
    return kind.isin("volume", "chronological_index", "alphabetical_index", "range_index")


def number(url: Column, pattern: str, default: str | None = None) -> Column:
    found = F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
    return found if default is None else F.coalesce(found, F.lit(default))


def is_document(url: Column, site: Site) -> Column:
    return F.coalesce(allowed(F.lower(url), site) & url.rlike(site.document), F.lit(False))


def absolute(href: Column, base: str, protocol: str = "http:") -> Column:
    """Absolute addresses as they are; the rest joined to protocol or base."""
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.lit(protocol), href)).when(href.startswith("/"), F.concat(F.lit(base), href)).otherwise(F.concat(F.lit(base + "/"), href))
