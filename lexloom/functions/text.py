"""String primitives: white space, all matches with offsets, regions, counting, rounding, hashing, normal forms.

Offsets are code points from 0. Patterns are Java regular expressions that can't match the empty string.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from .shipping import ship

#: White space as scripts on web pages see it: ASCII, no-break, BOM, and the Unicode separators.
WS = "\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
MATCH = "array<struct<position:int,text:string>>"
BLOCK = 64
REGION = "array<struct<start:int,end:int,type:string>>"


def trim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def word_bounded(pattern: str) -> str:
    """The pattern where no ASCII word character stands before or after it."""
    return f"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def find_all(c: Column, pattern: str) -> Column:
    """All matches from left to right, with their positions; null text has none.

    Positions are running sums of lengths. They are folded in blocks of BLOCK matches, and the blocks in a fold of
    their own, so that the growing lists that a fold copies at each step stay short.
    """
    both = F.struct(F.split(c, pattern, -1).alias("p"), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("m"))
    # a lambda works out anew what it names from outside; so the lists are bound to its argument
    pairs = lambda x: F.transform(x["m"], lambda m, i: F.struct(F.length(F.get(x["p"], i)).alias("p"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(MATCH).alias("out"))

    def step(a, z):
        at = a["at"] + z["p"]
        return F.struct((at + F.length(z["m"])).alias("at"), F.concat(a["out"], F.array(F.struct(at.alias("position"), z["m"].alias("text")))).alias("out"))

    def block(x):
        return F.transform(F.sequence(F.lit(1), F.size(x), F.lit(BLOCK)), lambda i: F.aggregate(F.slice(x, i, F.lit(BLOCK)), start, step))

    def join(a, r):
        moved = F.transform(r["out"], lambda m: F.struct((m["position"] + a["at"]).alias("position"), m["text"].alias("text")))
        return F.struct((a["at"] + r["at"]).alias("at"), F.concat(a["out"], F.array(moved)).alias("out"))

    none = F.array().cast(MATCH)
    all_ = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{MATCH}>").alias("out"))
    found = F.get(F.transform(F.transform(F.array(both), pairs), lambda x: F.aggregate(block(x), all_, join, lambda a: F.flatten(a["out"]))), 0)
    return F.when(c.rlike(pattern), found).otherwise(none)


def find_each(c: Column, patterns: dict[str, str]) -> Column:
    """Matches of several named patterns, in the order of the patterns: kind, position, text."""
    def named(kind: str):
        return lambda m: F.struct(F.lit(kind).alias("kind"), m["position"].alias("position"), m["text"].alias("text"))

    parts = [F.transform(find_all(c, p), named(k)) for k, p in patterns.items()]
    return F.concat(*parts) if parts else F.array().cast("array<struct<kind:string,position:int,text:string>>")


def count(c: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0)).cast("long")


def letters(c: Column, kind: str) -> Column:
    """How many characters of a class such as [a-z] there are, by what is left without the others."""
    return F.coalesce(F.length(F.regexp_replace(c, f"[^{kind[1:-1]}]+", "")), F.lit(0)).cast("long")


def total(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [count(c, p) for p in patterns])


def any_of(c: Column, patterns: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns]), F.lit(False))


def around(c: Column, position: Column, size: Column, width: int) -> tuple[Column, Column]:
    """The text of `width` characters before and after a match, trimmed."""
    from_ = F.greatest(position - width, F.lit(0))
    return trim(F.substring(c, from_ + 1, position - from_)), trim(F.substring(c, position + size + 1, F.lit(width)))


def with_context(c: Column, found: Column, width: int) -> Column:
    """The matches (kind, position, text) with the text of `width` characters on both sides, cut before rows are made of them."""
    def one(m):
        start = F.greatest(m["position"] - width, F.lit(0))
        return F.struct(m["kind"].alias("kind"), m["position"].alias("position"), m["text"].alias("text"), F.substring(c, start + 1, m["position"] + F.length(m["text"]) + width - start).alias("context"))

    return F.transform(found, one)


def offset_of(text: Column, part: Column, start: Column | int = 0) -> Column:
    """Where the trimmed part is first found from `start` on, or -1."""
    p = trim(part)
    return F.when((F.length(p) == 0) | part.isNull() | text.isNull(), -1).otherwise(F.call_function("locate", p, text, (F.lit(start) if isinstance(start, int) else start) + 1) - 1)


def first_of(*values: Column) -> Column:
    """The first value that is more than white space."""
    return F.coalesce(*[F.when(F.length(trim(v)) > 0, v) for v in values])


def round2(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def content_hash(c: Column) -> Column:
    """SHA-256 in hex; null for null and empty text."""
    return F.when(F.length(c) > 0, F.sha2(c, 256))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition, for which Spark has no function."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


# ---- regions


def regions(c: Column, packs: dict[str, list[str]], before: int = 0, after: int = 0) -> Column:
    """All matches of the patterns of each type as [start, end) regions, widened and kept inside the text, unmerged."""
    def widened(kind: str):
        return lambda m: F.struct(F.greatest(m["position"] - before, F.lit(0)).alias("start"), F.least(m["position"] + F.length(m["text"]) + after, F.length(c)).alias("end"), F.lit(kind).alias("type"))

    return F.concat(*[F.transform(find_all(c, p), widened(kind)) for kind, patterns in packs.items() for p in patterns])


def merge_regions(r: Column) -> Column:
    """Overlapping and adjacent regions (start <= end + 1) as one; its type lists the types in order of start."""
    ordered = F.array_sort(r, lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(0))

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.when(F.contains(last["type"], x["type"]), last["type"]).otherwise(F.concat(last["type"], F.lit(","), x["type"])).alias("type"))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"] + 1), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    def safe(acc, x):
        return F.when(F.size(acc) == 0, F.array(x)).otherwise(step(acc, x))

    return F.aggregate(ordered, F.array().cast(REGION), safe)


def covers(r: Column, position: Column) -> Column:
    return F.exists(r, lambda x: (x["start"] <= position) & (position < x["end"]))


def overlaps(r: Column, start: Column, end: Column) -> Column:
    return F.exists(r, lambda x: ~((x["end"] <= start) | (end <= x["start"])))


def in_any(m: Column, *regions: Column) -> Column:
    """Whether a match overlaps one of the regions."""
    return reduce(lambda a, r: a | overlaps(r, m["position"], m["position"] + F.length(m["text"])), regions, F.lit(False))


def replace_outside(c: Column, pattern: str, change, *regions: Column) -> Column:
    """The text with each match changed that overlaps none of the regions."""
    names = [f"r{i}" for i in range(len(regions))]
    bound = F.struct(F.split(c, pattern, -1).alias("p"), find_all(c, pattern).alias("f"), *[r.alias(n) for n, r in zip(names, regions)])

    def swapped(x):
        new = F.transform(x["f"], lambda m: F.when(in_any(m, *[x[n] for n in names]), m["text"]).otherwise(change(m["text"])))
        return F.array_join(F.flatten(F.transform(F.arrays_zip(x["p"].alias("p"), new.alias("m")), lambda z: F.array(z["p"], F.coalesce(z["m"], F.lit(""))))), "")

    return F.when(c.rlike(pattern), F.get(F.transform(F.array(bound), swapped), 0)).otherwise(c)


def checksum(c: Column) -> Column:
    """Length and sum of the UTF-16 units, as length_sum: a cheap guard against changes; 0_0 for null and empty text."""
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit("0_0")).otherwise(_checksum(c))


@F.pandas_udf(StringType())
def _checksum(s: pd.Series) -> pd.Series:
    def one(x):
        units = np.frombuffer((x or "").encode("utf-16-le", "surrogatepass"), "<u2")
        return f"{len(units)}_{int(units.sum(dtype=np.int64))}"

    return s.map(one)


ship(__name__)
