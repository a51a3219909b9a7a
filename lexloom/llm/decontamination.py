"""Benchmark decontamination by Wu-Manber search for many word sequences at once.

The patterns are the windows of `width` words of every benchmark item. They are grouped by length; each group has a
shift table by blocks of two words, buckets by the last block of a pattern with the first block as a second key, and
the patterns themselves, which confirm an occurrence word by word. A document is read from its end-of-window
positions: a block that no pattern holds lets the search jump by almost a whole window.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship

#: A-Z become a-z, and what is neither a-z, 0-9 nor above U+007F becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

#: Words of patterns that one broadcast holds at most; larger benchmarks are searched for in several passes.
PATTERN_WORDS = 4_000_000


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Patterns:
    """Shift and bucket tables for the patterns of one length."""

    def __init__(self, size: int):
        self.size, self.block = size, min(2, size)
        self.shift: dict = {}
        self.buckets: dict = defaultdict(lambda: defaultdict(dict))
        self.default = size - self.block + 1

    def add(self, pattern: tuple[bytes, ...], item: str) -> None:
        for end in range(self.block, self.size + 1):
            block = pattern[end - self.block : end]
            self.shift[block] = min(self.shift.get(block, self.default), self.size - end)
        same_ends = self.buckets[pattern[-self.block :]][pattern[: self.block]]
        same_ends.setdefault(pattern, set()).add(item)

    def frozen(self) -> "Patterns":
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}
        return self

    def search(self, text: list[bytes]):
        """(start, items) of each occurrence, from left to right."""
        size, block, default, shift = self.size, self.block, self.default, self.shift.get
        end, n = size, len(text)
        while end <= n:
            last = tuple(text[end - block : end])
            step = shift(last, default)
            if step:
                end += step
                continue
            start = end - size
            same_ends = self.buckets[last].get(tuple(text[start : start + block]))
            if same_ends and (items := same_ends.get(tuple(text[start:end]))):
                yield start, items
            end += 1


def compile_patterns(items: list[tuple[str, str]], width: int) -> dict[int, Patterns]:
    groups: dict[int, Patterns] = {}
    for item, text in items:
        ws = words(text)
        size = min(width, len(ws))
        for start in range(len(ws) - size + 1 if size else 0):
            groups.setdefault(size, Patterns(size)).add(tuple(ws[start : start + size]), item)
    return {size: p.frozen() for size, p in groups.items()}


def scan(text: str | None, groups: dict[int, Patterns]) -> tuple[int, list[int], set[str]]:
    """Number of words, the hit ranges as [start, end, start, end, ...] in order and apart, the items found."""
    ws = words(text)
    found, items = [], set()
    for p in groups.values():
        for start, ids in p.search(ws):
            found.append((start, start + p.size))
            items |= ids
    return len(ws), joined(found), items


def joined(ranges: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def find_overlaps(docs: DataFrame, benchmark: DataFrame, width: int = 13, keep: list[str] | None = None, pattern_words: int = PATTERN_WORDS) -> DataFrame:
    """Each document's columns `keep` (all), then n_words, n_hit, hits (word ranges), items (sorted as strings).

    The benchmark is a bounded table; its texts are collected slice by slice, each slice of at most `pattern_words`
    words of patterns, and each slice is broadcast. Documents are never shuffled; for several slices, maps follow one
    another, each adding its hits. Null and empty texts have no words and no hits, whole texts of any length are searched,
    and tables without rows give none. Benchmark rows without id or text are left out; ids may be of any type. Repeated documents are judged one by one. Columns of docs named as one of the results are replaced.
    """
    sc = docs.sparkSession.sparkContext
    names = ("n_words", "n_hit", "hits", "items")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    out = docs.select(*dict.fromkeys([*keep, "text"])).withColumns({"n_words": F.lit(0).cast("long"), "hits": F.array().cast("array<long>"), "items": F.array().cast("array<string>")})
    slices = _slices(benchmark, width, pattern_words)
    items, schema = next(slices), out.schema
    while items is not None:  # the driver holds two slices at most, one of them compiled
        after = next(slices, None)
        if after is None:
            schema = out.select(*keep, "n_words", "hits", "items").schema
        out = out.mapInArrow(_searcher(sc.broadcast(compile_patterns(items, width)), schema.names), schema)
        items = after
    ends_less_starts = F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    n_hit = F.aggregate(ends_less_starts, F.lit(0).cast("long"), lambda n, x: n + x)
    return out.select(*keep, "n_words", n_hit.alias("n_hit"), "hits", F.array_sort("items").alias("items"))


def _slices(benchmark: DataFrame, width: int, most: int):
    out, load = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").toLocalIterator():
        out.append((item, text))
        load += max(1, len(words(text))) * width
        if load >= most:
            yield out
            out, load = [], 0
    yield out


def _searcher(tables, names: list[str]):
    def run(batches):
        groups = tables.value
        for b in batches:
            at = {name: i for i, name in enumerate(b.schema.names)}
            n, hits, items = [], [], []
            for text, old, had in zip(b.column(at["text"]), b.column(at["hits"]).to_pylist(), b.column(at["items"]).to_pylist()):
                count, ranges, found = scan(text.as_py(), groups)
                if old:
                    ranges = joined([*zip(ranges[::2], ranges[1::2]), *zip(old[::2], old[1::2])])
                n.append(count)
                hits.append(ranges)
                items.append(sorted(found.union(had)))
            new = {"n_words": pa.array(n, pa.int64()), "hits": pa.array(hits, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new[name] if name in new else b.column(at[name]) for name in names], names=names)

    return run


def contaminated(share: int = 20):
    """Over 1/share of the words, or just that, and at least one."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def items_sha256():
    """Of the items' ids as sorted strings, joined by commas."""
    return F.sha2(F.concat_ws(",", "items"), 256)


ship(__name__)
