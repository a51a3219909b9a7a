"""Joins of points and intervals that stand in tables of their own, without pairs that can't meet.

An interval of length n goes to a level whose cells are at least n wide, so it lies in one or two cells of that level,
however long it is. A point, or the other interval, is looked up in the cells of each level that there is, 32 at most.
Rows meet by key, level and cell in an equi-join, and the exact condition follows; a key with many rows is spread over
its cells. Intervals are half open; those that are empty or have a null meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells aren't narrower than 2 to this power.
LEAST = 6


def _level(start: Column, end: Column) -> Column:
    return F.greatest(F.ceil(F.log2((end - start).cast("double"))), F.lit(LEAST)).cast("int")


def _cell(at: Column, level: Column) -> Column:
    """floor(at / 2^level), also below zero."""
    return F.call_function("shiftright", at.cast("long"), level)


def _placed(regions: DataFrame, start: str, end: str) -> DataFrame:
    """regions with their level; empty ones and those with a null are gone."""
    return regions.where(F.col(start) < F.col(end)).withColumn("__level", _level(F.col(start), F.col(end)))


def levels(regions: DataFrame, start: str = "start", end: str = "end") -> list[int]:
    """The levels that the regions need: a few numbers, by one aggregate."""
    return sorted(r[0] for r in _placed(regions, start, end).select("__level").distinct().collect())


def _cells(df: DataFrame, start: Column, end: Column, wanted: list[int], own: str | None = None) -> DataFrame:
    """A row, with __level and __cell, for each cell that [start, end) touches of the wanted levels; own: a column with the least of them."""
    none = F.array().cast("array<struct<__level:int,__cell:bigint>>")

    def of_level(k: int) -> Column:
        return F.transform(F.sequence(_cell(start, F.lit(k)), _cell(end - 1, F.lit(k))), lambda c: F.struct(F.lit(k).alias("__level"), c.alias("__cell")))

    each = [of_level(k) for k in wanted]
    each = each if own is None else [F.when(F.col(own) <= k, x).otherwise(none) for k, x in zip(wanted, each)]
    return df.withColumn("__x", F.explode(F.concat(none, *each))).select(*df.columns, "__x.*")


def covering(points: DataFrame, regions: DataFrame, key: str, at: str = "position", start: str = "start", end: str = "end") -> DataFrame:
    """Each point with each region of its key that covers it (start <= at < end): the columns of points, then those of regions but the key.

    Repeated points and regions are paired each. But for the key, columns must have names of their own. The only pass
    over the regions before the join is one for their levels.
    """
    p = _cells(points.where(F.col(key).isNotNull() & F.col(at).isNotNull()), F.col(at), F.col(at) + 1, levels(regions, start, end))
    r = _own_cells(_placed(regions, start, end), start, end).withColumnsRenamed({key: "__k", "__level": "__rl", "__cell": "__rc"})
    pairs = p.join(r, (F.col(key) == F.col("__k")) & (F.col("__level") == F.col("__rl")) & (F.col("__cell") == F.col("__rc")) & (F.col(start) <= F.col(at)) & (F.col(at) < F.col(end)))
    return pairs.select(*points.columns, *[c for c in regions.columns if c != key])


def _own_cells(placed: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each of the one or two cells of its own level that a region lies in."""
    cells = F.sequence(_cell(F.col(start), F.col("__level")), _cell(F.col(end) - 1, F.col("__level")))
    return placed.withColumn("__cell", F.explode(cells))


def inside(points: DataFrame, regions: DataFrame, key: str, at: str = "position", start: str = "start", end: str = "end") -> DataFrame:
    """The distinct points (key, at) with `inside`: whether a region of the key covers them. Null offsets are in none."""
    distinct = points.select(key, at).distinct()
    hit = covering(distinct, regions.select(key, F.col(start).alias("__s"), F.col(end).alias("__e")), key, at, "__s", "__e").select(F.col(key).alias("__h"), F.col(at).alias("__at"), F.lit(True).alias("__in")).distinct()
    out = distinct.join(hit, (F.col(key) == F.col("__h")) & (F.col(at) == F.col("__at")), "left")
    return out.select(key, at, F.coalesce("__in", F.lit(False)).alias("inside"))


def overlapping(left: DataFrame, right: DataFrame, key: str, start: str = "start", end: str = "end", prefix: str = "other_") -> DataFrame:
    """Pairs of intervals of one key that share an offset: the columns of left, then start and end of right with a prefix.

    The shorter of two meets the longer in the longer's cells: each side is looked up in the levels of the other that
    are higher than its own, or the same. A pair that shares two cells counts in the first of them.
    """
    right = right.select(key, F.col(start).alias(f"{prefix}{start}"), F.col(end).alias(f"{prefix}{end}"))
    a, b = (start, end), (f"{prefix}{start}", f"{prefix}{end}")
    l, r = _placed(left, *a), _placed(right, *b)
    above = lambda placed, side, wanted, more: _cells(placed.select("*", (F.col("__level") + more).alias("__own")).drop("__level"), F.col(side[0]), F.col(side[1]), wanted, "__own")
    shorter_left = _meet(above(l, a, levels(right, *b), 0), _own_cells(r, *b), key, a, b)
    shorter_right = _meet(_own_cells(l, *a), above(r, b, levels(left, *a), 1), key, a, b)
    columns = [*left.columns, *b]
    return shorter_left.select(*columns).unionByName(shorter_right.select(*columns))


def _meet(l: DataFrame, r: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    r = r.withColumnRenamed(key, "__k").withColumnsRenamed({"__level": "__rl", "__cell": "__rc"}).drop("__own")
    first = F.greatest(_cell(F.col(a[0]), F.col("__level")), _cell(F.col(b[0]), F.col("__level"))) == F.col("__cell")
    return l.join(r, (F.col(key) == F.col("__k")) & (F.col("__level") == F.col("__rl")) & (F.col("__cell") == F.col("__rc")) & first & (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])))


def anchored(points: DataFrame, regions: DataFrame, marks: DataFrame, key: str, at: str = "position", start: str = "content_start", end: str = "content_end", mark_at: str = "marker_offset", mark: str = "marker") -> DataFrame:
    """covering() with the last mark of the region at or before the point, null without one.

    A mark belongs to the regions that cover it. Within a region, marks and points are put in one order, in which a
    point looks back; nothing is paired.
    """
    found = covering(points, regions, key, at, start, end)
    marked = covering(marks.select(key, mark_at, mark), regions.select(key, start, end), key, mark_at, start, end)
    rows = found.withColumns({"__at": F.col(at), "__point": F.lit(True)}).unionByName(marked.select(key, start, end, mark, F.col(mark_at).alias("__at")).withColumn("__point", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(key, start, end).orderBy("__at", "__point").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__m", F.last(mark, True).over(w)).where("__point").select(*found.columns, F.col("__m").alias(mark))
