"""Corpus manifest, coverage, history, logs, checkpoints and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampType


def stats(acts: DataFrame, volume: str = "volume_number", size: str = "content_length", at: str | None = None) -> DataFrame:
    known = F.when(F.col(volume) != "unknown", F.col(volume))
    more = [F.min(at).alias("first_capture"), F.max(at).alias("last_capture")] if at else []
    return acts.agg(F.count("*").alias("total_acts"), F.countDistinct(known).alias("total_volumes"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_characters"), *more)


def volumes(acts: DataFrame, key: str, volume: str = "volume_number") -> DataFrame:
    """A row for each volume and distinct act taken from it, with the number of such acts; no volume is gathered in one row."""
    rows = acts.select(volume, key).distinct()
    counts = rows.groupBy(F.col(volume).alias("__v")).agg(F.count(key).alias("n_acts"))
    return rows.join(counts, rows[volume].eqNullSafe(counts["__v"])).select(volume, key, "n_acts")


def coverage(refs: DataFrame, acts: DataFrame, key: str) -> DataFrame:
    """Of the distinct references, how many are in the corpus, and the rounded percentage; 100 without any."""
    r = refs.select(key).where(F.col(key).isNotNull()).distinct()
    j = r.join(acts.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left")
    n, inside = F.count("*"), F.count("__k")
    return j.agg(n.alias("referenced"), inside.alias("in_corpus"), (n - inside).alias("missing"), F.when(n == 0, 100).otherwise(F.floor(100 * inside / n + 0.5)).cast("long").alias("coverage_percent"))


def history(captures: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """captures with version from 1, archived_at (when the next took its place) and is_current."""
    w = Window.partitionBy(key).orderBy(at, tie)
    return captures.withColumns({"version": F.row_number().over(w), "archived_at": F.lead(at).over(w)}).withColumn("is_current", F.col("archived_at").isNull())


def integrity_counts(acts: DataFrame) -> DataFrame:
    return acts.groupBy("integrity").agg(F.count("*").alias("n"))


def usage(used: Column, quota: Column) -> dict[str, Column]:
    """Percentage and what it means: warning from 80, critical from 95."""
    p = F.when(quota > 0, 100.0 * used / quota).otherwise(F.lit(0.0))
    return {"percent": p, "level": F.when(p >= 95, "critical").when(p >= 80, "warning").otherwise("healthy"), "may_write": p < 95}


def running_usage(rows: DataFrame, group: str | None, order: list[str], size: str, quota: int, blocks: int = 256) -> DataFrame:
    """rows with the running total of size within a group, and its usage; the point where writing would stop.

    Where the first column of the order is a number or time, its quantiles cut each group into `blocks` blocks: sums of
    blocks, sums of the blocks before, then running totals within a block, so that no group is one task.
    """
    by = [F.col(group)] if group else [F.lit(0)]
    kind = rows.schema[order[0]].dataType
    cuts = None
    if isinstance(kind, (NumericType, TimestampType, DateType)):
        number = F.col(order[0]).cast("timestamp").cast("double") if isinstance(kind, (TimestampType, DateType)) else F.col(order[0]).cast("double")
        cuts = rows.agg(F.percentile_approx(number, [i / blocks for i in range(1, blocks)], 10 * blocks)).first()[0]
    if not cuts:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = rows.withColumn("used", F.sum(size).over(w))
    else:
        cut = F.array(*[F.lit(float(x)) for x in sorted(set(cuts))])
        out = rows.withColumns({"__g": by[0], "__b": F.size(F.filter(cut, lambda x: x < F.coalesce(number, F.lit(float("-inf")))))})
        sums = out.groupBy(F.col("__g").alias("__h"), F.col("__b").alias("__c")).agg(F.sum(size).alias("__s"))
        before = F.sum("__s").over(Window.partitionBy("__h").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.select("__h", "__c", F.coalesce(before, F.lit(0)).alias("__before"))
        own = F.sum(size).over(Window.partitionBy("__g", "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        out = out.join(sums, F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__b") == F.col("__c"))).withColumn("used", F.col("__before") + own).drop("__g", "__b", "__h", "__c", "__before")
    return out.withColumns(usage(F.col("used"), F.lit(quota)))


def checkpoints(events: DataFrame, group: str, order: list[str], is_export: Column, is_extraction: Column, threshold: int = 50) -> DataFrame:
    """Extractions with their number since the last export of the group, and whether a prompt is due; threshold between 10 and 200."""
    limit = min(max(threshold, 10), 200)
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("epoch", F.sum(F.when(is_export, 1).otherwise(0)).over(w)).where(is_extraction)
    each = Window.partitionBy(group, "epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("since_export", F.count("*").over(each))
    return rows.withColumn("prompt", F.col("since_export") >= limit)


def export_progress(wanted: DataFrame, log: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Of the distinct wanted keys: exported, failed, pending, and the rounded percentage done."""
    last = log.groupBy(key).agg(F.max(F.when(F.col(status) == "exported", 2).when(F.col(status) == "failed", 1).otherwise(0)).alias("s"))
    j = wanted.select(key).distinct().join(last, key, "left")
    n, done, bad = F.count("*"), F.count(F.when(F.col("s") == 2, 1)), F.count(F.when(F.col("s") == 1, 1))
    return j.agg(n.alias("total"), done.alias("exported"), bad.alias("failed"), (n - done - bad).alias("pending"), F.when(n == 0, 0).otherwise(F.floor(100 * (done + bad) / n + 0.5)).cast("long").alias("percent"))


def audit(log: DataFrame, operation=None, act=None, start=None, end=None, limit: int | None = None, at: str = "timestamp", tie: str = "log_id", act_column: str = "act_id") -> DataFrame:
    """Entries that fit all that is named, by time, the first `limit` of them."""
    out = log
    for value, test in ((operation, lambda v: F.col("operation") == v), (act, lambda v: F.col(act_column) == v), (start, lambda v: F.col(at) >= F.lit(v).cast("timestamp")), (end, lambda v: F.col(at) <= F.lit(v).cast("timestamp"))):
        out = out if value is None else out.where(test(value))
    out = out.orderBy(at, tie)
    return out if limit is None else out.limit(limit)


def tail(log: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n entries in order; a top-n by the reversed order, so nothing is sorted in full."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def receipts_of(receipts: DataFrame, act) -> DataFrame:
    return receipts.where(F.col("act_id") == act)


def quality_report(assessed: DataFrame, by: list[str]) -> DataFrame:
    return assessed.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(F.col("safe_for_ml"), 1)).alias("n_safe"), F.count(F.when(F.size("flags") > 0, 1)).alias("n_flagged"))
