"""Which filter removes what, in every order of the filters: removals by part, order and step, and their good and toxic share.

What a filter removes in an order depends only on the set of filters that a document fails, so a table of 2^n sets by
n! orders names the step of the first failure. A pass over the documents' sets indexes that table and counts, by
np.bincount, part, order and step, once for all documents and once for each label; the partial counts are summed.
What an order makes redundant, what a filter alone removes and its Shapley sum all follow from those counts.

Texts are read once, for the filters that need no other row and a hash; all later steps see rows of some 50 bytes. A
text is a copy if a smaller id has it: the least id of each hash is an aggregate with partial sums, and a document
asks by id and hash whether it is that one, so that no group of copies meets in a task.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD_GAP, ship, stage

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
#: Parts that one task counts at a time; 2,160 numbers each.
PARTS = 2000


def orders(filters: str = FILTERS) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


def first_failure(filters: str = FILTERS) -> np.ndarray:
    """For each set of failed filters (a bit each) and each order the step that removes the document; the number of filters if none does."""
    table = np.full((1 << len(filters), len(orders(filters))), len(filters), "i8")
    for step in reversed(range(len(filters))):
        bit = np.array([1 << filters.index(o[step]) for o in orders(filters)])
        table[(np.arange(len(table))[:, None] & bit) > 0] = step
    return table


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (bits A to E), good and toxic of each document.

    A null text is empty and a null source the empty part. A document without id is no copy and has no labels; rows
    that share an id aren't each other's copies, as no id is smaller. A document is good or toxic if any label row of
    its id says so. Texts are equal if their sha256 is. Columns other than doc_id, text, source and those of labels
    aren't read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split("t", WORD_GAP + "+"), lambda w: w != "")
    capitals = F.length("t") - F.length(F.regexp_replace("t", "[A-Z]+", ""))
    checks = (F.size("w") < 200, 100 * F.size(F.array_distinct("w")) < 50 * F.size("w"), 100 * capitals > 2 * F.length("t"), F.col("t").rlike("[#$%&*|]"))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(checks[1:], 1)), F.when(checks[0], 1).otherwise(0))
    read = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("t")).withColumn("w", words)
    facts = stage(read.select("id", "part", bits.alias("failed"), F.unhex(F.sha2("t", 256)).alias("hash")), "failures")
    first = stage(facts.where("id is not null").groupBy("hash").agg(F.min("id").alias("id")).withColumn("first", F.lit(True)), "first")
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias({"quality": "good"}.get(c, c))
    judged = labels.select(F.col("doc_id").alias("id"), "quality", "toxic").where("id is not null").groupBy("id").agg(says("quality"), says("toxic"))
    judged = stage(judged, "labels")  # written, like first: joins with plain tables can be split where an id has many rows
    no = F.lit(False)
    copy = F.when(F.coalesce(F.col("first"), no), 0).otherwise(1 << FILTERS.index("E"))
    known = facts.where("id is not null").join(first, ["id", "hash"], "left").join(judged, "id", "left")
    known = known.select("part", (F.col("failed") + copy).alias("failed"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return known.unionByName(facts.where("id is null").select("part", "failed", no.alias("good"), no.alias("toxic")))


def _counter(table: np.ndarray, parts: int):
    n_orders, bins = table.shape[1], int(table.max()) + 1
    offsets = table + np.arange(n_orders) * bins  # the place of (order, step) in an array of a part
    size = n_orders * bins

    def flush(counts: dict):
        names = list(counts)
        rows = np.stack(list(counts.values())).reshape(len(names), 3, n_orders, bins).transpose(0, 2, 1, 3).reshape(-1, 3 * bins)
        columns = [pa.array([p for p in names for _ in range(n_orders)], pa.string()), pa.array(np.tile(np.arange(n_orders), len(names)), pa.int32())]
        columns += [pa.array(np.ascontiguousarray(x), pa.int64()) for x in rows.T]
        return pa.RecordBatch.from_arrays(columns, names=["part", "o", *_names(bins)])

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            coded = b.column("part").dictionary_encode()
            names, part = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            at = b.column("failed").to_numpy()
            flags = [np.ones(len(at), bool), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic"))]
            for start in range(0, len(names), parts):
                here = (part >= start) & (part < start + parts)
                n = min(parts, len(names) - start)
                found = [np.bincount(((part[m] - start)[:, None] * size + offsets[at[m]]).ravel(), minlength=n * size).reshape(n, size) for m in (here & f for f in flags)]
                for name, one in zip(names[start : start + n], np.stack(found, 1)):
                    counts[name] = counts[name] + one if name in counts else one
                if len(counts) >= parts:
                    yield flush(counts)
                    counts = {}
        if counts:
            yield flush(counts)

    return run


def _names(bins: int) -> list[str]:
    """Columns of a partial count: of all, good and toxic documents, by step; the last step is that of the kept ones."""
    return [f"{kind}{s}" for kind in ("all", "good", "toxic") for s in range(bins)]


def interactions(failed: DataFrame, filters: str = FILTERS, parts: int = PARTS) -> DataFrame:
    """A row for each part, order and step, from the rows of failures(); a table without rows has none.

    kept, removed, redundant (failing the step's filter, removed earlier), unique_fails (failing it only), good_lost and
    toxic_lost (removed in the step), shapley (removed by the filter, summed over all orders, in whichever step).
    """
    n = len(filters)
    names = _names(n + 1)
    schema = "part string, o int, " + ", ".join(f"{c} long" for c in names)
    counts = failed.select("part", F.col("failed").cast("int").alias("failed"), "good", "toxic").mapInArrow(_counter(first_failure(filters), parts), schema)
    sums = counts.groupBy("part", "o").agg(*[F.sum(c).alias(c) for c in names])
    named = F.array(*map(F.lit, orders(filters)))
    # a row for each step; beside it, kept is what later steps and none removed
    step = F.explode(F.array(*[F.struct(
        F.lit(s + 1).alias("step"), sum((F.col(f"all{k}") for k in range(s + 2, n + 1)), F.col(f"all{s + 1}")).alias("kept"),
        F.col(f"all{s}").alias("removed"), F.col(f"good{s}").alias("good_lost"), F.col(f"toxic{s}").alias("toxic_lost"),
    ) for s in range(n)])).alias("s")
    rows = sums.select("part", F.element_at(named, F.col("o") + 1).alias("filter_order"), step).select("part", "filter_order", "s.*")
    rows = rows.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    # in an order that a filter begins it removes all that fail it, in one that it ends only what fails nothing else
    same = Window.partitionBy("part", "filter")  # as many rows as there are orders
    at = lambda s: F.max(F.when(F.col("step") == s, F.col("removed"))).over(same)
    out = rows.withColumns({"shapley": F.sum("removed").over(same), "failing": at(1), "unique_fails": at(n)})
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


ship(__name__)
