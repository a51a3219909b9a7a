"""Jaccard self-join of word n-gram sets by set relations: position-blocked index lists and incremental answers.

Two sets link when 100 * |intersection| >= percent * |union|. A set's members are ordered by their hashes, so that for
two linked sets each next member of the union is a common one with a chance of percent in 100 at least.

Index lists. There is a list for each of a set's least members. A list is cut into blocks by what stands at the next
positions, the `run` members from there on; a set is held against its own block of a list, and the other blocks, and
blocks of one set, are skipped. So a passage that many sets share fills few blocks. A set enters as many lists as it
takes for two linked sets to meet in a block but with a chance of 2^-64, that of two given members having one hash; a
set with few members enters the lists of all of them, in a ring, where they meet for certain: of the union of c common
and d other members the longest run of common ones has c / d members at least. Nothing depends on how many sets a list
or a block has.

Answers. The sets of a block are compared with one of them, the block's hub, which yields links and each set's
difference from the hub. Sets that now belong to one component need no comparison. Any other pair of a hub's sets is
answered from the answers of the hub: the overlap follows from both overlaps with the hub and the two differences,
without the sets themselves. The sets outside the hub's component are held against all sets of the hub in parts of
bounded size; a part reports the components that it joins, not its pairs. Nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship, stage

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Two odd multipliers for sequences of word hashes, and the steps of a 64-bit finalizer.
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S, _T, _M1, _M2 = np.uint64(33), np.uint64(29), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Sets, and bytes of differences, that a block has at most on average.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: The longest run that cuts a list into blocks, and the bits of the chance that linked sets meet in no block.
RUN, BITS = 3, 64
CACHE = 500_000
#: Ids of documents with a partner that are broadcast at most; more of them meet the texts in a shuffled join.
BROADCAST_IDS = 1_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _T)) * _M2
    return x ^ (x >> _S)


class _Hashes(dict):
    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h


def shingles(text: str | None, known: _Hashes, size: int = 3) -> np.ndarray:
    """The set of hashed n-grams of a text, sorted. Fewer words than `size` make one n-gram, no words none."""
    ws = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    n = min(size, len(h))
    if not n:
        return h
    out = h[: len(h) - n + 1] + np.uint64(n)
    for i in range(1, n):
        out = out * _ONE + h[i : len(h) - n + 1 + i]
    return np.unique(mixed(out))


def run_length(percent: int) -> int:
    """Members of a run: no more than linked sets are sure to have in common next to one another."""
    return max(1, min(RUN, percent // (100 - percent))) if percent < 100 else RUN


def lists_entered(percent: int, run: int, bits: int = BITS) -> int:
    """The least k such that k + run - 1 trials, each a success with the chance of percent in 100, hold no `run`
    successes in a row with a chance of at most 2^-bits."""
    p = percent / 100
    if p >= 1:
        return 1
    in_row, k = [0.0] * run, 1 - run  # chances by the successes that the trials end on
    in_row[0] = 1.0
    while sum(in_row) > 2.0**-bits or k < 1:
        in_row, k = [(1 - p) * sum(in_row)] + [p * x for x in in_row[:-1]], k + 1
    return k


def block_keys(members: np.ndarray, run: int, lists: int) -> np.ndarray:
    """A key for each list that a set enters and its block there."""
    n = len(members)
    if not n:
        return members
    starts = n if n < lists + run else lists  # all, in a ring, or the least
    key = np.zeros(starts, np.uint64)
    for i in range(run):
        key = key * _ONE + members[np.arange(i, i + starts) % n]
    return mixed(key + _TWO)


def _entered(size: int, percent: int, seed: int):
    def entered(batches):
        known, run = _Hashes(seed), run_length(percent)
        lists = lists_entered(percent, run)
        for b in batches:
            n, node, check, keys = [], [], [], []
            for text in b.column("text"):
                members = shingles(text.as_py(), known, size)
                n.append(len(members))
                raw = members.tobytes()
                node.append(xxhash.xxh64_intdigest(raw, seed) - (1 << 63) if len(members) else None)
                check.append(xxhash.xxh64_intdigest(raw, seed + 1) - (1 << 63) if len(members) else None)
                keys.append(block_keys(members, run, lists).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "node", "check", "keys"])

    return entered


def _members(size: int, seed: int):
    def run(batches):
        known = _Hashes(seed)
        for b in batches:
            sets = [shingles(t.as_py(), known, size) for t in b.column("text")]
            node = [xxhash.xxh64_intdigest(s.tobytes(), seed) - (1 << 63) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "members"])

    return run


def _compared(percent: int):
    """From two sets: the link and the differences, which later answers are derived from."""

    def run(batches):
        for b in batches:
            out = []
            for a, hub, x, h in zip(b.column("a").to_pylist(), b.column("hub").to_pylist(), b.column("members"), b.column("hub_members")):
                x, h = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, h))
                more, less = np.setdiff1d(x, h, assume_unique=True), np.setdiff1d(h, x, assume_unique=True)
                both = len(x) - len(more)
                out.append((a, hub, len(x), len(h), 100 * both >= percent * (len(x) + len(h) - both), more.tobytes(), less.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*out)] or [()] * 7, kinds)], names=["a", "hub", "n", "n_hub", "linked", "more", "less"])

    return run


def _derived(percent: int):
    """The components that a block joins: `probe` rows against the others, by their differences from one hub."""

    def overlaps(p: list[np.ndarray], q: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(p), len(q)), np.float32)
        p_all, q_all = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (p, q))
        shared = np.intersect1d(p_all, q_all)
        p_row, q_row = (np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (p, q))
        for at in range(0, len(shared), 2048):
            part = shared[at : at + 2048]
            table = []
            for members, row, n in ((p_all, p_row, len(p)), (q_all, q_row, len(q))):
                place = np.minimum(np.searchsorted(part, members), len(part) - 1)
                has = part[place] == members
                m = np.zeros((n, len(part)), np.float32)
                m[row[has], place[has]] = 1
                table.append(m)
            out += table[0] @ table[1].T
        return out

    def run(block):
        sides = block[block.probe], block[~block.probe]
        less, more = ([[np.frombuffer(v, np.uint64) for v in x[c]] for x in sides] for c in ("less", "more"))
        both = overlaps(*less) + overlaps(*more) + float(block.n_hub.iloc[0])
        both -= np.array([len(v) for v in less[0]], np.float32)[:, None] + np.array([len(v) for v in less[1]], np.float32)[None, :]
        n = sides[0].n.to_numpy(np.float64)[:, None] + sides[1].n.to_numpy(np.float64)[None, :]
        x, y = np.nonzero(100 * both >= percent * (n - both))
        joined = np.stack([sides[0].comp.to_numpy()[x], sides[1].comp.to_numpy()[y]], 1)
        joined = np.unique(joined[joined[:, 0] != joined[:, 1]], axis=0)
        parent: dict = {}

        def top(v):
            while parent.get(v, v) != v:
                v = parent[v]
            return v

        out = []
        for a, b in joined.tolist():
            a, b = top(a), top(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of every node that has an edge; comp is the least node reachable. Least labels with pointer jumping."""
    e = stage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    labels = stage(e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("comp")), "labels")
    while True:
        near = e.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        hooked = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", "comp", F.least("comp", "near").alias("new"))
        target = labels.select(F.col("node").alias("new"), F.col("comp").alias("jump"))
        moved = stage(hooked.join(target, "new").select("node", F.col("comp").alias("old"), F.least("new", "jump").alias("comp")), "labels")
        labels = moved.select("node", "comp")
        if moved.where("old <> comp").isEmpty():
            return labels


def groups(docs: DataFrame, percent: int = 90, size: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id that links reach, of each row of docs.

    Sets come from whole texts, words split at white space, A-Z in lower case. Null and wordless texts have an empty
    set and link with nothing. Rows with equal sets are one set. A row without doc_id gets a null component and links
    with nothing. Of rows that share a doc_id, each is judged by its own text. A table without rows gives none. Only
    doc_id and text are read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seed = 0
    while True:
        rows = stage(texts.mapInArrow(_entered(size, percent, seed), "doc_id long, n long, node long, check long, keys array<long>"), "sets")
        named = rows.where("doc_id is not null and node is not null")
        sets = stage(named.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("check").alias("lo"), F.max("check").alias("hi")), "distinct")
        if sets.where("lo <> hi").isEmpty():
            break
        seed += 2  # two sets had one hash
    entries = named.select("node", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").drop("last")
    shared = stage(shared, "shared")  # else the join takes over the sums' exchange, and a key of many sets can't be split
    lists = stage(entries.join(shared, "key").where("node <> hub").select("key", F.col("node").alias("a"), "hub").distinct(), "lists")
    pairs = lists.select("a", "hub").distinct()
    wanted = stage(lists.select(F.col("a").alias("node")).unionByName(lists.select(F.col("hub").alias("node"))).distinct(), "wanted")
    ids = stage(wanted.join(sets, "node").select(F.col("rep").alias("doc_id")), "ids")
    if ids.count() <= BROADCAST_IDS:  # then the texts stay where they are
        ids = F.broadcast(ids)
    members = texts.join(ids, "doc_id", "left_semi").mapInArrow(_members(size, seed), "node long, members binary").where("node is not null")
    members = stage(members.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "members")
    both = pairs.join(members.select(F.col("node").alias("a"), "members"), "a").join(members.select(F.col("node").alias("hub"), F.col("members").alias("hub_members")), "hub")
    known = stage(both.mapInArrow(_compared(percent), "a long, hub long, n long, n_hub long, linked boolean, more binary, less binary"), "compared")
    comps = connected_components(known.where("linked").select("a", F.col("hub").alias("b")))
    # the sets of each hub with their components; those outside the hub's own are the probes
    of = known.join(comps.withColumnRenamed("node", "a"), "a", "left").withColumn("comp", F.coalesce("comp", "a"))
    of = of.join(comps.select(F.col("node").alias("hub"), F.col("comp").alias("main")), "hub", "left").withColumn("outside", F.col("comp") != F.coalesce("main", "hub"))
    weight = F.length("more") + F.length("less")
    load = of.groupBy("hub").agg(*[F.ceil(F.greatest(F.sum(F.when(side, 1)) / BLOCK, F.sum(F.when(side, weight)) / BLOCK_BYTES)).cast("int").alias(name) for name, side in (("probes", F.col("outside")), ("others", F.lit(True)))])
    load = stage(load.where("probes > 0"), "load")  # else a large hub's rows meet its sums in one task, which can't be split
    of = of.join(load, "hub").select("hub", "a", "comp", "n", "n_hub", "more", "less", "outside", "probes", "others")
    place = lambda n: F.pmod(F.xxhash64("a"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    probes = of.where("outside").withColumns({"i": place("probes"), "probe": F.lit(True)}).withColumn("j", every("others"))
    others = of.withColumns({"j": place("others"), "probe": F.lit(False)}).withColumn("i", every("probes"))
    blocks = probes.unionByName(others).repartition("hub", "i", "j").groupBy("hub", "i", "j")  # else a hub's blocks share a task
    found = stage(blocks.applyInPandas(_derived(percent), "a long, b long"), "links")
    over = connected_components(found).select(F.col("node").alias("comp"), F.col("comp").alias("last"))
    comps = comps.join(over, "comp", "outer").select(F.coalesce("node", "comp").alias("node"), F.coalesce("last", "comp").alias("comp"))
    named_comps = sets.join(comps, "node", "left").select("node", "rep", F.coalesce(comps["comp"], "node").alias("comp"))
    least = named_comps.groupBy("comp").agg(F.min("rep").alias("component_id"))
    answer = named_comps.join(least, "comp").select("node", "component_id")
    out = rows.join(answer, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


ship(__name__)
