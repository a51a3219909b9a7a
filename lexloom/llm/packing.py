"""Packing documents into sequences of a fixed number of tokens, in as few sequences as it can.

The lengths of all pieces are integers up to the capacity, so their histogram describes the whole problem in at most
`capacity` rows, however large the corpus is. The driver plans on that histogram:

1. Linear grouping: the large lengths, in falling order, are dealt into groups of equal cardinality, and each group is
   rounded up to its largest length. That leaves an instance with few sizes.
2. The few-size instance is solved by column generation: a linear program over configurations (what one sequence
   holds), with a knapsack over the dual prices for new configurations. Its solution is rounded down; what is left of
   each group goes, with the small pieces, to step 4.
3. Substitution: the slots of a configuration get the actual lengths of the group, which are no longer than the size.
4. Best fit: the remaining lengths, in falling order, go each to the fullest open sequence that has room.

Sequences of equal content are kept as one entry with a count, so that the plan's size depends on the capacity and the
number of groups alone. The plan maps (length, rank among the pieces of that length) to a place; ranks are dealt out
by salted windows, so that no length's pieces meet in one task.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import numbered, ship, stage

CAPACITY = 2048
#: (groups, capacity / smallest large length) to try; the plan with the fewest sequences counts.
TRIES = ((64, 8), (96, 3), (96, 2))
#: Chunks that one task's cache of encoded words holds.
CACHE = 600_000
#: Pieces of one length that one window task numbers, on average.
RANKED = 20_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- tokens


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if visible, else the next one from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*seen}))}


_LETTERS = _byte_letters()
#: Chunks whose parts are known without the tokenizer's own normalizer: visible ASCII and the letters of Latin-1.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^a-z0-9à-öø-ÿß]+")


class _Encoded(dict):
    """Token ids of a chunk without white space, as little-endian unsigned 32-bit integers.

    Plain chunks are cut as the tokenizer cuts them and go part by part to its merge table, which is several times
    faster than the whole tokenizer; all others, and what may hold a special token, go to the tokenizer itself.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.merge = tokenizer, tokenizer.model.tokenize

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        if not _PLAIN.fullmatch(chunk) or "<|" in chunk:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        elif (parts := _PARTS.findall(chunk.lower())) != [chunk]:
            self[chunk] = joined = b"".join([self[p] for p in parts])
            return joined
        else:
            ids = [t.id for t in self.merge(chunk if chunk.isascii() else "".join([_LETTERS[b] for b in chunk.encode()]))]
        self[chunk] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed


def encode(text: str | None, known: _Encoded) -> bytes:
    """The ids of a text. The tokenizer drops white space and no token crosses it, so chunks are encoded alone."""
    return b"".join(map(known.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


def tokenized(docs: DataFrame, capacity: int = CAPACITY, end: int = 0, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of the pieces of each document.

    A document is the ids of its text, then the id `end`; null text counts as empty. It is cut every `capacity` ids,
    however long it is. Repeated rows are documents each; a table without rows gives none.
    """
    path = path or tokenizer_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    last = np.asarray([end], "<u4").tobytes()

    def run(batches):
        from tokenizers import Tokenizer

        known = _Encoded(Tokenizer.from_file(path))
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(text.as_py(), known) + last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part))
            columns = [*zip(*out)] or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 6 if with_ids else 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


# ---------------------------------------------------------------- plan


def grouped(counts: np.ndarray, small: int, groups: int) -> list[list[tuple[int, int]]]:
    """The lengths over `small`, in falling order, in groups of equal cardinality; each group has (length, count) runs."""
    lengths = [n for n in range(len(counts) - 1, small, -1) if counts[n]]
    total = int(sum(counts[n] for n in lengths))
    size, out, room = -(-total // groups) if total else 1, [], 0
    for n in lengths:
        left = int(counts[n])
        while left:
            if not room:
                out.append([])
                room = size
            take = min(left, room)
            out[-1].append((n, take))
            left, room = left - take, room - take
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """An optimal fractional solution of the few-size instance: configurations with their multiplicities."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        prices = inverse.sum(0)
        column = _best_configuration(sizes, prices, capacity)
        if prices @ column <= 1 + 1e-7:
            break
        x, step = inverse @ demand, inverse @ column
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    x = np.linalg.solve(basis, demand)
    return [(basis[:, i].astype(int), float(x[i])) for i in range(k) if x[i] > 0]


def _best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable content of one sequence: an unbounded knapsack over the sizes."""
    best, how = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i, (size, price) in enumerate(zip(map(int, sizes), prices)):
        if price <= 1e-12:
            continue
        for at in range(size, capacity + 1, size):  # each block of rooms builds on the one before
            end = min(at + size, capacity + 1)
            value = best[at - size : end - size] + price
            better = value > best[at:end] + 1e-15
            best[at:end][better] = value[better]
            how[at:end][better] = i
    out, room = np.zeros(len(sizes), int), int(np.argmax(best))
    while how[room] >= 0:
        out[how[room]] += 1
        room -= int(sizes[how[room]])
    return out


def plan(counts: np.ndarray, capacity: int = CAPACITY, tries=TRIES) -> list[tuple[int, tuple[int, ...]]]:
    """The best of the plans for each of `tries`."""
    plans = (planned(counts, capacity, groups, capacity // part) for groups, part in tries)
    return min(plans, key=lambda entries: sum(n for n, _ in entries))


def planned(counts: np.ndarray, capacity: int, groups: int, small: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths that each holds) entries that together hold counts[n] pieces of each length n."""
    counts = np.array(counts, dtype=np.int64)
    done: list[tuple[int, tuple[int, ...]]] = [(int(counts[capacity]), (capacity,))] if counts[capacity] else []
    counts[capacity] = 0
    runs = grouped(counts, small, groups)
    left = counts.copy()
    open_: list[tuple[int, tuple[int, ...]]] = []
    if runs:
        sizes = np.array([r[0][0] for r in runs])
        distinct, index = np.unique(sizes, return_inverse=True)
        demand = np.zeros(len(distinct))
        pool: list[list[list[int]]] = [[] for _ in distinct]
        for r, i in zip(runs, index):
            demand[i] += sum(c for _, c in r)
            pool[i] += [list(x) for x in r]
        for content, times in configurations(distinct, demand, capacity):
            times = int(times + 1e-9)
            while times:
                # the actual lengths: as many sequences at once as the current runs allow
                slots: list[int] = []
                most = times
                for i, n in enumerate(content):
                    need = int(n)
                    for run in pool[i]:
                        if not need:
                            break
                        if not run[1]:
                            continue
                        take = min(need, run[1])
                        most = min(most, run[1] // take)
                        slots += [run[0]] * take
                        need -= take
                    if need:
                        most = 0
                if most < 1:
                    break
                for length in slots:
                    left[length] -= most
                for i, n in enumerate(content):
                    need = int(n)
                    for run in pool[i]:
                        if need and run[1]:
                            take = min(need, run[1] // most)
                            run[1] -= take * most
                            need -= take
                    pool[i] = [run for run in pool[i] if run[1]]
                open_.append((most, tuple(slots)))
                times -= most
    return done + best_fit(open_, left, capacity)


def best_fit(open_: list[tuple[int, tuple[int, ...]]], left: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Puts the lengths that are left, in falling order, each into the fullest sequence with room; new ones if none has."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for times, held in open_:
        by_room[capacity - sum(held)].append((times, held))
    for length in range(len(left) - 1, 0, -1):
        n, room = int(left[length]), length
        while n:
            while room < capacity and not by_room.get(room):
                room += 1
            times, held = by_room[room].pop() if by_room.get(room) else (n, ())
            each = room // length
            filled = min(times, n // each)
            if filled:
                by_room[room - each * length].append((filled, held + (length,) * each))
            rest, n, times = n - filled * each, n - filled * each, times - filled
            if times and 0 < rest < each:
                by_room[room - rest * length].append((1, held + (length,) * rest))
                n, times = 0, times - 1
            if times and held:
                by_room[room].append((times, held))
    return [(times, held) for entries in by_room.values() for times, held in entries]


def places(entries: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, pieces a sequence, offset), by length and rank."""
    rank: dict[int, int] = defaultdict(int)
    sequence, rows = 0, []
    for times, held in entries:
        offset = 0
        for length in sorted(set(held), reverse=True):
            each = held.count(length)
            rows.append((length, rank[length], times * each, sequence, each, offset))
            rank[length] += times * each
            offset += each * length
        sequence += times
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


# ---------------------------------------------------------------- operator


def pack(pieces: DataFrame, capacity: int = CAPACITY, tries=TRIES) -> DataFrame:
    """The pieces with sequence_id and offset. Column length is needed; others are kept, but those named as the two new ones.

    Every piece is placed once, repeated rows included. A table without rows gives none. Lengths lie in 1..capacity,
    others, and nulls, are an error. Which of several pieces of one length goes where is by the rows' order.
    """
    spark, kept = pieces.sparkSession, [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = stage(numbered(pieces.select(F.struct(*kept).alias("row"), F.col("length").cast("long").alias("length"))), "pieces")
    histogram = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram:
        if length is None or not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length}")
        counts[length] = n
    table = spark.sparkContext.broadcast(places(plan(counts, capacity, tries)))
    salts = max(32, int(counts.max(initial=0)) // RANKED)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(salts)).cast("int"))
    ranked = salted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("rid")) - 1)
    sizes = salted.groupBy("length", "salt").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.join(sizes.select("length", "salt", before.alias("before")), ["length", "salt"])
    schema = ranked.select("row", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def place(batches):
        rows = table.value
        wide = int(rows[:, 1:3].max(initial=0)) + 1
        keys = rows[:, 0] * wide + rows[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False)
            r = rows[np.searchsorted(keys, length * wide + rank, side="right") - 1]
            nth = rank - r[:, 1]
            new = [pa.array(r[:, 3] + nth // r[:, 4], pa.int64()), pa.array(r[:, 5] + nth % r[:, 4] * length, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("row"), *new], names=schema.names)

    placed = ranked.select("row", "length", (F.col("nth") + F.col("before")).cast("long").alias("rank")).mapInArrow(place, schema)
    return placed.select(*[F.col("row")[c].alias(c) for c in kept], "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Documents, tokenized and packed: a row for each piece, with its place; with_ids adds the piece's ids."""
    return pack(tokenized(docs, capacity, path=path, with_ids=with_ids), capacity)


ship(__name__)
