"""Token ids in files of directly addressable codes, from which any token can be read without its neighbours.

An id is cut into chunks of bits, the low ones first. The first level of a file has the first chunk of all its ids, the
next level the second chunk of those that have one, and so on; beside each level but the last a bitmap says which ids go
on, and a rank directory how many did before each block of 512 bits. The place of an id's chunk in the next level is
the rank of its bit, so an id takes a seek for each level, and a run of ids is a run in every level. The widths of the
chunks are chosen for each file, as those that make it smallest.

Documents are in ascending order of their ids throughout all files. A file belongs to one task and is written under a
name of its own; the manifest, a table written last, names the files that count, so that a task that is lost or runs
twice leaves nothing that is ever read.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import numbered, ship, stage
from .packing import _Encoded, encode, tokenizer_path

MAGIC = b"DACT\x01\x00\x00\x00"
#: Bits between two entries of a rank directory.
BLOCK = 512
#: Tokens of a file, but for a longer last document; it is what a task holds in memory.
FILE_TOKENS = 4_000_000
#: Values packed or unpacked at a time; a multiple of 8, so that packed parts end with a byte.
STEP = 1 << 16
MANIFEST = "file string, start long, n_docs long, n_tokens long, n_bytes long, file_crc32 long"
HEAD = "<8sQQQQI"  # magic, documents, tokens, place of the ends, place of the ids, levels
LEVEL = "<IQQQQ"  # bits of a chunk, chunks, places of the chunks, of the bitmap and of the directory


# ---------------------------------------------------------------- bits


def packed(values: np.ndarray, width: int) -> bytes:
    """The low `width` bits of each value, one after another, the lowest bit of each first."""
    parts = (np.unpackbits(values[i : i + STEP].astype("<u4").view("u1").reshape(-1, 4), axis=1, bitorder="little")[:, :width] for i in range(0, len(values), STEP))
    return b"".join(np.packbits(p, bitorder="little").tobytes() for p in parts)


def unpacked(data: bytes, skip: int, n: int, width: int) -> np.ndarray:
    """n values of `width` bits, `skip` bits after the start of data."""
    out, room = np.empty(n, "u4"), 8 if width <= 8 else 16 if width <= 16 else 32
    for i in range(0, n, STEP):
        m, at = min(STEP, n - i), skip + i * width
        raw = np.frombuffer(data, "u1", (at + m * width + 7) // 8 - at // 8, at // 8)
        bits = np.zeros((m, room), "u1")
        bits[:, :width] = np.unpackbits(raw, bitorder="little")[at % 8 : at % 8 + m * width].reshape(m, width)
        out[i : i + m] = np.packbits(bits, bitorder="little").view(f"<u{room // 8}")
    return out


def widths(ids: np.ndarray) -> list[int]:
    """The chunk widths that take the fewest bits for these ids, by dynamic programming over the cuts of the longest id."""
    lengths = np.bincount(np.frexp(np.maximum(ids, 1).astype(float))[1], minlength=2)  # ids 0 and 1 have one bit
    longer = len(ids) - np.cumsum(lengths)  # ids of more than so many bits
    longer[0], top = len(ids), len(lengths) - 1
    cost, cut = [0.0] * (top + 1), [top] * (top + 1)
    for start in reversed(range(top)):
        mark = lambda end: (1 + 32 / BLOCK) if end < top else 0  # noqa: E731  the bit that says whether an id goes on, with its share of the directory
        cost[start], cut[start] = min((float(longer[start]) * (end - start + mark(end)) + cost[end], end) for end in range(start + 1, top + 1))
    out, at = [], 0
    while at < top:
        out.append(cut[at] - at)
        at = cut[at]
    return out


# ---------------------------------------------------------------- files


def encoded_file(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of documents; ends: where each ends among ids."""
    sizes = widths(ids) if len(ids) else [1]
    body, levels = io.BytesIO(), []
    place = struct.calcsize(HEAD) + struct.calcsize(LEVEL) * len(sizes)

    def put(data: bytes) -> int:
        at = place + body.tell()
        body.write(data)
        return at

    left = ids.astype("u4")
    for i, width in enumerate(sizes):
        chunks = put(packed(left, width))
        n = len(left)
        if i + 1 < len(sizes):
            on = (left >> np.uint32(width)) > 0
            bits = np.packbits(on, bitorder="little").tobytes()
            sums = np.concatenate([[0], np.cumsum(np.add.reduceat(on, np.arange(0, n, BLOCK), dtype="i8"))]) if n else np.zeros(1)
            levels.append((width, n, chunks, put(bits), put(sums.astype("<u4").tobytes())))
            left = left[on] >> np.uint32(width)
        else:
            levels.append((width, n, chunks, 0, 0))
    at_ends = put(np.concatenate([[0], ends]).astype("<u8").tobytes())
    known = np.array([d is not None for d in doc_ids], bool)
    at_ids = put(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.packbits(known, bitorder="little").tobytes())
    head = struct.pack(HEAD, MAGIC, len(doc_ids), len(ids), at_ends, at_ids, len(levels))
    return head + b"".join(struct.pack(LEVEL, *x) for x in levels) + body.getvalue()


class TokenFile:
    """Reads a file through `read(place, size)`, which gets only the bytes that an answer needs."""

    def __init__(self, read):
        self.read = read
        magic, self.n_docs, self.n_tokens, self.at_ends, self.at_ids, n = struct.unpack(HEAD, read(0, struct.calcsize(HEAD)))
        if magic != MAGIC:
            raise ValueError("no token file")
        self.levels = [*struct.iter_unpack(LEVEL, read(struct.calcsize(HEAD), struct.calcsize(LEVEL) * n))]

    def _bits(self, place: int, start: int, n: int, width: int) -> np.ndarray:
        first, skip = divmod(start * width, 8)
        return unpacked(self.read(place + first, (skip + n * width + 7) // 8), skip, n, width)

    def _rank(self, level, i: int) -> int:
        """How many of the level's first i ids go on."""
        _, _, _, bitmap, directory = level
        block = i // BLOCK
        (before,) = struct.unpack("<I", self.read(directory + 4 * block, 4))
        rest = i - block * BLOCK
        if not rest:
            return before
        word = int.from_bytes(self.read(bitmap + block * BLOCK // 8, (rest + 7) // 8), "little")
        return before + (word & ((1 << rest) - 1)).bit_count()

    def token(self, i: int) -> int:
        """The i-th id of the file: at most a chunk, a directory entry and a block of bits for each level."""
        value = shift = 0
        for level in self.levels:
            width, _, chunks, bitmap, _ = level
            value |= int(self._bits(chunks, i, 1, width)[0]) << shift
            shift += width
            if not bitmap or not self._bits(bitmap, i, 1, 1)[0]:
                break
            i = self._rank(level, i)
        return value

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The ids from start up to end, which are a run in each level."""
        out, shift, at = np.zeros(max(end - start, 0), "u4"), 0, None
        for level in self.levels:
            width, _, chunks, bitmap, _ = level
            n = end - start
            if n <= 0:
                break
            values = self._bits(chunks, start, n, width) << np.uint32(shift)
            out[slice(None) if at is None else at] |= values
            if not bitmap:
                break
            on = self._bits(bitmap, start, n, 1).astype(bool)
            at = np.flatnonzero(on) if at is None else at[on]
            start = self._rank(level, start)
            end, shift = start + int(on.sum()), shift + width
        return out

    def ends(self) -> np.ndarray:
        """Where the documents begin and end: one number more than there are documents."""
        return np.frombuffer(self.read(self.at_ends, 8 * (self.n_docs + 1)), "<u8").astype("i8")

    def doc_ids(self) -> list[int | None]:
        n = self.n_docs
        raw = self.read(self.at_ids, 8 * n + (n + 7) // 8)
        known = np.unpackbits(np.frombuffer(raw, "u1", offset=8 * n), bitorder="little")[:n]
        return [d if k else None for d, k in zip(np.frombuffer(raw, "<i8", n).tolist(), known.tolist())]


def _file_system(path: str):
    """The file system of a path as pyarrow knows it (local and mounted folders, hdfs, s3, gs, abfs), and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


# ---------------------------------------------------------------- jobs


def tokenized(docs: DataFrame, end: int = 2, path: str | None = None) -> DataFrame:
    """doc_id (long), n and ids of each document with the id `end` after it.

    ids are n little-endian unsigned integers, of 16 bits where no id of the document needs more, else of 32.
    """
    path = path or tokenizer_path()
    last = np.asarray([end], "<u4").tobytes()

    def run(batches):
        from tokenizers import Tokenizer

        known = _Encoded(Tokenizer.from_file(path))
        for b in batches:
            ids = [encode(text.as_py(), known) + last for text in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(_short, ids), pa.binary())], names=["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, ids binary")


def _short(raw: bytes) -> bytes:
    ids = np.frombuffer(raw, "<u4")
    return raw if ids.max() >> 16 else ids.astype("<u2").tobytes()


def _writer(folder: str, most: int):
    def run(batches):
        store, top = _file_system(folder)
        held: list[tuple] = []
        size = 0

        def flush():
            ids = np.concatenate([np.frombuffer(h[3], f"<u{len(h[3]) // h[2]}") for h in held]).astype("u4")
            ends = np.cumsum([h[2] for h in held])
            name = f"{uuid.uuid4().hex}.dact"
            data = encoded_file([h[0] for h in held], ends, ids)
            with store.open_output_stream(f"{top}/{name}") as f:
                f.write(data)
            row = (name, held[0][0], held[0][1], len(held), len(ids), len(data), zlib.crc32(data))
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.string(), *[pa.int64()] * 6))], names=["file", "first_id", "first_row", "n_docs", "n_tokens", "n_bytes", "file_crc32"])

        for b in batches:
            for doc, row, n, ids in zip(*(c.to_pylist() for c in b.columns)):
                held.append((doc, row, n, ids))
                size += n
                if size >= most:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def write(docs: DataFrame, folder: str, end: int = 2, tokenizer: str | None = None, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the ids of all documents below folder and returns the manifest: file, start (ids in the files before), n_docs, n_tokens, n_bytes, file_crc32.

    Documents are in ascending order of doc_id, those without id first, rows that share an id in the order in which
    they were read. A null or empty text is the id `end` alone, repeated rows are written each, a table without rows
    gives a manifest without rows. Very long texts make a longer file. folder is one that driver and executors share;
    it may be new. Of the columns only doc_id and text are read.
    """
    spark = docs.sparkSession
    rows = stage(numbered(tokenized(docs, end, tokenizer), "row"), "tokens")
    total = rows.agg(F.sum("n")).first()[0] or 0
    store, top = _file_system(folder)
    store.create_dir(top, recursive=True)
    tasks = max(1, -(-total // file_tokens))
    sorted_rows = rows.select("doc_id", "row", "n", "ids").repartitionByRange(tasks, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    written = sorted_rows.mapInArrow(_writer(folder, file_tokens), "file string, first_id long, first_row long, n_docs long, n_tokens long, n_bytes long, file_crc32 long")
    files = stage(written, "files").orderBy("first_id", "first_row").collect()  # a row for each file, not for what is in it
    starts = np.concatenate([[0], np.cumsum([f.n_tokens for f in files])]).astype(int).tolist()
    manifest = spark.createDataFrame([(f.file, s, f.n_docs, f.n_tokens, f.n_bytes, f.file_crc32) for f, s in zip(files, starts)], MANIFEST)
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    return manifest_of(spark, folder)


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _reader(folder: str, with_ids: bool):
    def run(batches):
        store, top = _file_system(folder)
        for b in batches:
            for name, start, crc in zip(*(b.column(c).to_pylist() for c in ("file", "start", "file_crc32"))):
                with store.open_input_file(f"{top}/{name}") as f:
                    data = f.read()
                if zlib.crc32(data) != crc:
                    raise OSError(f"{name} isn't as it was written")
                tokens = TokenFile(lambda at, size, data=data: data[at : at + size])
                ends, docs = tokens.ends(), tokens.doc_ids()
                at = 0
                while at < len(docs):  # as many whole documents at a time as make some 250,000 ids
                    to = max(at + 1, int(np.searchsorted(ends, ends[at] + 250_000)) - 1)
                    to = min(to, len(docs))
                    raw = tokens.tokens(int(ends[at]), int(ends[to])).astype("<u4").tobytes()
                    base = int(ends[at])
                    parts = [raw[4 * (int(s) - base) : 4 * (int(e) - base)] for s, e in zip(ends[at:to], ends[at + 1 : to + 1])]
                    columns = [pa.array(docs[at:to], pa.int64()), pa.array(ends[at:to] + start, pa.int64()), pa.array(ends[at + 1 : to + 1] - ends[at:to], pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns, names = [*columns, pa.array(parts, pa.binary())], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    at = to

    return run


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, ids of each document, from the files."""
    manifest = manifest_of(spark, folder)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    files = manifest.select("file", "start", "file_crc32").repartition(max(1, manifest.count()), "file")
    return files.mapInArrow(_reader(folder, with_ids), schema)


def _finder(folder: str, names: list[str], starts: list[int]):
    starts_ = np.array(starts)

    def run(batches):
        store, top = _file_system(folder)
        name = f = tokens = None

        def piece(at: int, size: int) -> bytes:
            f.seek(at)
            return f.read(size)

        for b in batches:
            found = []
            for p in b.column("position").to_pylist():
                i = int(np.searchsorted(starts_, p, "right")) - 1
                if names[i] != name:
                    name, f = names[i], store.open_input_file(f"{top}/{names[i]}")
                    tokens = TokenFile(piece)
                inside = p - starts[i]
                found.append(tokens.token(inside) if 0 <= inside < tokens.n_tokens else None)
            yield pa.RecordBatch.from_arrays([b.column("position"), pa.array(found, pa.int64())], names=["position", "token"])

    return run


def lookup(spark: SparkSession, folder: str, positions: DataFrame) -> DataFrame:
    """position and token, the id at each position of the whole sequence; null where there is none.

    positions (position) may be any number of rows; they are sorted by ranges, so that a task opens few files, and each
    is answered by reads of a few bytes for each level. The manifest's starts, a number for each file, go to all tasks.
    """
    files = manifest_of(spark, folder).orderBy("start").select("file", "start").collect()
    wanted = positions.select(F.col("position").cast("long").alias("position"))
    if not files:
        return wanted.withColumn("token", F.lit(None).cast("long"))
    there = wanted.where("position >= 0").repartitionByRange("position").sortWithinPartitions("position")
    found = there.mapInArrow(_finder(folder, [f.file for f in files], [f.start for f in files]), "position long, token long")
    return found.unionByName(wanted.where("position is null or position < 0").withColumn("token", F.lit(None).cast("long")))


ship(__name__)
