"""A mirror and a version history that rewrite only what a batch changes: rows in hash buckets, a new version of a bucket
for each change.

out/data/v=<batch>/lx_bucket=<b> has the rows of a bucket as they were after a batch that changed it; out/manifest/v=<batch>
says which version of each bucket is current, and counts once it is complete. A batch that is replayed writes what it
wrote before, so nothing that a lost task left behind is ever read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from ..operators import manifest, sync

MANIFEST = "bucket int, version long, buckets int"
BUCKET = "lx_bucket"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, folder: str, complete: bool = True) -> list[int]:
    """The numbers n of the folders v=<n> in folder, in order; complete: of those alone that a job has finished."""
    fs, top = _files(spark, folder)
    if not fs.exists(top):
        return []
    found = [f.getPath() for f in fs.listStatus(top)]
    names = [(int(m[1]), p) for p in found if (m := re.fullmatch(r"v=(\d+)", p.getName()))]
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(n for n, p in names if not complete or done(p))


def _manifest(spark: SparkSession, out: str, below: int | None = None) -> tuple[dict[int, int], int | None]:
    """The current version of each bucket, after the last batch or the last one below a number, and the number of buckets.

    A manifest has as many rows as there are buckets.
    """
    known = [n for n in _versions(spark, f"{out}/manifest") if below is None or n < below]
    rows = spark.read.schema(MANIFEST).parquet(f"{out}/manifest/v={known[-1]}").collect() if known else []
    return {r.bucket: r.version for r in rows if r.bucket is not None}, max((r.buckets for r in rows), default=None)


def _read(spark: SparkSession, out: str, schema: StructType, versions: dict[int, int]) -> DataFrame:
    """The rows of some buckets, each in a version."""
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{out}/data/v={v}/{BUCKET}={b}" for b, v in sorted(versions.items())])


def merge(spark: SparkSession, out: str, batch: DataFrame, n: int, key: str = "act_number", hash_: str = "content_hash", at: str = "captured_at", buckets: int = 64, touch: bool = True) -> list[int]:
    """Takes batch number n into the mirror below out and returns the buckets that it rewrote.

    Of each key the row with the greatest `at` stays; a later batch wins at equal times, an older row changes nothing.
    out/log/v=<n> has the key, reason, hash and time of what is new or has another hash. touch: a newer row with the same
    hash takes the place of the old one too, without which a late row could win over it; else it is passed over. Rows
    without key are logged as invalid_act and not kept. `at` may be a struct. The number of buckets is that of the first
    batch; the driver lists buckets, never rows. Only versions before n are read, so that a replay does the same again.
    """
    before, buckets = _before(spark, out, n, buckets)
    new = sync.latest(batch, key, F.desc(at)).withColumn(BUCKET, _bucket(key, buckets))
    there = F.col(key).isNotNull()
    touched = [r[0] for r in new.where(there).select(BUCKET).distinct().collect()]
    old = _read(spark, out, batch.schema, {b: before[b] for b in touched if b in before})
    newest = old.select(F.col(key).alias("__o"), F.col(at).alias("__at"))
    found = sync.changed(new, old, key, hash_).join(newest, F.col(key) == F.col("__o"), "left")
    found = found.where(F.col("__at").isNull() | (F.col(at) >= F.col("__at"))).withColumn("taken", there & (F.col("needed") | touch))
    found = found.where("taken or sync_reason = 'invalid_act'").select(key, "sync_reason", hash_, at, BUCKET, "needed", "taken")
    found.write.mode("overwrite").parquet(f"{out}/log/v={n}")
    taken = spark.read.schema(found.schema).parquet(f"{out}/log/v={n}").where("taken")
    rewritten = sorted(r[0] for r in taken.select(BUCKET).distinct().collect())
    rows = new.join(taken.select(key), key, "left_semi").select(*batch.columns)
    return _rewrite(spark, out, n, key, batch.schema, before, buckets, rewritten, lambda old: sync.upsert(old, rows, key, at))


def merge_history(spark: SparkSession, out: str, batch: DataFrame, n: int, key: str = "act_number", at: str = "captured_at", tie: str = "content_hash", buckets: int = 64) -> list[int]:
    """Takes batch number n of captures into the version history below out and returns the buckets that it rewrote.

    A late capture splits the version that it falls in: that one ends when the capture was made, and later ones get the
    next number. history_of() has the captures with version, archived_at and is_current, as manifest.history() gives
    them for all captures at once, whatever the order of the batches. Equal captures count once, those without key are
    left out. Only the buckets of the batch's keys are read and written.
    """
    before, buckets = _before(spark, out, n, buckets)
    new = batch.where(F.col(key).isNotNull())
    rewritten = sorted(r[0] for r in new.select(_bucket(key, buckets).alias("b")).distinct().collect())
    mine = new.select(key).distinct()

    def split(old: DataFrame) -> DataFrame:
        same = old.join(mine, key, "left_anti")  # other keys of the bucket stay as they are
        captures = old.join(mine, key, "left_semi").select(*batch.columns).unionByName(new).distinct()
        return same.unionByName(manifest.history(captures, key, at, tie))

    return _rewrite(spark, out, n, key, _history_schema(batch.schema, at), before, buckets, rewritten, split)


def _history_schema(captures: StructType, at: str) -> StructType:
    return StructType([*captures.fields, StructField("version", IntegerType()), StructField("archived_at", captures[at].dataType), StructField("is_current", BooleanType())])


def history_of(spark: SparkSession, out: str, captures: StructType | str, at: str = "captured_at") -> DataFrame:
    """The versions of all keys after the last complete batch; captures: the schema of the batches."""
    return current(spark, out, _history_schema(StructType.fromDDL(captures) if isinstance(captures, str) else captures, at))


def _before(spark: SparkSession, out: str, n: int, buckets: int) -> tuple[dict[int, int], int]:
    """The versions that batch n finds, and the number of buckets that counts."""
    before, first = _manifest(spark, out, n)
    return before, first or buckets


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _rewrite(spark: SparkSession, out: str, n: int, key: str, schema: StructType, before: dict[int, int], buckets: int, rewritten: list[int], change) -> list[int]:
    """Writes version n of some buckets, from what change() makes of their rows, then the manifest of batch n."""
    if rewritten:
        rows = change(_read(spark, out, schema, {b: before[b] for b in rewritten if b in before})).withColumn(BUCKET, _bucket(key, buckets))
        rows.repartition(len(rewritten), BUCKET).write.partitionBy(BUCKET).mode("overwrite").parquet(f"{out}/data/v={n}")
    now = before | dict.fromkeys(rewritten, n)
    listed = [(b, v, buckets) for b, v in sorted(now.items())] or [(None, None, buckets)]
    spark.createDataFrame(listed, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest/v={n}")
    return rewritten


def current(spark: SparkSession, out: str, schema: StructType | str) -> DataFrame:
    """The rows of the mirror after the last complete batch."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return _read(spark, out, schema, _manifest(spark, out)[0])


def log(spark: SparkSession, out: str) -> DataFrame:
    """What each batch changed, with its number v."""
    return spark.read.parquet(f"{out}/log").where("needed or sync_reason = 'invalid_act'").drop(BUCKET, "needed", "taken")


def vacuum(spark: SparkSession, out: str, keep: int = 1) -> int:
    """Deletes the versions of buckets that none of the last `keep` manifests names, and older manifests; how many buckets went."""
    known = _versions(spark, f"{out}/manifest")
    if not known:
        return 0
    named = {(b, v) for n in known[-keep:] for b, v in _manifest(spark, out, n + 1)[0].items()}
    gone = 0
    for v in _versions(spark, f"{out}/data", complete=False):
        fs, top = _files(spark, f"{out}/data/v={v}")
        parts = [f.getPath() for f in fs.listStatus(top) if f.getPath().getName().startswith(BUCKET)]
        for p in parts:
            if v <= known[-1] and (int(p.getName().split("=")[1]), v) not in named:
                fs.delete(p, True)
                gone += 1
        if v <= known[-1] and not any((int(p.getName().split("=")[1]), v) in named for p in parts):
            fs.delete(top, True)
    for n in known[:-keep]:
        fs, p = _files(spark, f"{out}/manifest/v={n}")
        fs.delete(p, True)
    return gone


def mirrored(
    spark: SparkSession, source: str, schema, out: str, checkpoint: str, key: str = "act_number", hash_: str = "content_hash", at: str = "captured_at",
    files: int = 100, every: str | None = None, buckets: int = 64, keep: int = 2,
) -> StreamingQuery:
    """Keeps a mirror in step with new Parquet files: merge() for each batch, then vacuum() of all but the last `keep` versions.

    every: a trigger interval; without it what is there now is taken and the stream ends.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)

    def flush(batch: DataFrame, n: int) -> None:
        merge(batch.sparkSession, out, batch, n, key, hash_, at, buckets)
        vacuum(batch.sparkSession, out, keep)

    writer = stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
