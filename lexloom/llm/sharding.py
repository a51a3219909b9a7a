"""Sharding by size-tiered compaction.

A store is a folder of immutable Parquet shards and numbered manifests. Arrivals are appended as small shards. A
compaction puts the live shards into tiers by size, each tier `fan_in` times the one below, and merges tiers that
have gathered `fan_in` shards or more into files of about the target size; shards of the target size are left alone.
The merge is one scan, in which Spark packs whole shards into tasks of the target size, so nothing is shuffled.

A version is a manifest. It names lists, files that hold the shards of a write, so that a commit writes its own shards
and the names of the lists, however many shards there are; lists of finished shards are never read again by writers.
The manifest is written under a temporary name and linked or renamed to its own by a call that fails if that version
exists: readers see the old version or the new one, and of two writers one wins. Stores on file systems without such
a call are refused. Shards of the version before stay until `vacuum`. A job that dies leaves at most files that no
manifest names. Nulls, repeated rows and very long texts are stored as they are; a table without rows adds no shard.

All of it is DataFrame functions and the file system's own calls.
"""

from __future__ import annotations

import json
import math
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import hadoop

#: Bytes of a finished shard, and shards that fill a tier.
TARGET, FAN_IN = 128 << 20, 4


class Conflict(RuntimeError):
    """Another writer committed this version first."""


def file_name(stored: DataFrame) -> Column:
    """The file that a row was read from, also where the rows have a column named _metadata."""
    return stored.metadataColumn("_metadata")["file_name"]


class Store:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, fan_in: int = FAN_IN):
        self.spark, self.path, self.target, self.fan_in = spark, path.rstrip("/"), target, fan_in

    # ---- manifests

    def version(self) -> int:
        fs, p = hadoop(self.spark, f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def _get(self, name: str):
        fs, p = hadoop(self.spark, f"{self.path}/manifests/{name}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, what) -> None:
        fs, p = hadoop(self.spark, f"{self.path}/manifests/{name}")
        stream = fs.create(p, False)
        stream.write(bytearray(json.dumps(what).encode()))
        stream.close()

    def manifest(self, version: int | None = None) -> dict:
        """The version, its schema and its lists: name, number of shards, and whether all of them are finished."""
        version = self.version() if version is None else version
        return self._get(f"v{version:012d}.json") if version else {"version": 0, "schema": None, "lists": []}

    def shards(self, version: int | None = None, finished: bool | None = None) -> list[dict]:
        """The live shards; finished: only those of finished lists, or of the others."""
        return [s for x in self.manifest(version)["lists"] if finished in (None, x["finished"]) for s in self._get(x["name"])]

    def _lists(self, shards: list[dict]) -> list[dict]:
        """Writes the shards into a list of finished ones and one of the others."""
        out = []
        for finished in (True, False):
            part = [s for s in shards if (2 * s["bytes"] >= self.target) == finished]
            if part:
                out.append({"name": f"list-{uuid.uuid4().hex}.json", "shards": len(part), "finished": finished})
                self._put(out[-1]["name"], part)
        return out

    def commit(self, base: int, lists: list[dict], schema: str) -> int:
        """Version base + 1 with these lists."""
        name, tmp = f"v{base + 1:012d}.json", f".tmp-{uuid.uuid4().hex}"
        fs, p = hadoop(self.spark, f"{self.path}/manifests/{name}")
        _, t = hadoop(self.spark, f"{self.path}/manifests/{tmp}")
        jvm, scheme = self.spark._jvm, fs.makeQualified(p).toUri().getScheme()
        if scheme not in ("file", "hdfs", "viewfs"):
            raise NotImplementedError(f"{scheme} has no rename that fails if the new name exists")
        self._put(tmp, {"version": base + 1, "schema": schema, "lists": lists})
        try:
            if scheme == "file":  # a hard link is made only if the name is free
                files = jvm.java.nio.file
                files.Files.createLink(*[files.Paths.get(x.toUri().getPath(), self.spark._sc._gateway.new_array(jvm.String, 0)) for x in (p, t)])
            else:
                options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration()).rename(t, p, options)
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception):
                raise
            raise Conflict(f"version {base + 1} exists") from None
        finally:
            fs.delete(t, False)
        return base + 1

    # ---- shards

    def _write(self, df: DataFrame, name: str) -> list[dict]:
        """Writes df into a new folder; its shards with file, bytes and rows."""
        folder = f"{self.path}/data/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        fs, p = hadoop(self.spark, folder)
        found = {s.getPath().getName(): (s.getPath().toString(), int(s.getLen())) for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")}
        stored = self.spark.read.schema(df.schema).parquet(folder)
        rows = dict(stored.groupBy(file_name(stored).alias("f")).count().collect())  # from the files' footers
        return [{"file": f, "bytes": n, "rows": rows[name]} for name, (f, n) in sorted(found.items()) if rows.get(name)]

    def append(self, df: DataFrame) -> int:
        """Adds df's rows, a small shard for each of its partitions that has any; the new version."""
        now = self.manifest()
        schema = df.schema.json()
        if now["schema"] not in (None, schema):
            raise ValueError("the store has another schema")
        return self.commit(now["version"], now["lists"] + self._lists(self._write(df, "arrival")), schema)

    def tiers(self, shards: list[dict]) -> dict[int, list[dict]]:
        """The unfinished shards, under half the target, by tier."""
        out: dict[int, list[dict]] = {}
        for s in shards:
            if 2 * s["bytes"] < self.target:
                out.setdefault(int(math.log(max(1, s["bytes"]), self.fan_in)), []).append(s)
        return out

    def compact(self) -> int:
        """Merges full tiers until none is left, with a version for each round; the last version.

        Each round leaves fewer shards, at most one for each half target's bytes of a merged tier and one more.
        """
        while True:
            now, open_ = self.manifest(), self.shards(finished=False)
            full = [t for t in self.tiers(open_).values() if len(t) >= self.fan_in]
            if not full:
                return now["version"]
            gone = {s["file"] for t in full for s in t}
            merged = [s for t in full for s in self._merge([x["file"] for x in t], now["schema"])]
            if len(merged) >= len(gone):  # they are as full as the session's settings allow
                return now["version"]
            left = self._lists([s for s in open_ if s["file"] not in gone] + merged)
            self.commit(now["version"], [x for x in now["lists"] if x["finished"]] + left, now["schema"])

    def _merge(self, files: list[str], schema: str) -> list[dict]:
        """One scan over whole shards, packed into tasks of the target size; a task writes a file."""
        session = self.spark.newSession()  # its settings are its own
        for k, v in {"spark.sql.files.maxPartitionBytes": self.target, "spark.sql.files.openCostInBytes": 0, "spark.sql.files.minPartitionNum": 1}.items():
            session.conf.set(k, str(v))
        return self._write(session.read.schema(StructType.fromJson(json.loads(schema))).parquet(*files), "merged")

    def _scan(self, files: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*files)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named; files that no manifest names are never read."""
        now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError("the store is empty")
        if not now["lists"]:
            fields = StructType.fromJson(json.loads(now["schema"])).fields
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
        return self._scan([s["file"] for s in self.shards(now["version"])], now["schema"])

    def vacuum(self) -> int:
        """Deletes files that the newest version doesn't name, old manifests and lists; how many files of data. No writer may be at work."""
        now = self.manifest()
        live, gone = {s["file"] for s in self.shards(now["version"])}, 0
        fs, data = hadoop(self.spark, f"{self.path}/data")
        for folder in fs.listStatus(data) if fs.exists(data) else []:
            files = [s.getPath() for s in fs.listStatus(folder.getPath())]
            parts = [f for f in files if f.getName().startswith("part-")]
            dead = [f for f in parts if f.toString() not in live]
            for f in [folder.getPath()] if len(dead) == len(parts) else dead:
                fs.delete(f, True)
            gone += len(dead)
        names = {f"v{now['version']:012d}.json", *(x["name"] for x in now["lists"])}
        for s in fs.listStatus(hadoop(self.spark, f"{self.path}/manifests")[1]) if now["version"] else []:
            if s.getPath().getName() not in names:
                fs.delete(s.getPath(), False)
        return gone


def placed(store: Store) -> DataFrame:
    """The rows of the newest version with shard_id, the number of their shard; a stored column of that name is replaced."""
    now, rows = store.manifest(), store.read()
    kept = [c for c in rows.columns if c != "shard_id"]
    if not now["lists"]:
        return rows.select(*kept, F.lit(None).cast("long").alias("shard_id"))
    files = [f"{store.path}/manifests/{x['name']}" for x in now["lists"]]
    shards = store.spark.read.schema("file string").json(files).select(F.substring_index("file", "/", -1).alias("name"))
    number = shards.select("name", F.row_number().over(Window.orderBy("name")).cast("long").alias("shard_id"))  # names of files only
    rows = rows.select(F.struct(*kept).alias("row"), file_name(rows).alias("name"))
    return rows.join(number, "name", "left").select("row.*", "shard_id")
