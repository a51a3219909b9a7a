"""A data source that writes each row as a JSON file of its own, named by its key, and publishes them all or none.

A task writes its rows under names that no reader looks at. When all tasks are done the driver, which has their lists,
gives the files their final names; if the job fails, what was written is deleted, but for what a task that is still
running adds: clean() takes that. A task that ran twice leaves files that no list names, which go with the job's folder.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.shipping import ship

FORMAT = "lexloom_act_files"
#: Characters of a key that a file name can't have.
UNSAFE = r'[\/:*?"<>|\x00-\x1f%]'


def file_system(path: str):
    """The file system of a path as pyarrow knows it, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ActFilesWriter(DataSourceWriter):
    def __init__(self, path: str, suffix: str, overwrite: bool, job: str):
        self.path, self.suffix, self.overwrite, self.job = path, suffix, overwrite, job

    def write(self, iterator) -> Written:
        """Columns: the name of the file, then its text. Runs in a task."""
        store, top = file_system(self.path)
        folder = f"{top}/_{self.job}"
        store.create_dir(folder, recursive=True)
        files = []
        for row in iterator:
            part = f"{folder}/{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(row[1].encode("utf-8", "surrogatepass"))
            files.append((part, f"{top}/{row[0]}{self.suffix}"))
        return Written(files)

    def commit(self, messages) -> None:
        store, top = file_system(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        if self.overwrite:
            from pyarrow import fs

            there = [x.path for x in store.get_file_info(fs.FileSelector(top, allow_not_found=True)) if x.is_file and x.path.endswith(self.suffix)]
            wanted = {final for _, final in files}
            for old in there:
                if old not in wanted:
                    store.delete_file(old)
        with ThreadPoolExecutor(16) as pool:
            [*pool.map(lambda f: store.move(*f), files)]
        store.create_dir(f"{top}/_{self.job}", recursive=True)
        store.delete_dir(f"{top}/_{self.job}")

    def abort(self, messages) -> None:
        store, top = file_system(self.path)
        store.create_dir(f"{top}/_{self.job}", recursive=True)
        store.delete_dir(f"{top}/_{self.job}")


class ActFiles(DataSource):
    """Options: path, suffix (.json)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ActFilesWriter(self.options["path"], self.options.get("suffix", ".json"), overwrite, uuid.uuid4().hex)


def write(rows: DataFrame, path: str, key: str, suffix: str = ".json", mode: str = "append", indent: int | None = None) -> None:
    """Each row as path/<key><suffix>, an object with its columns, nulls too.

    What a file name can't have in a key is written as %<hex>, and the names `.` and `..` are. Files that are there
    already are replaced, each at once; with mode overwrite all others with the suffix go. Rows without key or with an
    empty one are an error, and so are repeated keys, before anything is written. indent: the files have lines.
    """
    spark = rows.sparkSession
    spark.dataSource.register(ActFiles)
    k = F.col(key).cast("string")
    bad = rows.groupBy(k.alias("k")).count().where("count > 1 or k is null or k = ''")
    if not bad.isEmpty():
        raise ValueError(f"the rows have {bad.count()} keys that are missing or come twice")
    text = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false", "pretty": "true" if indent else "false"})
    rows.select(file_name(k).alias("name"), text.alias("text")).write.format(FORMAT).mode(mode).option("suffix", suffix).save(path)


def clean(path: str) -> None:
    """Deletes what jobs that failed left behind; no reader sees it. No job may be writing there."""
    from pyarrow import fs

    store, top = file_system(path)
    for x in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
        if not x.is_file and x.base_name.startswith("_"):
            store.delete_dir(x.path)


def file_name(key):
    """The key as a file name; distinct keys have distinct names."""
    pieces = F.transform(F.split(key, ""), lambda c: F.when(c.rlike(UNSAFE), F.concat(F.lit("%"), F.lower(F.hex(F.encode(c, "UTF-8"))))).otherwise(c))
    joined = F.array_join(pieces, "")
    return F.when(joined.isin(".", ".."), F.replace(joined, F.lit("."), F.lit("%2e"))).when(joined.startswith("_") | joined.startswith("."), F.concat(F.lit("%"), F.hex(F.substring(joined, 1, 1)), F.substring(joined, 2, 1 << 30))).otherwise(joined)


def read(spark: SparkSession, path: str, schema: str, suffix: str = ".json") -> DataFrame:
    """The files of a folder, each one document on one or several lines; broken ones have their text in _corrupt_record."""
    return spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).option("pathGlobFilter", f"*{suffix}").json(path)


ship(__name__)
