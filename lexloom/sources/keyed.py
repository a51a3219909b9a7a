"""Keyed tables: rows in buckets of their key, sorted within, so that a key is read from its bucket and joins don't shuffle.

The tables are Spark's own bucketed ones. A filter on the key reads the buckets of the wanted keys alone, and the sorted
files let row groups be passed over; two tables with the same buckets are joined bucket by bucket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sync
from . import scratch


def write(rows: DataFrame, name: str, key: str, buckets: int = 64, path: str | None = None) -> DataFrame:
    """Writes rows as the keyed table `name` and returns it. path: where its files are, if not in the warehouse.

    The rows are dealt out by the key before they are written, so that each bucket is one sorted file. Rows without key
    are kept, in a bucket of their own; of repeated keys all rows are kept, see put().
    """
    writer = rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite")
    (writer if path is None else writer.option("path", path)).saveAsTable(name)
    return rows.sparkSession.table(name)


def get(spark: SparkSession, name: str, key: str, wanted: list) -> DataFrame:
    """The rows of some keys; only their buckets are read. An empty list has none."""
    return spark.table(name).where(F.col(key).isin(list(wanted)))


def lookup(spark: SparkSession, name: str, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of the distinct keys of a table of any size; the keyed table isn't shuffled, the wanted keys are unless keyed alike."""
    return spark.table(name).join(wanted.select(key).distinct(), key, "left_semi")


def put(spark: SparkSession, name: str, new: DataFrame, key: str, at: str, buckets: int, path: str | None = None) -> DataFrame:
    """The keyed table with new rows in it, the latest of each key by `at`; new ones win at equal times.

    It is written beside the old one and takes its name when it is complete; the files of the old one go if the table
    was in the warehouse.
    """
    fresh = f"{name}_{uuid.uuid4().hex[:8]}"
    write(sync.upsert(spark.table(name), new, key, at), fresh, key, buckets, path)
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
    return spark.table(name)


def add(spark: SparkSession, name: str, new: DataFrame, key: str, at: str, buckets: int, path: str | None = None) -> DataFrame:
    """put() of keys that aren't there yet, each once; any other is an error and changes nothing."""
    there = new.join(spark.table(name).select(key), key, "left_semi")
    twice = new.groupBy(key).count().where("count > 1")
    if not there.isEmpty() or not twice.isEmpty():
        raise ValueError(f"{name} has some of the keys already, or they come twice")
    return put(spark, name, new, key, at, buckets, path)


def temporary(rows: DataFrame, key: str, buckets: int = 16) -> str:
    """The name of a keyed table of rows in the shared folder, which is deleted when the driver ends."""
    spark, name = rows.sparkSession, f"keyed_{uuid.uuid4().hex}"
    write(rows, name, key, buckets, scratch.folder(spark, name))
    return name
