"""What the training-data operators share: staged tables, holdout rule, shipping code to executors."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words in the contracts: space and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]"
WORD_CHAR = r"[^\x20\x09-\x0D]"


def ship(module_name: str) -> None:
    """Send a module's functions to executors by value, so that they need no copy of this library."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it from there.

    This cuts the lineage: a lost executor costs the tasks that it ran, not the plan behind the table. The folder of
    an application is deleted when its driver ends.
    """
    return staged(df, name)[0]


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """stage() with the path of the table, for what is to be deleted earlier."""
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/lexloom-{spark.sparkContext.applicationId}"
    delete_at_end(spark, top)
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


_to_delete: set[str] = set()


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver ends."""
    if path not in _to_delete:
        _to_delete.add(path)
        atexit.register(_delete, spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone already
        pass


def hadoop(spark: SparkSession, path: str):
    """The file system of path, and path as the file system knows it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def held_out(doc_id: Column) -> Column:
    """Documents that no model learns from: crc32 of the id as text leaves 2 when divided by 4. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def numbered(df: DataFrame, name: str = "rid") -> DataFrame:
    """df with a number for each row. The numbers hold only after stage()."""
    return df.withColumn(name, F.monotonically_increasing_id())
