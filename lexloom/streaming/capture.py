"""Incremental capture with Structured Streaming.

A batch that is replayed after a failure writes what it wrote before: receipts are keyed by their content, and each
batch has a folder of its own, which is overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import manifest, queueing, recovery


def outcomes(pages: DataFrame, content: str, threshold: int = 100) -> DataFrame:
    """The outcome of each page in one plan: valid or the reason why not, and its class."""
    reason = queueing.validation(F.lit(True), F.lit(None).cast("string"), F.col(content).isNotNull(), F.col(content), threshold)
    return pages.withColumn("reason", reason).withColumn("failure_class", F.when(F.col("reason").isNotNull(), queueing.failure_class(F.col("reason")))).withColumn("valid", F.col("reason").isNull())


def capture(spark: SparkSession, source: str, schema, key: str, content: str, out: str, checkpoint: str, files: int = 100) -> StreamingQuery:
    """Takes new Parquet files as they come: valid pages to out/acts, the rest to out/failed.

    What was written is read back and its hash compared with that of the batch: out/receipts has those that agree,
    with the time of their capture, out/integrity_errors the others.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)

    def write(batch: DataFrame, n: int) -> None:
        session, folder = batch.sparkSession, lambda kind: f"{out}/{kind}/batch={n}"
        outcomes(batch, content).withColumns({"wanted_sha256": T.content_hash(F.col(content)), "captured_at": F.current_timestamp()}).write.mode("overwrite").parquet(folder("outcomes"))
        rows = session.read.parquet(folder("outcomes"))  # the batch is derived once
        rows.where("valid").drop("reason", "failure_class", "valid").write.mode("overwrite").parquet(folder("acts"))
        rows.where("not valid").drop("wanted_sha256").write.mode("overwrite").parquet(folder("failed"))
        back = session.read.parquet(folder("acts"))
        wanted = rows.where("valid").select(F.col(key).alias("act_id"), F.col("wanted_sha256").alias("content_raw_sha256"))
        checked = recovery.write_outcomes(back, wanted, key, content)
        good = checked.where("outcome = 'persisted'")
        recovery.receipt(good, key, content, F.col("captured_at")).write.mode("overwrite").parquet(folder("receipts"))
        checked.where("outcome <> 'persisted'").select(key, "outcome").write.mode("overwrite").parquet(folder("integrity_errors"))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_receipts(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream of receipts, each id once within the delay."""
    return stream.withWatermark("persisted_at", delay).dropDuplicatesWithinWatermark(["receipt_id"])


def sessions(audit: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", at: str = "timestamp", by: str = "operation") -> DataFrame:
    """Counts of audit entries by session windows, with a bound on late data."""
    return audit.withWatermark(at, delay).groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n"))


def processed(pages: DataFrame, content: str, size: str, quota: int, order: list[str], attempts: str = "attempts", most: int = 3, threshold: int = 100) -> DataFrame:
    """The state of each page after one pass over the queue: completed, retry, failed, or waiting once the quota is used up.

    Pages are taken in order; a page that would be written after 95 % of the quota is in use waits. Failures that may
    pass are tried again until `most` attempts, with the delay before the next one.
    """
    rows = outcomes(pages, content, threshold)
    used = manifest.running_usage(rows.withColumn("__size", F.when(F.col("valid"), F.col(size)).otherwise(0)), None, order, "__size", quota)
    again = (F.col("failure_class") == "transient") & (F.col(attempts) < most)
    state = F.when(~F.col("may_write"), "waiting").when(F.col("valid"), "completed").when(again, "retry").otherwise("failed")
    return used.withColumn("state", state).withColumn("next_retry_delay_ms", F.when(F.col("state") == "retry", queueing.retry_delay(F.col(attempts)))).drop("__size")
