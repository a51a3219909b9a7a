"""Open intents of a write-ahead log as a stream: an intent is open until its act is completed, whichever comes first."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.shipping import ship
from .queue import STORE, settings

STATE = "done boolean, at long, tie string"
OUT = "act_id string, is_open boolean, at long, tie string"


class Intents(StatefulProcessor):
    """The last intent of one act that isn't pruned, and whether the act was ever completed. No bound on lateness: state is a few values an act."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        done, at, tie = self.state.get() if self.state.exists() else (False, None, None)
        for r in rows:
            if r.kind == "complete":
                done = True
            elif at is None or (r.at, r.tie) > (at, tie):
                at, tie = r.at, r.tie
        self.state.update((done, at, tie))
        yield Row(act_id=key[0], is_open=not done and at is not None, at=at, tie=tie)

    def close(self) -> None:
        pass


def run(spark: SparkSession, source: str, schema, out: str, checkpoint: str, act: str = "act_id", kind: str = "entry_type", at: str = "timestamp", tie: str = "entry_id", files: int | None = None, every: str | None = None) -> StreamingQuery:
    """Takes log entries from Parquet files as they come and writes, for each batch, out/n=<batch> with the acts that it touched.

    Pruned intents, entries without act or time and those of other kinds are passed over. A completion counts whenever
    it comes. every: a trigger interval; without it what is there now is taken and the stream ends.
    """
    stream = spark.readStream.schema(schema)
    stream = (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(source)
    rows = stream.where(~F.coalesce("pruned", F.lit(False)) | (F.col(kind) != "intent")) if "pruned" in stream.columns else stream
    rows = rows.select(F.col(act).cast("string").alias("act_id"), F.col(kind).alias("kind"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.coalesce(F.col(tie).cast("string"), F.lit("")).alias("tie"))
    rows = rows.where("act_id is not null and (kind = 'complete' or (kind = 'intent' and at is not null))").withColumn("at", F.coalesce("at", F.lit(0)))
    states = rows.groupBy("act_id").transformWithState(Intents(), OUT, "update", "None")
    writer = states.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/n={n}")).option("checkpointLocation", checkpoint)
    with settings(spark, STORE):
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def open_intents(spark: SparkSession, out: str) -> DataFrame:
    """act_id, timestamp and entry of each intent that is open after the last batch."""
    rows = spark.read.schema(OUT + ", n long").parquet(out)
    last = rows.groupBy("act_id").agg(F.max_by(F.struct("is_open", "at", "tie"), "n").alias("s")).where("s.is_open")
    return last.select("act_id", F.timestamp_micros("s.at").alias("timestamp"), F.col("s.tie").alias("entry_id"))


ship(__name__)
