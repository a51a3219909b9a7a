"""The work queue as a stream: each act's attempts add up in keyed state, and a retry is ordered when it is due.

Attempts come as rows in any order, over any number of batches and restarts. The state of an act is its failures since
its last success, so the order of arrival doesn't matter; a timer of the act fires when its next attempt may be made.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.packs import LEGAL, LEGAL_PAGES, Pack, Pages
from ..functions.shipping import ship
from ..operators import acts, manifest, queueing

#: State with timers needs this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Batches without rows only serve timers; a stream that is to end would never run out of them.
NO_EMPTY = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}
NOW = "done_at long, done_tie long, failures long, last_at long, last_tie long, reason string, due long"
FAILURE = "at long, tie long, reason string"
STATE = "act_id string, kind string, status string, retry_count long, failure_reason string, next_retry_delay_ms long, due_at long, attempt long, stored long"
#: The message of the error that ends a stream whose quota is used up.
PAUSED = "the quota is used up"


class Attempts(StatefulProcessor):
    """The failures of one act since its last success, with a timer for the next attempt.

    A row's time and tie put attempts in order. A success forgets the failures before it; one that arrives late forgets
    only those. The rows of one act in one batch are sorted in memory, all older ones are in the state store.
    """

    def __init__(self, transient: tuple[str, ...], most: int, base: int):
        self.transient, self.most, self.base = transient, most, base

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", NOW)
        self.history = handle.getListState("history", FAILURE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = sorted(((r.at, r.tie, r.reason, r.stored) for r in rows), key=lambda r: r[:2])
        old = self.now.get() if self.now.exists() else (None, None, 0, None, None, None, None)
        done, failures, last, reason, due = old[0:2], old[2], old[3:5], old[5], old[6]
        good = [r for r in new if r[2] is None]
        if good and (done[0] is None or good[-1][:2] > done):
            done = good[-1][:2]
            left = [tuple(h) for h in self.history.get() if tuple(h)[:2] > done] if failures else []
            if left:
                self.history.put(left)
            else:
                self.history.clear()
            failures = len(left)
            last, reason = (left and max(left)[:2]) or (None, None), left and max(left)[2] or None
        bad = [r[:3] for r in new if r[2] is not None and (done[0] is None or r[:2] > done)]
        if bad:
            self.history.appendList(bad)
            failures += len(bad)
            if last[0] is None or bad[-1][:2] > last:
                last, reason = bad[-1][:2], bad[-1][2]
        if due is not None:
            self.handle.deleteTimer(due)
        retries = max(failures - 1, 0)
        status = "completed" if not failures else "permanent" if reason not in self.transient else "transient" if retries < self.most else "transient_exhausted"
        delay = self.base * 2**retries if status == "transient" else None
        due = None if delay is None else last[0] // 1000 + delay
        if due is not None:
            self.handle.registerTimer(due)
        self.now.update((*done, failures, *last, reason, due))
        yield Row(act_id=key[0], kind="state", status=status, retry_count=retries, failure_reason=reason, next_retry_delay_ms=delay, due_at=due, attempt=failures, stored=sum(r[3] or 0 for r in good))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = self.now.get()
        if now[6] == expiredTimerInfo.getExpiryTimeInMs():
            self.now.update((*now[:6], None))
            yield Row(act_id=key[0], kind="retry", status="due", retry_count=now[2], failure_reason=now[5], next_retry_delay_ms=None, due_at=now[6], attempt=now[2] + 1, stored=0)

    def close(self) -> None:
        pass


def _used(session: SparkSession, out: str, n: int) -> int:
    return session.read.schema("used long").parquet(f"{out}/ledger/n={n - 1}").first().used if n else 0


def run(
    spark: SparkSession, source: str, schema, out: str, checkpoint: str, act: str = "act_id", at: str = "timestamp", tie: str = "event_id", reason: Column | None = None,
    size: Column | None = None, quota: int | None = None, freed: int = 0, most: int = 3, base: int = 5000, files: int | None = None, every: str | None = None,
) -> StreamingQuery:
    """Takes attempts from Parquet files as they come and writes, for each batch, out/rows/n=<batch>.

    Rows of kind `state` have an act's status (completed, permanent, transient, transient_exhausted) after the batch,
    those of kind `retry` say that its next attempt is due; retries use the broader selectors. reason: why an attempt
    failed, null for a success. Attempts without act or time are left out, an unknown reason is permanent.

    size: what a success adds to the storage. A batch is not begun while what earlier ones stored, less what exports
    have `freed`, is 95 % of the quota: the stream ends with an error that paused() knows, and the batch is taken when
    the stream is started again. Rows of an act are in one task; its timers live in the state store, which survives a
    restart from the checkpoint. every: a trigger interval, at which
    timers fire too; without it what is there now is taken, with the timers that are due by then, and the stream ends.
    """
    reason = F.col("reason") if reason is None else reason
    kept = queueing.setting("max_retry_attempts", F.lit(most)), queueing.setting("retry_base_delay_ms", F.lit(base))
    most, base = spark.range(1).select(*kept).first()
    stream = spark.readStream.schema(schema)
    stream = (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(source)
    stored = F.lit(0) if size is None else size
    rows = stream.select(F.col(act).cast("string").alias("act_id"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(tie).cast("long").alias("tie"), reason.alias("reason"), stored.cast("long").alias("stored"))
    rows = rows.where("act_id is not null and at is not null").withColumn("tie", F.coalesce("tie", F.lit(0)))
    states = rows.groupBy("act_id").transformWithState(Attempts(queueing.TRANSIENT, most, base), STATE, "update", "ProcessingTime")

    def flush(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        used = _used(session, out, n)
        if quota is not None and not session.range(1).select(manifest.usage(F.lit(used - freed), F.lit(quota))["may_write"]).first()[0]:
            raise RuntimeError(PAUSED)
        batch.write.mode("overwrite").parquet(f"{out}/rows/n={n}")
        added = session.read.schema(STATE).parquet(f"{out}/rows/n={n}").agg(F.coalesce(F.sum("stored"), F.lit(0)).alias("s")).select((F.col("s") + used).cast("long").alias("used"))
        added.write.mode("overwrite").parquet(f"{out}/ledger/n={n}")

    writer = states.writeStream.outputMode("update").foreachBatch(flush).option("checkpointLocation", checkpoint)
    with settings(spark, STORE if every else STORE | NO_EMPTY):  # a stream keeps the settings that it started with
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Settings of the session for as long as it lasts."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def paused(query: StreamingQuery) -> bool:
    """Whether a stream ended because its quota is used up."""
    error = query.exception()
    return error is not None and PAUSED in str(error)


def states(spark: SparkSession, out: str) -> DataFrame:
    """The last state of each act."""
    last = F.max_by(F.struct("status", "retry_count", "failure_reason", "next_retry_delay_ms", "due_at"), F.col("n")).alias("s")
    return _rows(spark, out).where("kind = 'state'").groupBy("act_id").agg(last).select("act_id", "s.*")


def due(spark: SparkSession, out: str) -> DataFrame:
    """The attempts that became due, in the batch that said so, with the selectors that they use."""
    return _rows(spark, out).where("kind = 'retry'").select("act_id", "attempt", "due_at", F.lit("broader_selectors").alias("selector_strategy"), "n")


def retry_pass(orders: DataFrame, pages: DataFrame, key: str = "page_id", html: str = "html", rules: Pages = LEGAL_PAGES, pack: Pack = LEGAL, threshold: int = 100) -> DataFrame:
    """The pages of the attempts that are due, read with the broader selectors and validated: their rows are new attempts for run().

    orders: from due(), once for each act and attempt. The columns: key, attempt, title, content, reason (null for a
    success), selector_strategy_used and recovered_via_retry. Content that isn't valid is not kept; nothing is inferred
    where a page has none. Orders without a page give no row.
    """
    wanted = orders.select("act_id", "attempt").distinct()
    rows = pages.join(wanted, F.col(key).cast("string") == F.col("act_id")).drop("act_id")
    read = acts.act_content(rows, rules, pack, html, broader=True)
    reason = queueing.validation(F.lit(True), F.lit(None).cast("string"), F.length("content") > 0, F.col("content"), threshold)
    read = read.withColumn("reason", reason)
    good = F.col("reason").isNull()
    return read.select(key, "attempt", "title", F.when(good, F.col("content")).alias("content"), "reason", F.lit(acts.strategy(True)).alias("selector_strategy_used"), good.alias("recovered_via_retry"))


def _rows(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(STATE + ", n long").parquet(f"{out}/rows")


ship(__name__)
