"""Receipts, write-ahead log, verification and reconstruction after a crash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEX64 = "^[0-9a-fA-F]{64}$"
BACKENDS = ("indexeddb", "chrome_storage", "memory")


def receipt(acts: DataFrame, key: str, content: str, at: Column, backend: str = "indexeddb", version: str = "3.1") -> DataFrame:
    """A receipt for each act; its id is the hash of what it certifies, so that a repeated write gives the same one."""
    h = F.sha2(content, 256)
    return acts.where(F.length(content) > 0).select(F.sha2(F.concat_ws("|", F.col(key).cast("string"), h, at.cast("string")), 256).alias("receipt_id"), F.col(key).alias("act_id"), h.alias("content_raw_sha256"), F.lit(backend).alias("storage_backend"), at.alias("persisted_at"), F.lit(version).alias("schema_version"))


def receipt_errors() -> Column:
    """What is missing or wrong in a receipt; empty if it is valid."""
    given = lambda c: F.coalesce(F.length(F.col(c).cast("string")) > 0, F.lit(False))
    checks = [F.when(~given(c), F.lit(f"missing {c}")) for c in ("receipt_id", "act_id", "persisted_at", "schema_version")]
    checks += [F.when(~F.coalesce(F.col("content_raw_sha256").rlike(HEX64), F.lit(False)), F.lit("invalid content_raw_sha256")), F.when(~F.coalesce(F.col("storage_backend").isin(*BACKENDS), F.lit(False)), F.lit("invalid storage_backend"))]
    return F.array_compact(F.array(*checks))


def verified(acts: DataFrame, content: str, hash_: str) -> DataFrame:
    """acts with integrity: verified (also where there was no hash), corrupted, or failed without content."""
    return acts.withColumn("integrity", F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "failed").when(F.col(hash_).isNull() | (F.sha2(content, 256) == F.lower(F.regexp_replace(hash_, "^sha256:", ""))), "verified").otherwise("corrupted"))


def write_outcomes(written: DataFrame, receipts: DataFrame, key: str, content: str) -> DataFrame:
    """What was read back against its receipts: persisted, or integrity_error."""
    r = receipts.select(F.col("act_id").alias("__k"), F.col("content_raw_sha256").alias("__h")).distinct()
    j = written.join(r, (F.col(key) == F.col("__k")) & (F.sha2(content, 256) == F.col("__h")), "left")
    return j.withColumn("outcome", F.when(F.col("__k").isNull(), "integrity_error").otherwise("persisted")).drop("__k", "__h")


def wal_entries(entries: DataFrame) -> DataFrame:
    """The entries that may be logged: intents, and completions with a hash of 64 hex digits."""
    return entries.where("entry_type = 'intent' or (entry_type = 'complete' and content_hash rlike '" + HEX64 + "')")


def incomplete(wal: DataFrame, act: str = "act_id", kind: str = "entry_type", at: str = "timestamp", tie: str = "entry_id") -> DataFrame:
    """The latest intent that is not pruned of each act that no completion, of any time, names; by time."""
    open_ = wal.where(F.col(kind) == "intent")
    if "pruned" in wal.columns:
        open_ = open_.where(~F.coalesce("pruned", F.lit(False)))
    w = Window.partitionBy(act).orderBy(F.desc(at), F.desc(tie))
    last = open_.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return last.join(wal.where(F.col(kind) == "complete").select(act).distinct(), act, "left_anti").orderBy(at, tie)


def reset_processing(queue: DataFrame, status: str = "status") -> DataFrame:
    return queue.withColumn(status, F.when(F.col(status) == "processing", "pending").otherwise(F.col(status)))


def reconstructed(queue: DataFrame, receipts: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Each queued or receipted key with state: pending, completed, and discrepancy where a completion has no receipt."""
    r = receipts.select(F.col(key).alias("__k")).distinct()
    j = queue.join(r, F.col(key) == F.col("__k"), "full")
    done = F.coalesce(F.col(status).isin("completed", "done"), F.lit(False))
    return j.select(F.coalesce(key, "__k").alias(key), F.when(F.col("__k").isNull(), "pending").otherwise("completed").alias("state"), (done & F.col("__k").isNull()).alias("discrepancy"), F.col(key).isNull().alias("only_receipt"))


def reconstruction_stats(rows: DataFrame) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    return rows.agg(F.count("*").alias("n"), n(F.col("state") == "pending").alias("pending"), n(F.col("state") == "completed").alias("completed"), n(F.col("discrepancy")).alias("discrepancies"), n(F.col("only_receipt")).alias("only_receipts"))


def migration(items: DataFrame, receipts: DataFrame, key: str, content: str, hash_: str | None = None) -> DataFrame:
    """items with outcome: skipped without id, with a receipt, or without content; else migrated.

    hash_: a column with the hash that the content had; where it is given and differs, the outcome is integrity_error.
    """
    wrong = F.lit(False) if hash_ is None else F.coalesce(F.sha2(content, 256) != F.lower(F.regexp_replace(hash_, "^sha256:", "")), F.lit(False))
    r = receipts.select(F.col(key).alias("__k")).distinct()
    j = items.join(r, F.col(key) == F.col("__k"), "left")
    return j.withColumn("outcome", F.when(F.col(key).isNull(), "skipped_no_id").when(F.col("__k").isNotNull(), "skipped_has_receipt").when(F.coalesce(F.length(content), F.lit(0)) == 0, "skipped_no_content").when(wrong, "integrity_error").otherwise("migrated")).drop("__k")


def storage_error(message: Column, name: Column) -> Column:
    """Kind of a storage error by what its message holds and its name, the first that fits."""
    m, n = F.lower(F.coalesce(message, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    has = lambda *words: m.rlike("|".join(words))
    return (
        F.when(has("quota", "storage limit", "disk full", "exceeded") | (n == "quotaexceedederror"), "quota_exceeded")
        .when(has("permission", "access denied", "not allowed", "security") | (n == "securityerror"), "permission_denied")
        .when((has("indexeddb") & has("unavailable", "not supported")) | (has("database") & has("blocked")) | has("not available", "invalidstateerror") | (n == "invalidstateerror"), "backend_unavailable")
        .when(has("transaction", "abort", "commit") | n.isin("transactioninactiveerror", "aborterror"), "transaction_failed")
        .when(has("integrity", "corrupt", "hash", "mismatch"), "integrity_error")
        .otherwise("unknown_error")
    )
