"""Duplicates, changes since the last capture, and the incremental mirror."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in this order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """new over old, the latest of each key; at equal times new wins."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return latest(both, key, F.desc(at), F.desc("__new")).drop("__new")


def language_duplicates(new: DataFrame, existing: DataFrame, key: str, language: str = "content_language") -> DataFrame:
    """new with is_duplicate, allow_extraction and replace_existing; Bengali replaces English and nothing else does."""
    old = existing.select(F.col(key).alias("__k"), F.coalesce(F.col(language), F.lit("english")).alias("__l"), F.lit(True).alias("__there"))
    j = new.join(old, F.col(key) == F.col("__k"), "left")
    there, same = F.coalesce(F.col("__there"), F.lit(False)), F.col("__l") == F.col(language)
    better, worse = (F.col("__l") == "english") & (F.col(language) == "bengali"), (F.col("__l") == "bengali") & (F.col(language) == "english")
    known = there & F.coalesce(same | better | worse, F.lit(False))
    return j.withColumns({"is_duplicate": known, "replace_existing": there & F.coalesce(better, F.lit(False)), "allow_extraction": ~known | F.coalesce(better, F.lit(False))}).drop("__k", "__l", "__there")


def idempotency(new: DataFrame, existing: DataFrame, key: str, content: str = "content_raw", hash_: str = "content_hash") -> DataFrame:
    """new with state: new, no_previous_hash, hash_computation_failed, identical, source_changed."""
    old = existing.select(F.col(key).alias("__k"), F.col(hash_).alias("__h"), F.lit(True).alias("__there"))
    j = new.join(old, F.col(key) == F.col("__k"), "left")
    now = F.when(F.length(content) > 0, F.sha2(content, 256))
    state = F.when(F.col("__there").isNull(), "new").when(F.col("__h").isNull(), "no_previous_hash").when(now.isNull(), "hash_computation_failed").when(F.regexp_replace("__h", "^sha256:", "") == now, "identical").otherwise("source_changed")
    return j.withColumn("state", state).drop("__k", "__h", "__there")


def changed(acts: DataFrame, manifest: DataFrame, key: str = "act_number", hash_: str = "content_hash") -> DataFrame:
    """acts with sync_reason and needed, against the manifest's hashes."""
    old = manifest.select(F.col(key).alias("__k"), F.col(hash_).alias("__h"), F.lit(True).alias("__there"))
    j = acts.join(old, F.col(key) == F.col("__k"), "left")
    none = F.col(key).isNull() | (F.col(key).cast("string") == "")
    reason = F.when(none, "invalid_act").when(F.col("__there").isNull(), "new").when(F.col("__h") == F.col(hash_), "unchanged").when(F.length(hash_) > 0, "content_changed").otherwise("metadata_changed")
    return j.withColumn("sync_reason", reason).withColumn("needed", ~F.col("sync_reason").isin("invalid_act", "unchanged")).drop("__k", "__h", "__there")


def fingerprint(reason: Column, retries: Column, most: Column) -> Column:
    return F.concat_ws(":", F.coalesce(reason, F.lit("unknown")), F.coalesce(retries, F.lit(0)).cast("string"), F.coalesce(most, F.lit(0)).cast("string"))


def changed_failures(failed: DataFrame, manifest: DataFrame, key: str = "act_number") -> DataFrame:
    now = failed.withColumn("failure_fingerprint", fingerprint(F.col("failure_reason"), F.col("retry_count"), F.col("max_retries")))
    old = manifest.select(F.col(key).alias("__k"), F.col("failure_fingerprint").alias("__f"))
    j = now.join(old, F.col(key) == F.col("__k"), "left")
    reason = F.when(F.col(key).isNull(), "invalid_failed_act").when(F.col("__k").isNull(), "new_failed").when(F.col("__f") == F.col("failure_fingerprint"), "unchanged").otherwise("failure_changed")
    return j.withColumn("sync_reason", reason).withColumn("needed", F.col("sync_reason").isin("new_failed", "failure_changed")).drop("__k", "__f")


def pending(acts: DataFrame, failed: DataFrame, key: str = "act_number") -> DataFrame:
    """What is to be written: changed acts and changed failures, as (kind, key, sync_reason)."""
    part = lambda df, kind: df.where("needed").select(F.lit(kind).alias("kind"), key, "sync_reason")
    return part(acts, "act").unionByName(part(failed, "failed"))


def failures_left(failed: DataFrame, succeeded: DataFrame, key: str) -> DataFrame:
    """Failures whose key has not succeeded since."""
    return failed.join(succeeded.select(key).distinct(), key, "left_anti")


def status(enabled: Column, folder: Column, permission: Column, error: Column, syncing: Column) -> Column:
    """label, tone and paused, the first that holds."""
    s = lambda label, tone, paused: F.struct(F.lit(label).alias("label"), F.lit(tone).alias("tone"), F.lit(paused).alias("paused"))
    given = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return F.when(~F.coalesce(enabled, F.lit(False)), s("Disabled", "neutral", True)).when(~given(folder), s("Setup required", "warning", True)).when(given(permission) & (permission != "granted"), s("Permission lost", "danger", True)).when(given(error), s("Error", "danger", True)).when(F.coalesce(syncing, F.lit(False)), s("Syncing", "info", False)).otherwise(s("Ready", "success", False))
