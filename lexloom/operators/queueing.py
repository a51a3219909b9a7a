"""The work queue: adding, validation, failure classes, retry plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packs import LEGAL, Pack
from ..functions.text import trim
from . import markers

# Failure reasons that may pass, and those that stay; limits of the settings.
TRANSIENT = ("site_unavailable", "network_error", "dom_not_ready", "dom_timeout", "navigation_error", "unknown_error")
PERMANENT = ("act_not_found", "content_selector_mismatch", "container_not_found", "content_empty", "content_below_threshold", "extraction_error")
SETTINGS = {"extraction_delay_ms": (3000, 1000, 30000), "minimum_content_threshold": (100, 50, 1000), "max_retry_attempts": (3, 1, 5), "retry_base_delay_ms": (5000, 2000, 30000)}
NOT_FOUND_TITLE = r"(?i)^404$|\b404\b.*\bnot found\b|\bnot found\b|page not found|requested page not found|does not exist|no such"
UNAVAILABLE_TITLE = r"(?i)^500$|^502$|^503$|^504$|http status\s*5\d{2}|server error|internal server error|service unavailable|bad gateway|gateway timeout|connection refused|temporarily unavailable|timeout|timed out|err_|dns_probe|internet disconnected"
NOT_FOUND_URL = r"(?i)not[-_ ]?found|page[-_ ]?not[-_ ]?found"
UNAVAILABLE_URL = r"(?i)err_|dns_probe|temporarily[-_ ]?unavailable|service[-_ ]?unavailable|gateway[-_ ]?timeout|bad[-_ ]?gateway"


def add(batch: DataFrame, queue: DataFrame, captured: DataFrame, key: str, order: str) -> DataFrame:
    """batch with outcome: added, skipped_in_queue (in the queue, or earlier in the batch), skipped_captured; the queue is asked first.

    Two joins on the key against distinct keys; a null key is never added.
    """
    q = queue.select(F.col(key).alias("__q")).where("__q is not null").distinct()
    c = captured.select(F.col(key).alias("__c")).where("__c is not null").distinct()
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    joined = batch.withColumn("__n", nth).join(q, F.col(key) == F.col("__q"), "left").join(c, F.col(key) == F.col("__c"), "left")
    again = F.col("__q").isNotNull() | ((F.col("__n") > 1) & F.col("__c").isNull())
    outcome = F.when(F.col(key).isNull(), "invalid").when(again, "skipped_in_queue").when(F.col("__c").isNotNull(), "skipped_captured").otherwise("added")
    return joined.withColumn("outcome", outcome).drop("__q", "__c", "__n")


def outcome_counts(added: DataFrame) -> DataFrame:
    n = lambda x: F.count(F.when(F.col("outcome") == x, 1))
    return added.agg(n("added").alias("added"), n("skipped_in_queue").alias("skipped_in_queue"), n("skipped_captured").alias("skipped_captured"))


def pending(queue: DataFrame, captured: DataFrame, key: str) -> DataFrame:
    return queue.join(captured.select(key).distinct(), key, "left_anti")


def known(items: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return items.join(others.select(key).distinct(), key, "left_semi")


def uniqueness(items: DataFrame, key: str) -> DataFrame:
    return items.agg(F.count(key).alias("n"), F.countDistinct(key).alias("n_distinct"), (F.count(key) == F.countDistinct(key)).alias("only_unique"))


def validation(success: Column, error: Column, has_content: Column, content: Column, threshold: int = 100, readiness: Column | None = None) -> Column:
    """Why an extraction is not valid; null if it is."""
    mismatch = F.lit(False) if readiness is None else F.coalesce(readiness == "content_selector_mismatch", F.lit(False))
    size = F.coalesce(F.length(content), F.lit(0))
    return (
        F.when(~F.coalesce(success, F.lit(False)), F.coalesce(error, F.lit("extraction_error")))
        .when(~F.coalesce(has_content, F.lit(False)), F.when(mismatch, "content_selector_mismatch").otherwise("container_not_found"))
        .when(size == 0, "content_empty")
        .when(size < threshold, "content_below_threshold")
    )


def failure_class(reason: Column) -> Column:
    """transient or permanent; unknown reasons are permanent."""
    return F.when(reason.isin(*TRANSIENT), "transient").otherwise("permanent")


def retry_delay(attempt: Column, base: int = 5000) -> Column:
    return (base * F.pow(F.lit(2), F.greatest(F.lit(0), attempt - 1))).cast("long")


def failures(attempts: DataFrame, key: str, at: str = "timestamp", reason: str = "reason") -> DataFrame:
    """One row for each key: the attempts in order, how many came after the first, the last reason."""
    rows = attempts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at, reason))).alias("attempts"), F.count("*").alias("n"))
    return rows.select(key, "attempts", (F.col("n") - 1).alias("retry_count"), F.element_at("attempts", -1)[reason].alias("failure_reason"))


def retry_plan(failed: DataFrame, limit: int | None = None, base: int = 5000) -> DataFrame:
    """failed (failure_reason, retry_count, max_retries) with failure_classification and next_retry_delay_ms."""
    most = F.coalesce(F.col("max_retries"), F.lit(3)) if limit is None else F.lit(limit)
    count = F.coalesce(F.col("retry_count"), F.lit(0))
    kind = F.when(failure_class(F.col("failure_reason")) == "permanent", "permanent").when(count < most, "transient").otherwise("transient_exhausted")
    return failed.withColumn("failure_classification", kind).withColumn("next_retry_delay_ms", F.when(F.col("failure_classification") == "transient", retry_delay(count + 1, base)))


def retry_stats(plan: DataFrame) -> DataFrame:
    again = F.col("failure_classification") == "transient"
    return plan.agg(F.count("*").alias("total"), F.count(F.when(again, 1)).alias("retryable"), F.count(F.when(~again, 1)).alias("permanent"))


def setting(name: str, value: Column) -> Column:
    default, low, high = SETTINGS[name]
    return F.least(F.greatest(F.coalesce(value, F.lit(default)), F.lit(low)), F.lit(high))


def dom_failure(network_error: Column, dom_ready: Column, n_selectors: Column, content: Column, pack: Pack = LEGAL) -> Column:
    blank = F.length(trim(F.coalesce(content, F.lit("")))) == 0
    signal = F.coalesce(markers.legal_signal(content, pack)[0], F.lit(False))
    return (
        F.when(network_error, "network_error")
        .when(~dom_ready, "dom_not_ready")
        .when((n_selectors > 0) & blank, "content_selector_mismatch")
        .when((F.length(content) > 0) & blank, "empty_content")
        .when((F.length(content) > 0) & ~signal, "content_selector_mismatch")
        .otherwise("unknown")
    )


def tab_failure(url: Column, title: Column, is_document: Column) -> Column:
    """What an error page says by its title and address; null if it is none."""
    url, title = F.coalesce(url, F.lit("")), trim(F.coalesce(title, F.lit("")))
    low = F.lower(url)
    return (
        F.when(low.isin("", "about:blank") | low.startswith("chrome-error://") | low.startswith("chrome://"), "site_unavailable")
        .when(title.rlike(NOT_FOUND_TITLE), "act_not_found")
        .when(title.rlike(UNAVAILABLE_TITLE), "site_unavailable")
        .when(~is_document & url.rlike(NOT_FOUND_URL), "act_not_found")
        .when(~is_document & url.rlike(UNAVAILABLE_URL), "site_unavailable")
        .when(~is_document & title.rlike(r"(?i)\berror\b"), "site_unavailable")
    )


def retryable(reason: Column, attempts: Column, limit: Column) -> Column:
    """Whether another selector strategy may help: only for a mismatch, up to a limit between 1 and 10."""
    return (reason == "content_selector_mismatch") & (attempts < F.least(F.greatest(limit, F.lit(1)), F.lit(10)))


def readiness(ready_state: Column, elapsed: Column, signals: dict[str, Column], length: Column, body_signal: Column, timeout: int = 30000, least: int = 100) -> Column:
    """ready, reason, signal_type and should_wait of a page. signals: in order, each name with whether it is there."""
    rendered = ready_state.isin("interactive", "complete")
    none = F.lit(None).cast("string")
    answer = lambda ready, reason=none, signal=none, wait=False: F.struct(F.lit(ready).alias("ready"), reason.alias("reason"), signal.alias("signal_type"), F.lit(wait).alias("should_wait"))
    out = F.when(elapsed > timeout, answer(False, F.when(rendered, "content_selector_mismatch").otherwise("dom_not_ready"))).when(~rendered, answer(False, wait=True))
    for name, there in signals.items():
        out = out.when(there, answer(True, signal=F.lit(name)))
    return out.when((F.coalesce(length, F.lit(0)) >= least) & body_signal, answer(True, signal=F.lit("content_threshold_with_signal"))).otherwise(answer(False, wait=True))


def dom_state(has_body: Column, text_length: Column, loading: Column) -> Column:
    return F.when(~has_body, "not_ready").when(loading, "not_ready").when(text_length < 100, "uncertain").otherwise("ready")
