"""The audit log: which operations it knows, and contexts as VARIANT values that are asked by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

# The operations that are known.
OPERATIONS = (
    "write_attempt", "write_success", "write_failure", "read_attempt", "read_success", "read_failure", "extraction_start", "extraction_complete", "extraction_failure",
    "migration_start", "migration_complete", "migration_failure", "export_start", "export_complete", "export_failure", "integrity_check", "integrity_failure",
    "quota_warning", "quota_critical", "backend_switch", "state_reconstruction", "queue_processing_started", "queue_processing_resumed", "queue_processing_paused", "queue_processing_completed",
)


def checked(entries: DataFrame, operation: str = "operation", known: tuple[str, ...] = OPERATIONS) -> DataFrame:
    """entries with verdict: accepted, accepted_unknown (an operation that isn't known is taken with a warning), rejected (none, or an empty one)."""
    given = F.coalesce(F.length(F.col(operation).cast("string")) > 0, F.lit(False))
    return entries.withColumn("verdict", F.when(~given, "rejected").when(F.col(operation).isin(*known), "accepted").otherwise("accepted_unknown"))


def split(entries: DataFrame, operation: str = "operation", known: tuple[str, ...] = OPERATIONS) -> tuple[DataFrame, DataFrame]:
    """The entries to append, and those for the dead letters."""
    rows = checked(entries, operation, known)
    return rows.where("verdict <> 'rejected'"), rows.where("verdict = 'rejected'")


def typed(log: DataFrame, context: str = "context") -> DataFrame:
    """log with the context as a VARIANT: of a JSON text, a struct or a map. Text that is no JSON is null, a missing context an empty object."""
    kind = log.schema[context].dataType
    text = F.to_json(context) if isinstance(kind, (MapType, StructType)) else F.col(context)
    return log.withColumn(context, F.try_parse_json(F.coalesce(text, F.lit("{}"))))


def value(path: str, kind: str = "string", context: str = "context") -> Column:
    """What a typed context has at a path such as $.page.n, as a type; null where there is nothing or something that is no such value."""
    return F.try_variant_get(F.col(context), path, kind)


def where(log: DataFrame, wanted: dict[str, object], context: str = "context") -> DataFrame:
    """The entries whose typed context has all these values, each by its path; the values say the types."""
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    for path, want in wanted.items():
        log = log.where(value(path, kinds[type(want)], context) == F.lit(want))
    return log
