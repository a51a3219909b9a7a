"""Reading and writing captured documents, failures, logs and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException

FAILED = "act_number string, title string, url string, extraction_status string, failure_reason string, attempts bigint, attempt_history array<struct<attempt_number:bigint,outcome:string,reason:string,selector_strategy:string,timestamp:string>>"
RECEIPT = "receipt_id string, act_id string, content_raw_sha256 string, storage_backend string, persisted_at timestamp, schema_version string"
WAL = "entry_id string, act_id string, entry_type string, timestamp timestamp, content_hash string, session_id string, pruned boolean"
AUDIT = "log_id bigint, timestamp timestamp, operation string, context map<string,string>, actId string, outcome string, contentHash string, storageLocation string"
REFERENCE = "struct<citation_text:string,lexical_relation_type:string,lexical_relation_confidence:string,negation_present:boolean,negation_word:string,negation_context:string,position:bigint,context_before:string,context_after:string>"
ACT = f"identifiers struct<internal_id:string,note:string>, title_raw string, title_normalized string, content_raw string, content_normalized string, content_corrected string, url string, volume_number string, legal_status string, lexical_references struct<count:bigint,references:array<{REFERENCE}>>, protected_sections array<string>, numeric_regions array<struct<start:bigint,`end`:bigint,type:string,numeric_integrity_sensitive:boolean>>, data_quality struct<completeness:string,flags:array<string>,ml_risk_factors:array<string>>, numeric_representation array<string>, language_distribution struct<bn_ratio:double,en_ratio:double>, editorial_content_present boolean, marker_frequency map<string,struct<count:bigint,method:string>>, content_raw_sha256 string"


def acts(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document in each file; broken ones have their text in _corrupt_record."""
    return spark.read.schema(ACT + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def failed(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One failure in each file, or, without multi_line, on each line."""
    return spark.read.schema(FAILED).option("multiLine", multi_line).json(path)


def log(spark: SparkSession, path: str, schema: str = AUDIT) -> DataFrame:
    """A log of a JSON object on each line."""
    return spark.read.schema(schema).json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], StructType.fromDDL(schema))


def first_readable(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, bool]:
    """The first of the Parquet sources that can be read, and whether it isn't the first choice."""
    for i, path in enumerate(paths):
        try:
            return spark.read.parquet(path), i > 0
        except AnalysisException:
            if i + 1 == len(paths):
                raise
    raise ValueError("no paths")


def write_by_volume(acts_: DataFrame, path: str, volume: str = "volume_number") -> None:
    """A folder for each volume; a lost task rewrites its own files only."""
    acts_.write.partitionBy(volume).mode("overwrite").json(path)


def tables(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Registers Parquet tables as views for spark.sql."""
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)


def write_failed(failures: DataFrame, path: str) -> None:
    """Failed acts as JSON, their nulls kept, in files of their own."""
    failures.write.option("ignoreNullFields", False).mode("overwrite").json(path)


def write_record(record: DataFrame, path: str) -> None:
    """A record of one row, such as a manifest, that read_or_empty() reads; the old one is replaced as a whole."""
    record.coalesce(1).write.mode("overwrite").json(path)
