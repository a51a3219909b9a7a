"""A corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination and packing, in this order.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each stage's rows as a
table and reads them for the next. All stages but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import decontamination, jaccard_join, line_dedup, packing, toxicity
from lexloom.llm._shared import numbered, stage
from lexloom.llm.queries import table


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3; the model is fitted on the labelled ones among docs. Null texts get the bias's score."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(F.struct(*docs.columns).alias("doc"), F.col("text")), model, ["doc"])
    return scored.where("score < 0.3").select("doc.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines, n_chars as it is then; a document that had lines and keeps none goes.

    Null and wordless texts have no lines and stay. Of repeated rows the first keeps its text.
    """
    left = line_dedup.deduped(docs).where("n_deleted = 0 or n_deleted < n_lines")
    chars = F.when(F.col("n_deleted") > 0, F.length("text").cast("long"))
    new = {"text": F.col("text"), "n_chars": F.coalesce(chars, F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return left.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = 90, size: int = 3) -> DataFrame:
    """Of each group of linked documents one row, that with the least id; all without words.

    Rows, not ids, are linked: of repeated rows one stays, and rows that share an id are judged each by its own text.
    Rows without id come last in a group.
    """
    rows = stage(numbered(docs.select(F.struct(*docs.columns).alias("row"))), "numbered")
    found = jaccard_join.groups(rows.select(F.col("rid").alias("doc_id"), F.col("row.text").alias("text")), percent, size)
    found = stage(found.select(F.col("doc_id").alias("rid"), "component_id"), "components")
    shared = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    linked = found.join(shared, "component_id").join(rows.select("rid", F.col("row.doc_id").alias("id")), "rid")
    stays = linked.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "rid")).alias("first")).select(F.col("first.rid").alias("rid"))
    others = linked.select("rid").join(stays, "rid", "left_anti")
    return rows.join(others, "rid", "left_anti").select("row.*")


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share 80 % of their five-word shingles; the 90 % of three words are the contract of op8 alone."""
    return keep_one_of_each_group(spark, docs, sf_dir, percent=80, size=5)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in 20 is in a benchmark item's window. Null and empty texts stay."""
    found = decontamination.find_overlaps(docs.select(F.struct(*docs.columns).alias("doc"), F.col("text")), table(spark, sf_dir, "benchmark"), keep=["doc"])
    return found.where(~decontamination.contaminated()).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places; a null text is one token, repeated rows are packed each."""
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", keep_civil),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_near_copy),
    ("benchmark_decontamination", keep_uncontaminated),
    ("best_fit_packing", pack),
]

#: Toxicity and packing have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
