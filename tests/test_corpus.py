"""The legal pack against a corpus of captured acts with their recorded results, as JSON files in the folder $LEXLOOM_ACTS."""

import os

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import citations, export, markers
from lexloom.sources import files

FOLDER = os.environ.get("LEXLOOM_ACTS")
pytestmark = pytest.mark.skipif(not FOLDER, reason="LEXLOOM_ACTS names no folder")


@pytest.fixture(scope="module")
def acts(spark):
    return files.acts(spark, f"{FOLDER}/*.json").withColumn("k", F.col("identifiers.internal_id")).cache()


def test_hashes_and_languages(acts):
    bn, en = markers.language_ratios(F.col("content_raw"))
    r = acts.select(F.sha2("content_raw", 256) == F.col("content_raw_sha256"), (bn == F.col("language_distribution.bn_ratio")) & (en == F.col("language_distribution.en_ratio")), markers.number_scripts(F.col("content_raw"))["numeric_representation"] == F.col("numeric_representation"), markers.editorial(F.col("content_raw"))[0] == F.col("editorial_content_present"), T.nfc(F.col("title_raw")) == F.col("title_normalized")).collect()
    assert len(r) > 0 and all(all(x) for x in r)


def test_citations(acts):
    fields = ("citation_text", "lexical_relation_type", "lexical_relation_confidence", "negation_present", "position", "context_before", "context_after")
    want = acts.select("k", F.explode("lexical_references.references").alias("r")).select("k", *[f"r.{c}" for c in fields]).collect()
    got = citations.deduplicated(citations.detect(acts.select("k", F.col("content_raw").alias("text")), key="k"), "k").select("k", "citation_text", "relation", "confidence", "negation_present", "position", "context_before", "context_after").collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_regions_and_protected_sections(acts):
    want = acts.select("k", F.explode("numeric_regions").alias("r")).select("k", "r.start", "r.end", "r.type").collect()
    got = acts.select("k", F.explode(markers.numeric_regions(F.col("content_raw"))).alias("r")).select("k", "r.start", "r.end", "r.type").collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert all(set(r.a) == set(r.b) for r in acts.select(F.col("protected_sections").alias("a"), markers.protected_types(F.col("content_raw")).alias("b")).collect())


def test_export_of_the_same_acts(acts):
    e = export.act(acts.select(F.col("k").alias("act_number"), F.col("title_raw").alias("title"), "content_raw", "url", "volume_number"))
    got = {r.identifiers.internal_id: r for r in e.collect()}
    for r in acts.collect():
        g = got[r.k]
        assert (g.content_raw_sha256, g.volume_number, g.title_normalized, g.content_normalized) == (r.content_raw_sha256, r.volume_number, r.title_normalized, r.content_normalized)
        assert (g.data_quality.completeness, g.data_quality.flags, g.lexical_references["count"]) == (r.data_quality.completeness, r.data_quality.flags, r.lexical_references["count"])
        assert {k: v["count"] for k, v in g.marker_frequency.items()} == {k: v["count"] for k, v in r.marker_frequency.items()}
