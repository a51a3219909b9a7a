import random
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.functions.packs import GENERIC, LEGAL
from lexloom.operators import citations, markers, quality, structure


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_find_all_has_the_offsets_of_a_plain_search(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab1 é😀(") for _ in range(rng.randrange(60))) for _ in range(200)] + ["", "11", None]
    p = r"\d+|ab"
    got = frame(spark, *texts).select("doc_id", T.find_all(F.col("text"), p).alias("m")).collect()
    for r in got:
        t = texts[r.doc_id] or ""
        assert [(m.position, m.text) for m in r.m] == [(m.start(), m[0]) for m in re.finditer(p, t)]


def merged(regions):
    out = []
    for s, e, k in sorted(regions, key=lambda r: r[0]):
        if out and s <= out[-1][1] + 1:
            last = out[-1]
            out[-1] = (last[0], max(last[1], e), last[2] if k in last[2] else f"{last[2]},{k}")
        else:
            out.append((s, e, k))
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9), st.sampled_from("abc")), max_size=8), min_size=1, max_size=20))
def test_merged_regions(spark, lists):
    data = [(i, [(s, s + n, k) for s, n, k in x]) for i, x in enumerate(lists)]
    df = spark.createDataFrame(data, f"doc_id long, r {T.REGION}")
    for row in df.select("doc_id", T.merge_regions(F.col("r")).alias("m")).collect():
        assert [(x.start, x.end) for x in row.m] == [x[:2] for x in merged(data[row.doc_id][1])]
    spans = df.select("doc_id", F.explode("r").alias("x")).select("doc_id", "x.*")
    got = {(r.doc_id, r.start, r.end) for r in markers.merged_spans(spans).collect()}
    assert got == {(i, s, e) for i, x in data for s, e, _ in merged(x)}


def test_white_space_and_normal_form(spark):
    r = frame(spark, "  a b ﻿", "é", None).select(T.trim(F.col("text")).alias("t"), T.nfc(F.col("text")).alias("n")).collect()
    assert r[0].t == "a b" and r[1].n == unicodedata.normalize("NFC", "é") and r[2].t is None


def test_outside_regions(spark):
    r = frame(spark, "aæ12æ3 æ").select(quality.repair_encoding(F.col("text"), LEGAL, T.merge_regions(T.regions(F.col("text"), {"n": ["12æ3"]}))).alias("t")).first()
    assert r.t == 'a"12æ3 "'


def test_offset_of(spark):
    r = frame(spark, "one two one").select(T.offset_of(F.col("text"), F.lit(" one ")).alias("a"), T.offset_of(F.col("text"), F.lit("one"), 1).alias("b"), T.offset_of(F.col("text"), F.lit("x")).alias("c")).first()
    assert (r.a, r.b, r.c) == (0, 8, -1)


def refs(spark, text, pack=LEGAL):
    return citations.deduplicated(citations.detect(frame(spark, text), pack)).orderBy("position").collect()


def test_english_citation_with_name(spark):
    text = "line one\nas amended by the Penal Code Act, 1860 (XLV of 1860) and so on"
    (r,) = refs(spark, text)
    assert text[r.position :].startswith(r.citation_text) and r.line_number == 2
    assert (r.pattern_type, r.act_name, r.citation_year, r.citation_serial, r.script) == ("ENGLISH_ACT_FULL", "Penal Code Act", "1860", "XLV", "english")
    assert (r.relation, r.confidence, r.negation_present) == ("amendment", "high", False)
    assert r.context_before == "line one\nas amended by the" and r.context_after == "and so on"


def test_bengali_citation_and_negation(spark):
    for words, relation in (("", "mention"), ("রহিত ", "repeal"), ("রহিত না ", "mention")):
        text = f"{words}১৯৭৩ সনের ১২ নং আইন"
        (r,) = refs(spark, text)
        assert (r.citation_year, r.citation_serial, r.script, r.confidence, r.relation) == ("১৯৭৩", "১২", "bengali", "medium", relation)
        assert text[r.position : r.position + len(r.citation_text)] == r.citation_text


def test_presidents_order_and_overlaps(spark):
    assert [(r.pattern_type, r.citation_serial, r.citation_year) for r in refs(spark, "P.O. No. 12 of 1972; Act V of 1898")] == [("PRESIDENTS_ORDER", "12", "1972"), ("ENGLISH_ACT_SHORT", "V", "1898")]


def test_envelope(spark):
    got = citations.envelope(citations.detect(frame(spark, "Act V of 1898, Act X of 1900"), LEGAL)).first()
    assert got["count"] == 2 and [x.citation_serial for x in got.references] == ["V", "X"]


def test_regions_of_the_legal_pack(spark):
    text = "Tk. 500 at 12% per annum. Schedule II; Provided that it stays"
    r = frame(spark, text).select(markers.numeric_regions(F.col("text")).alias("n"), markers.protected_regions(F.col("text")).alias("p"), markers.protected_types(F.col("text")).alias("t")).first()
    assert [(text[x.start : x.end], x.type) for x in r.n][0] == ("Tk. 500", "currency")
    assert r.t == ["proviso"] and (r.p[0].start, r.p[0].end) == (0, len(text))


def test_language_and_digits(spark):
    r = frame(spark, "আইন act ১২ 3", "", "abc").select(*[x.alias(n) for x, n in zip(markers.language_ratios(F.col("text")), "be")], markers.content_language(F.col("text")).alias("l"), markers.number_scripts(F.col("text"))["is_mixed"].alias("m")).collect()
    assert (r[0].l, r[0].m) == ("bengali", True)
    assert (r[0].b, r[0].e) == (0.63, 0.38) and (r[1].b, r[1].e, r[1].l) == (0, 0, "english") and r[2].e == 1.0


def test_preamble_marks_repeat_for_english_only(spark):
    p = markers.preamble(F.col("text"))
    r = frame(spark, "WHEREAS a; WHEREAS b; যেহেতু").select(p["has"].alias("h"), p["position"].alias("p"), p["markers"].alias("m")).first()
    assert r.h and r.p == 0 and r.m.count("WHEREAS") == 2 and "যেহেতু" in r.m


def test_schedule_references_are_apart(spark):
    r = frame(spark, "First Schedule and Schedule II").select(markers.schedule_references(F.col("text")).alias("m")).first()
    at = sorted(m.position for m in r.m)
    assert all(b - a >= 5 for a, b in zip(at, at[1:])) and len(at) >= 2


def test_assessment(spark):
    rows = quality.assess(frame(spark, "plain", "see First Schedule", "bad æ here", None)).orderBy("doc_id").collect()
    assert [r.flags for r in rows] == [[], ["missing_schedule"], ["encoding_error"], []]
    assert [r.completeness for r in rows] == ["complete", "textual_partial", "complete", "complete"]
    assert [r.safe_for_ml for r in rows] == [True, False, False, True]


def test_cleaning(spark):
    rows = quality.clean(frame(spark, "say æhelloæ; (ক) এক; (a) one", "12æ% stays?"), LEGAL).orderBy("doc_id").collect()
    assert rows[0].content_corrected == 'say "hello";\n(ক) এক;\n(a) one'
    assert (rows[0].encoding_repairs, rows[0].list_breaks, rows[0].cleaning_applied) == (2, 2, True)
    s = {r.kind: r.n_changes for r in quality.cleaning_summary(quality.clean(frame(spark, "æ", "ææ"), LEGAL)).collect()}
    assert s["encoding_repairs"] == 3


def test_risk(spark):
    r = spark.createDataFrame([("encoding_fix",), ("ocr_correction",), ("new",)], "transformation_type string")
    assert [x.applied for x in quality.logged(r).collect()] == [True, False, False]


def test_structure(spark):
    text = "১৷ শিরোনাম (১) প্রথম (ক) দফা (২) দ্বিতীয় ২৷ পরে (১) আবার Act V of 1898"
    t = structure.tree(frame(spark, text)).first()
    assert (t.total_sections, t.total_subsections, t.total_clauses) == (2, 3, 1)
    assert t.sections[0].content_end == t.sections[1].content_start and t.sections[1].content_end == len(text)
    d = frame(spark, text)
    r = structure.anchored(citations.detect(d).select("doc_id", "position"), structure.sections(d), structure.marks(d, structure.SUBSECTION)).first()
    assert (r.section_number, r.marker) == ("২৷", "(১)")


def test_merged_references(spark):
    a = spark.createDataFrame([(1, 5, "x"), (1, -1, "y")], "doc_id long, position int, citation_text string")
    b = spark.createDataFrame([(1, 5, "z"), (1, 9, "w")], "doc_id long, position int, citation_text string")
    assert [(r.position, r.citation_text, r.source) for r in structure.merged_references(a, b).orderBy("position").collect()] == [(5, "x", "link"), (9, "w", "pattern")]


def test_markers(spark):
    rows = markers.marker_positions(frame(spark, "x ***\n*** y"), GENERIC.amendment_markers, width=20).orderBy("line_number").collect()
    assert [(r.line_number, r.position, r.context) for r in rows] == [(1, 2, "x ***"), (2, 0, "*** y")]


def test_many_matches_in_one_text(spark):
    """Folds of more than a block of matches; and a text of 40,000 matches in seconds."""
    texts = ["ab" * 64, "ab" * 65 + "c", "xab" * 500, "ab " * 40000]
    for r in frame(spark, *texts).select("doc_id", T.find_all(F.col("text"), "ab").alias("m")).collect():
        assert [m.position for m in r.m] == [m.start() for m in re.finditer("ab", texts[r.doc_id])]


def test_cleaning_leaves_regions(spark):
    """List breaks, repairs and corrections stay out of numeric regions; corrections in protected places are listed."""
    rows = quality.clean(frame(spark, "a; (1) b; x", "thth æ 5%", "licence thth", None), GENERIC).orderBy("doc_id").collect()
    assert [r.content_corrected for r in rows] == ["a; (1) b; x", 'th " 5%', "licence thth", ""]
    assert (rows[0].list_breaks, rows[0].lists_skipped, rows[0].cleaning_flags) == (0, 1, ["cleaning_applied", "numeric_regions_protected"])
    assert rows[1].ocr_corrections == 1 and rows[2].ocr_flagged[0] == ("thth", "th", 8) and rows[2].cleaning_flags == ["cleaning_applied", "protected_sections_enforced"] and rows[3].cleaning_flags == []


def test_checksum_and_short_citations(spark):
    r = frame(spark, "ab", "😀", "", None).select(T.checksum(F.col("text")).alias("c")).collect()
    assert [x.c for x in r] == ["2_195", f"2_{0xD83D + 0xDE00}", "0_0", "0_0"]
    m = frame(spark, "Act V of 1898 and ১৯৭৩ সনের ১২ নং আইন").select(citations.short(F.col("text")).alias("m")).first().m
    assert [(x.kind, x.position) for x in m] == [("english_citation", 0), ("bengali_citation", 18)]
