"""Quality issues, assessment, and cleaning that leaves protected places alone."""

from __future__ import annotations

import re
from dataclasses import replace
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.packs import LEGAL, Pack
from . import markers

# Which changes alter no meaning.
RISKS = {
    "mojibake": "non-semantic", "html_entity": "non-semantic", "broken_unicode": "non-semantic", "unicode_normalization": "non-semantic", "encoding_fix": "non-semantic",
    "ocr_word_correction": "potential-semantic", "ocr_correction": "potential-semantic", "spelling_correction": "potential-semantic", "punctuation_change": "potential-semantic", "word_substitution": "potential-semantic",
}


# How issues are described, and what goes with every assessment.
DESCRIPTIONS = {"quote": "Corrupted quotation mark", "table_border": "Corrupted table border"}
OCR_CONTEXT = {"প্রম্্নফ": "London Proof", "অতগরটির": "letter reference"}
COMPLETENESS_DISCLAIMER = "Website representation incomplete; legal completeness unknown"
ML_USAGE_WARNING = "HTML artifacts, encoding noise, and structural gaps are present; suitable only for exploratory retrieval and analysis. Not validated for training or evaluation."
LIMITATIONS = (
    "Section boundary detection is presentation-dependent", "Gazette PDF comparison is out of scope", "Amendment chain inference is prohibited",
    "Preamble and enactment clause may not be present in all HTML extractions", "Statutory footnotes may be incomplete or missing from source HTML",
)
EMPTY_LIMITATIONS = ("Preamble and enactment clause may not be present in all HTML extractions", "Statutory footnotes may be incomplete or missing from source HTML", "Section boundary detection is presentation-dependent")
INTENDED_USE = ("retrieval", "extractive_question_answering")


def encoding_issues(docs: DataFrame, pack: Pack = LEGAL, key: str = "doc_id", text: str = "text", width: int = 20) -> DataFrame:
    """A row for each wrongly decoded character: key, rule, position, found, context."""
    patterns = {k: p for k, (p, _) in pack.encoding.items()}
    found = T.with_context(F.col(text), T.find_each(F.col(text), patterns), width)
    rows = docs.where(F.col(text).rlike("|".join(patterns.values()))).select(key, F.explode(found).alias("m"))
    return rows.select(key, F.col("m.kind").alias("rule"), F.col("m.position").alias("position"), F.col("m.text").alias("found"), F.col("m.context").alias("context"))


def ocr_issues(docs: DataFrame, pack: Pack = LEGAL, key: str = "doc_id", text: str = "text") -> DataFrame:
    patterns = {k: re.escape(k) for k in pack.ocr}
    return docs.where(F.col(text).rlike("|".join(patterns.values()))).select(key, F.explode(T.find_each(F.col(text), patterns)).alias("m")).select(key, F.col("m.kind").alias("incorrect"), F.col("m.position").alias("position"))


def missing_schedules(docs: DataFrame, pack: Pack = LEGAL, key: str = "doc_id", text: str = "text", least: int = 500) -> DataFrame:
    """References with fewer than `least` trimmed characters after them; one for each place and wording."""
    patterns = {str(i): p for i, p in enumerate(pack.missing_schedules)}
    c = F.col(text)
    left = lambda m: F.length(T.trim(F.substr(c, m["position"] + F.length(m["text"]) + 1)))
    found = F.transform(T.find_each(c, patterns), lambda m: F.struct(m["text"].alias("schedule_type"), m["position"].alias("position"), left(m).alias("chars_after")))
    rows = docs.where(c.rlike("|".join(f"(?:{p})" for p in patterns.values()))).select(key, F.explode(found).alias("m"))
    return rows.select(key, "m.*").where(F.col("chars_after") < least).distinct()


def flags(c: Column, pack: Pack = LEGAL, least: int = 500) -> Column:
    """missing_schedule, encoding_error and ocr_artifact, as far as they hold."""
    last = lambda p: F.try_element_at(T.find_all(c, p), F.lit(-1))
    missing = F.lit(False)
    for p in pack.missing_schedules:
        m = last(p)
        missing = missing | F.coalesce(F.length(T.trim(F.substr(c, m["position"] + F.length(m["text"]) + 1))) < least, F.lit(False))
    encoding = T.any_of(c, [p for p, _ in pack.encoding.values()])
    ocr = T.any_of(c, [re.escape(k) for k in pack.ocr]) if pack.ocr else F.lit(False)
    return F.array_compact(F.array(F.when(missing, F.lit("missing_schedule")), F.when(encoding, F.lit("encoding_error")), F.when(ocr, F.lit("ocr_artifact"))))


def completeness(flags_: Column) -> Column:
    has = lambda x: F.array_contains(flags_, x)
    return F.when(F.size(flags_) == 0, "complete").when(has("missing_schedule"), "textual_partial").when(has("encoding_error") | has("ocr_artifact"), "complete").otherwise("uncertain")


def ml_risks(flags_: Column) -> Column:
    names = {"encoding_error": "encoding_ambiguity", "missing_schedule": "missing_schedule_content", "ocr_artifact": "heavy_ocr_correction"}
    return F.array_compact(F.array(*[F.when(F.array_contains(flags_, f), F.lit(r)) for f, r in names.items()]))


def safe_for_training(flags_: Column, risks: Column, numeric: Column | None = None, heavy_ocr: Column | None = None) -> Column:
    unsafe = F.arrays_overlap(flags_, F.array(F.lit("encoding_error"), F.lit("missing_schedule"))) | F.arrays_overlap(risks, F.array(*[F.lit(x) for x in ("numeric_corruption_risk", "encoding_ambiguity", "missing_schedule_content", "heavy_ocr_correction")]))
    for more in (numeric, heavy_ocr):
        unsafe = unsafe if more is None else unsafe | more
    return ~F.coalesce(unsafe, F.lit(False))


def assess(docs: DataFrame, pack: Pack = LEGAL, text: str = "text") -> DataFrame:
    """docs with flags, completeness, ml_risk_factors, safe_for_ml, and what else the text shows."""
    c = F.col(text)
    out = docs.withColumn("flags", flags(c, pack))
    out = out.withColumn("ml_risk_factors", ml_risks(F.col("flags")))
    shown, kinds = markers.editorial(c, pack)
    return out.withColumns({"completeness": completeness(F.col("flags")), "safe_for_ml": safe_for_training(F.col("flags"), F.col("ml_risk_factors")), "has_preamble": markers.preamble(c, pack)["has"], "has_enactment": markers.enactment(c, pack)["has"], "footnotes": markers.footnotes(c, pack), "editorial_content": shown, "editorial_kinds": kinds})


def issues(c: Column, pack: Pack = LEGAL, least: int = 500) -> Column:
    """What is wrong with a text, in words: named schedules with too little after them, wrongly decoded characters, misread words."""
    rest = lambda m: F.length(T.trim(F.substr(c, m["position"] + F.length(m["text"]) + 1)))
    named = T.find_each(c, {str(i): p for i, p in enumerate(pack.missing_schedules)})
    named = F.array_distinct(F.transform(named, lambda m: F.struct(m["text"].alias("text"), m["position"].alias("position"), rest(m).alias("rest"))))
    short = F.transform(F.filter(named, lambda m: m["rest"] < least), lambda m: F.concat(F.lit('Schedule "'), m["text"], F.lit('" referenced but content appears missing (only '), m["rest"], F.lit(" chars after reference)")))
    said = F.create_map(*[F.lit(x) for k in pack.encoding for x in (k, DESCRIPTIONS.get(k, k))])
    wrong = F.transform(T.find_each(c, {k: p for k, (p, _) in pack.encoding.items()}), lambda m: F.concat(F.try_element_at(said, m["kind"]), F.lit(': "'), m["text"], F.lit('" at position '), m["position"]))
    texts = {k: f'OCR artifact: "{k}" should be "{v}"' + (f" ({OCR_CONTEXT[k]})" if k in OCR_CONTEXT else "") for k, v in pack.ocr.items()}
    fixed = F.create_map(*[F.lit(x) for kv in texts.items() for x in kv]) if texts else F.create_map().cast("map<string,string>")
    misread = F.transform(T.find_each(c, {k: re.escape(k) for k in pack.ocr}), lambda m: F.try_element_at(fixed, m["kind"]))
    return F.concat(short, wrong, misread)


def assessment(docs: DataFrame, pack: Pack = LEGAL, text: str = "text", numeric_risk: Column | None = None, encoding_ambiguity: Column | None = None, missing_schedules_: Column | None = None, heavy_ocr: Column | None = None, editorial: Column | None = None) -> DataFrame:
    """docs with data_quality: the whole assessment of a text as a struct, with its issues, risks, limitations and warnings.

    numeric_risk, encoding_ambiguity, missing_schedules_, heavy_ocr, editorial: what the caller knows besides; false by
    default. Null and empty texts are complete, without issues, and safe.
    """
    c, no = F.col(text), F.lit(False)
    given = lambda x: no if x is None else F.coalesce(x, no)
    out = docs.withColumn("__f", flags(c, pack))
    has = lambda x: F.array_contains("__f", x)
    names = {"missing_schedule_content": has("missing_schedule") | given(missing_schedules_), "encoding_ambiguity": has("encoding_error") | given(encoding_ambiguity), "numeric_corruption_risk": given(numeric_risk), "heavy_ocr_correction": given(heavy_ocr)}
    # found risks come first, then those that the caller names
    found = [F.when(has("missing_schedule"), F.lit("missing_schedule_content")), F.when(has("encoding_error"), F.lit("encoding_ambiguity"))]
    named = [F.when(names[k], F.lit(k)) for k in ("numeric_corruption_risk", "encoding_ambiguity", "missing_schedule_content", "heavy_ocr_correction")]
    risks = F.array_distinct(F.array_compact(F.array(*found, *named)))
    opening, enacted, notes = markers.preamble(c, pack), markers.enactment(c, pack), markers.footnotes(c, pack)
    factors = [F.when(names[k], F.lit(k)) for k in ("numeric_corruption_risk", "encoding_ambiguity", "missing_schedule_content", "heavy_ocr_correction")]
    factors += [F.when(~opening["has"], F.lit("preamble_not_detected")), F.when(~enacted["has"], F.lit("enactment_clause_not_detected"))]
    empty, none = F.coalesce(F.length(c), F.lit(0)) == 0, F.array().cast("array<string>")
    listed = lambda values: F.array(*map(F.lit, values))
    unless = lambda x, other: F.when(empty, other).otherwise(x)
    record = F.struct(
        unless(completeness(F.col("__f")), F.lit("complete")).alias("completeness"), F.lit(COMPLETENESS_DISCLAIMER).alias("completeness_disclaimer"), unless(F.col("__f"), none).alias("flags"), unless(issues(c, pack), none).alias("issues"),
        unless(risks, none).alias("risks"), unless(listed(LIMITATIONS), listed(EMPTY_LIMITATIONS)).alias("known_limitations"), unless(safe_for_training(F.col("__f"), risks, given(numeric_risk), given(heavy_ocr)), F.lit(True)).alias("safe_for_ml_training"),
        F.lit(ML_USAGE_WARNING).alias("ml_usage_warning"), unless(F.array_compact(F.array(*factors)), none).alias("ml_risk_factors"), listed(INTENDED_USE).alias("intended_ml_use"),
        unless(opening["has"], no).alias("preamble_present"), unless(opening["markers"], none).alias("preamble_markers"), unless(enacted["has"], no).alias("enactment_clause_present"),
        unless(notes > 0, no).alias("statutory_footnotes_present"), unless(notes, F.lit(0).cast("long")).alias("statutory_footnote_count"), given(editorial).alias("editorial_content_present"),
    )
    return out.withColumn("data_quality", record).drop("__f")


def schedule_errors(html: Column, representation: Column, processed: Column) -> Column:
    """What is wrong with a schedule record; empty if nothing is."""
    return F.array_compact(F.array(F.when(html.isNull(), F.lit("missing html_content")), F.when(F.coalesce(representation, F.lit("")) != "raw_html", F.lit("representation must be raw_html")), F.when(F.coalesce(processed, F.lit(True)), F.lit("must not be processed"))))


# ---- cleaning


def risk(kind: Column) -> Column:
    """Of a kind of change; unknown kinds may alter the meaning."""
    table = F.create_map(*[F.lit(x) for kv in RISKS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit("potential-semantic"))


def logged(changes: DataFrame, kind: str = "transformation_type") -> DataFrame:
    """Changes with risk_level, and whether each is applied or only flagged."""
    return changes.withColumn("risk_level", risk(F.col(kind))).withColumn("applied", F.col("risk_level") == "non-semantic").withColumn("flagged", ~F.col("applied"))


def _to(text: str, match: Column) -> Column:
    return F.lit(text)


def repair_encoding(c: Column, pack: Pack = LEGAL, regions: Column | None = None) -> Column:
    """Each wrong character by its replacement, outside regions; all replacements keep the length."""
    for p, to in pack.encoding.values():
        c = F.regexp_replace(c, p, to) if regions is None else T.replace_outside(c, p, partial(_to, to), regions)
    return c


def correct_ocr(c: Column, pack: Pack, *regions: Column) -> Column:
    """Dictionary corrections outside the regions."""
    for wrong, right in pack.ocr.items():
        c = T.replace_outside(c, re.escape(wrong), partial(_to, right), *regions)
    return c


def separate_lists(c: Column, pack: Pack = LEGAL, regions: Column | None = None) -> Column:
    """List items after a separator on lines of their own: the white space before them becomes a line break."""
    for p, to in pack.lists:
        c = F.regexp_replace(c, p, to) if regions is None else T.replace_outside(c, p, lambda m: F.concat(F.lit("\n"), T.trim(m)), regions)
    return c


def _outside(c: Column, patterns: list[str], *regions: Column) -> tuple[Column, Column]:
    """Matches in none of the regions, and those in one of them: array<struct<kind,position,text>>."""
    found = T.find_each(c, {p: p for p in patterns})
    return F.filter(found, lambda m: ~T.in_any(m, *regions)), F.filter(found, lambda m: T.in_any(m, *regions))


def _of(matches: str, kind: str, test=None) -> Column:
    """How many matches of a kind there are, of those that pass a test."""
    return F.size(F.filter(matches, lambda m: (m["kind"] == kind) if test is None else (m["kind"] == kind) & test(m))).cast("long")


def _record(kind: str, rule: str, replacement: str, count: Column, skipped: Column, reason: str) -> Column:
    """What became of the matches of a rule; null without any."""
    fields = F.struct(F.lit(kind).alias("type"), F.lit(rule).alias("rule"), F.lit(replacement).alias("replacement"), count.alias("count"), skipped.alias("skipped_count"), F.when(count == 0, reason).alias("skipped_reason"), (count > 0).alias("applied"))
    return F.when(count + skipped > 0, fields)


def transformation_log(transformations: str = "transformations", flagged: str = "ocr_flagged") -> Column:
    """The log of a cleaned text, from clean(): what each rule did, then the misread words in protected sections, each with its risk."""
    fix, read = RISKS["encoding_fix"], RISKS["ocr_correction"]
    name = lambda t: F.when(t["type"] == "encoding_repair", "encoding_fix").otherwise(t["type"])
    entry = lambda kind, a, b, at, level, applied, reason: F.struct(kind.alias("transformation_type"), a.alias("original"), b.alias("corrected"), at.cast("int").alias("position"), level.alias("risk_level"), applied.alias("applied"), reason.alias("reason"))
    done = F.transform(transformations, lambda t: entry(name(t), t["rule"], t["replacement"], F.lit(0), F.when(t["type"] == "ocr_correction", read).otherwise(fix), t["applied"], F.lit(None).cast("string")))
    left = F.transform(flagged, lambda m: entry(F.lit("ocr_correction"), m["incorrect"], m["correct"], m["position"], F.lit(read), F.lit(False), F.lit("protected_section_enforcement")))
    return F.concat(done, left)


def clean(docs: DataFrame, pack: Pack = LEGAL, text: str = "text") -> DataFrame:
    """docs with content_corrected, the counts of changes and of what was left alone, cleaning_flags and ocr_flagged.

    Numeric and protected regions are those of the text as it came; encoding repairs, OCR corrections and list breaks
    follow one another, and each leaves matches that overlap a numeric region. OCR matches in protected regions are
    listed in ocr_flagged (incorrect, correct, position) and not changed. transformations has, for each rule that found
    something, how often it was applied and passed over, and why it wasn't applied. Null text counts as empty.
    """
    c = F.coalesce(F.col(text), F.lit(""))
    ocr, wrong = [re.escape(k) for k in pack.ocr], [p for p, _ in pack.encoding.values()]
    right = F.create_map(*[F.lit(x) for k, v in pack.ocr.items() for x in (re.escape(k), v)])
    out = docs.withColumns({"__n": markers.numeric_regions(c, pack), "__p": markers.protected_regions(c, pack)})
    n, g = F.col("__n"), F.col("__p")
    out = out.withColumns({"__a": repair_encoding(c, pack, n), "__e": F.struct(*_outside(c, wrong, n))})
    out = out.withColumns({"__b": correct_ocr(F.col("__a"), pack, n, g), "__o": F.struct(*_outside(F.col("__a"), ocr, n))})
    done, flagged = (lambda k: F.filter(F.col("__o.col1"), lambda m: T.overlaps(g, m["position"], m["position"] + F.length(m["text"])) == F.lit(k)) for _ in "ab")
    n_of = lambda x: F.size(x).cast("long")
    out, made, left = out.withColumn("content_corrected", F.col("__b")), F.lit(0).cast("long"), F.lit(0).cast("long")
    for i, rule in enumerate(pack.lists):
        out = out.withColumn(f"__l{i}", F.struct(*_outside(F.col("content_corrected"), [rule[0]], n))).withColumn("content_corrected", separate_lists(F.col("content_corrected"), replace(pack, lists=(rule,)), n))
        made, left = made + n_of(F.col(f"__l{i}.col1")), left + n_of(F.col(f"__l{i}.col2"))
    out = out.withColumns({
        "encoding_repairs": n_of(F.col("__e.col1")), "encoding_skipped": n_of(F.col("__e.col2")),
        "ocr_corrections": n_of(done(False)), "ocr_skipped": n_of(F.col("__o.col2")),
        "ocr_flagged": F.transform(flagged(True), lambda m: F.struct(m["text"].alias("incorrect"), F.try_element_at(right, m["kind"]).alias("correct"), m["position"].alias("position"))),
        "list_breaks": made, "lists_skipped": left,
    })
    records = []
    for name, (p, to) in pack.encoding.items():
        records.append(_record("encoding_repair", DESCRIPTIONS.get(name, name), to, _of("__e.col1", p), _of("__e.col2", p), "numeric_region_protection"))
    for k, v in pack.ocr.items():
        kept, over = _of("__o.col1", re.escape(k), lambda m: ~T.overlaps(g, m["position"], m["position"] + F.length(m["text"]))), _of("__o.col1", re.escape(k), lambda m: T.overlaps(g, m["position"], m["position"] + F.length(m["text"])))
        records += [_record("ocr_correction", k, v, F.lit(0).cast("long"), over, "protected_section_enforcement"), _record("ocr_correction", k, v, kept, _of("__o.col2", re.escape(k)), "numeric_region_protection")]
    for i in range(len(pack.lists)):
        records.append(_record("formatting", "list_separation", "\n", n_of(F.col(f"__l{i}.col1")), n_of(F.col(f"__l{i}.col2")), "numeric_region_protection"))
    out = out.withColumn("transformations", F.array_compact(F.array(*records)))
    skipped = F.col("encoding_skipped") + F.col("ocr_skipped") + F.col("lists_skipped") > 0
    touched = F.col("encoding_repairs") + F.col("ocr_corrections") + F.col("list_breaks") + F.size("ocr_flagged") > 0
    names = {"cleaning_applied": touched | skipped, "numeric_regions_protected": skipped, "protected_sections_enforced": F.size("ocr_flagged") > 0}
    out = out.withColumn("cleaning_flags", F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in names.items()])))
    return out.withColumn("cleaning_applied", F.col("content_corrected") != c).drop("__a", "__b", "__n", "__p", "__e", "__o", *[f"__l{i}" for i in range(len(pack.lists))])


def cleaning_summary(cleaned: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each kind of change: how many, and in how many documents."""
    kinds = ("encoding_repairs", "ocr_corrections", "list_breaks")
    rows = cleaned.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kinds])).alias("x")).select(key, "x.*")
    return rows.groupBy("kind").agg(F.sum("n").alias("n_changes"), F.countDistinct(F.when(F.col("n") > 0, F.col(key))).alias("n_documents"))
