"""Export shapes: acts, failures, volumes, the corpus, its validation, file names and documents about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.packs import LEGAL, LEGAL_PAGES, Pack, Pages
from . import citations, markers, page_facts, quality


# Statements that go with every act: what the text is, and what must not be read into it.
STATEMENTS = {
    "temporal_status": "historical_text", "temporal_disclaimer": "No inference of current legal force or applicability",
    "html_capture_definition": "Browser-rendered DOM text nodes", "dom_extraction_method": "textContent",
    "content_raw_disclaimer": "Represents browser-parsed DOM text via textContent, not raw HTML or server response bytes",
    "reference_semantics": "string_match_only", "reference_warning": "Keywords detected in proximity to citation strings. No legal relationship, effect, direction, or applicability is implied.",
    "negation_handling": "classification_suppression_only", "numeric_integrity": "best_effort_html_only", "numeric_warning": "Numeric expressions may be incomplete or malformed due to HTML source limitations",
    "encoding_policy": "preserve_html_artifacts", "encoding_scope": "non-semantic, display-only", "source_authority": "bdlaws_html_only",
}
AUTHORITY_RANK = ("bdlaws_html",)
CAPTURE_ENVIRONMENT = {"browser": "Chrome", "browser_engine": "Blink", "extraction_api": "element.textContent", "innerText_forbidden": True}
TRUST_BOUNDARY = {
    "can_trust": ("Text appeared on bdlaws HTML pages at extraction time", "No semantic rewriting was applied", "Transformations are logged"),
    "must_not_trust": ("Legal validity", "Gazette equivalence", "Completeness", "Numerical accuracy", "Amendment correctness", "Post-extraction relevance"),
}
FORMATTING_SCOPE = "presentation_only"
LOG = "array<struct<transformation_type:string,original:string,corrected:string,position:int,risk_level:string,applied:boolean,reason:string>>"


def _listed(values) -> Column:
    return F.array(*map(F.lit, values))


def act(docs: DataFrame, pack: Pack = LEGAL, key: str = "act_number", title: str = "title", content: str = "content_raw", url: str = "url", volume: str = "volume_number", html: str | None = None, clean: bool = False, rules: Pages = LEGAL_PAGES) -> DataFrame:
    """The derived record of each captured act: three layers of text, hash, references, status, markers, language, regions, schedules, risk and quality.

    html: a column with the page, parsed once by `rules` for extraction_risk and schedules; clean: content_corrected is
    the cleaned text, transformation_log says what was changed, and formatting_scope stands where anything was.
    Null content counts as empty text, which has no hash. Keys are the acts', and rows of one key are one act.
    """
    docs = docs.withColumn(content, F.coalesce(F.col(content).cast("string"), F.lit("")))
    c = F.col(content)
    bn, en = markers.language_ratios(c, pack)
    shown, _ = markers.editorial(c, pack)
    out = quality.assess(docs, pack, content).withColumn("__normal", T.nfc(c))
    if clean:
        fixed = quality.clean(out, pack, "__normal")
        out = fixed.withColumns({"__corrected": F.col("content_corrected"), "__log": quality.transformation_log(), "__scope": F.when(F.size("transformations") > 0, FORMATTING_SCOPE), "flags": F.when(F.array_contains("cleaning_flags", "cleaning_applied"), F.array_append("flags", F.lit("cleaning_applied"))).otherwise(F.col("flags"))})
    else:
        out = out.withColumns({"__corrected": F.col("__normal"), "__log": F.array().cast(LOG), "__scope": F.lit(None).cast("string")})
    refs = citations.deduplicated(citations.detect(docs, pack, key, content), key)
    one = F.struct(
        "citation_text", F.col("relation").alias("lexical_relation_type"), F.col("confidence").alias("lexical_relation_confidence"), "negation_present", "negation_word",
        F.when(F.col("negation_present"), F.concat_ws(" ", "context_before", "citation_text", "context_after")).alias("negation_context"), F.col("position").cast("long").alias("position"), "context_before", "context_after",
    )
    refs = refs.groupBy(F.col(key).alias("__k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", one.alias("ref")))), lambda x: x["ref"]).alias("__refs"))  # bounded by one act's text
    out = out.join(refs, F.col(key) == F.col("__k"), "left")
    list_ = F.coalesce("__refs", F.array().cast(refs.schema["__refs"].dataType))
    out = out.withColumn("__facts", page_facts.of(F.col(html) if html else F.lit(None).cast("string"), rules))
    risk = page_facts.risk("__facts.risks")
    quality_ = F.struct("completeness", F.lit(quality.COMPLETENESS_DISCLAIMER).alias("completeness_disclaimer"), "flags", "ml_risk_factors", F.when(F.length(c) > 0, _listed(quality.LIMITATIONS)).otherwise(_listed(quality.EMPTY_LIMITATIONS)).alias("known_limitations"), F.lit(quality.ML_USAGE_WARNING).alias("ml_usage_warning"))
    return out.select(
        F.struct(F.col(key).cast("string").alias("internal_id"), F.lit("internal_id is the database identifier, not the legal citation number").alias("note")).alias("identifiers"),
        F.col(title).alias("title_raw"), T.nfc(F.col(title)).alias("title_normalized"),
        c.alias("content_raw"), F.col("__normal").alias("content_normalized"), F.col("__corrected").alias("content_corrected"), F.col(url).alias("url"), F.coalesce(F.nullif(F.col(volume), F.lit("")), F.lit("unknown")).alias("volume_number"),
        markers.legal_status(c, pack)[0].alias("legal_status"),
        F.struct(F.size(list_).cast("long").alias("count"), F.lit("pattern-based detection").alias("method"), F.lit("Detected via pattern matching. No legal force or applicability implied.").alias("disclaimer"), list_.alias("references")).alias("lexical_references"),
        page_facts.schedule("__facts.schedules", "__facts.names_schedules").alias("schedules"), F.col("__log").alias("transformation_log"),
        markers.protected_types(c, pack).alias("protected_sections"),
        F.transform(markers.numeric_regions(c, pack), lambda r: F.struct(r["start"].cast("long").alias("start"), r["end"].cast("long").alias("end"), r["type"].alias("type"), F.lit(True).alias("numeric_integrity_sensitive"))).alias("numeric_regions"),
        quality_.alias("data_quality"), risk.alias("extraction_risk"),
        markers.number_scripts(c, pack)["numeric_representation"].alias("numeric_representation"), F.struct(bn.alias("bn_ratio"), en.alias("en_ratio")).alias("language_distribution"),
        shown.alias("editorial_content_present"), markers.marker_frequency(c, pack).alias("marker_frequency"), T.content_hash(c).alias("content_raw_sha256"),
        *[F.lit(v).alias(k) for k, v in STATEMENTS.items()], _listed(AUTHORITY_RANK).alias("authority_rank"), F.struct(*[F.lit(v).alias(k) for k, v in CAPTURE_ENVIRONMENT.items()]).alias("capture_environment"),
        F.struct(*[_listed(v).alias(k) for k, v in TRUST_BOUNDARY.items()]).alias("trust_boundary"), F.col("__scope").alias("formatting_scope"),
    )


def legacy_act(docs: DataFrame, pack: Pack = LEGAL, key: str = "act_number", title: str = "title", content: str = "content", metadata: str | None = None) -> DataFrame:
    """key and json, the older shape of an act: metadata, title, number, content and plain marker counts."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counts = F.create_map(*[x for name, n in markers.marker_counts(text(content), pack).items() for x in (F.lit(name), n)])
    meta = F.col(metadata) if metadata else F.create_map().cast("map<string,string>")
    return docs.select(key, F.to_json(F.struct(meta.alias("_metadata"), text(title).alias("title"), text(key).alias("act_number"), text(content).alias("content"), counts.alias("sections_detected"))).alias("json"))


def corpus_act(rows: DataFrame, pack: Pack = LEGAL, names: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The projection of an act into the corpus: each field from the first of its names that has a value that isn't empty.

    marker_frequency falls back to zero counts, volume_number to unknown, all other fields to empty text.
    """
    names = names or {"act_number": ("actNumber", "act_number"), "title": ("title",), "content": ("content",), "url": ("url",), "volume_number": ("volumeNumber", "volume_number")}
    there = set(rows.columns)
    given = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    fields = [F.coalesce(*[given(c) for c in all_ if c in there], F.lit("unknown" if name == "volume_number" else "")).alias(name) for name, all_ in names.items()]
    zero = F.create_map(*[x for name in pack.frequency for x in (F.lit(name), F.lit(0).cast("long"))])
    counts = [F.col(c) for c in ("marker_counts", "marker_frequency", "sections_detected") if c in there]
    return rows.select(*fields, F.coalesce(*counts, zero).alias("marker_frequency"))


def volume_catalog(acts: DataFrame, volume: str, key: str, title: str) -> DataFrame:
    """A row for each act: its volume, the volume's number of acts, act_number and title; write it with write_by_volume()."""
    counts = acts.groupBy(F.col(volume).alias("__v")).agg(F.count("*").alias("total_acts"))
    rows = acts.select(volume, F.col(key).alias("act_number"), F.col(title).alias("title"))
    return rows.join(counts, rows[volume].eqNullSafe(counts["__v"])).select(volume, "total_acts", "act_number", "title")


def corpus(done: DataFrame, failed: DataFrame) -> DataFrame:
    """Successes and failures in one table, told apart by extraction_status."""
    return done.withColumn("extraction_status", F.lit("success")).unionByName(failed.withColumn("extraction_status", F.lit("failed")), allowMissingColumns=True)


def corpus_header(rows: DataFrame) -> DataFrame:
    n = lambda x: F.count(F.when(F.col("extraction_status") == x, 1))
    return rows.agg(F.count("*").alias("total_acts"), n("success").alias("successful"), n("failed").alias("failed"))


def failed_act(failures: DataFrame, at: str = "timestamp", most: int = 3) -> DataFrame:
    """The export of a failure from its attempts in order: count, first and last time, strategies, whether retries ran out."""
    a = F.col("attempts")
    strategies = F.array_distinct(F.transform(a, lambda x: x["selector_strategy"])) if "selector_strategy" in str(failures.schema["attempts"].dataType.simpleString()) else F.array().cast("array<string>")
    return failures.withColumns({"n_attempts": F.size(a).cast("long"), "first_attempt_at": F.try_element_at(a, F.lit(1))[at], "last_attempt_at": F.try_element_at(a, F.lit(-1))[at], "selector_strategies_used": strategies, "max_retries_reached": F.col("retry_count") >= most})


def errors(rows: DataFrame, required: list[str]) -> DataFrame:
    """rows with errors (what is missing, empty text included) and valid."""
    missing = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"missing {c}")) for c in required]
    return rows.withColumn("errors", F.array_compact(F.array(*missing))).withColumn("valid", F.size("errors") == 0)


def corpus_errors(rows: DataFrame) -> DataFrame:
    """rows of the corpus with errors and valid.

    All need act_number and title. Failed acts have null content_raw, a failure_reason and attempts; the others need
    content, marker_frequency and volume_number. Empty texts are texts, but an empty failure_reason is none.
    """
    failed = F.coalesce(F.col("extraction_status") == "failed", F.lit(False))
    there = lambda c: F.col(c).isNotNull() if c in rows.columns else F.lit(False)
    checks = [(~there("act_number"), "act_number is not a string"), (~there("title"), "title is not a string")]
    checks += [(failed & there("content_raw"), "failed act should have content_raw as null"), (failed & (~there("failure_reason") | (F.coalesce(F.col("failure_reason"), F.lit("")) == "" if "failure_reason" in rows.columns else F.lit(True))), "failed act missing failure_reason"), (failed & ~there("attempts"), "failed act missing attempts count")]
    checks += [(~failed & ~there("content"), "content is not a string"), (~failed & ~there("marker_frequency"), "marker_frequency is not an object"), (~failed & ~there("volume_number"), "volume_number is null or undefined")]
    return rows.withColumn("errors", F.array_compact(F.array(*[F.when(test, F.lit(said)) for test, said in checks]))).withColumn("valid", F.size("errors") == 0)


def json_valid(c: Column) -> Column:
    """Whether a text is a JSON object; arrays, plain values and null are not."""
    return F.coalesce(F.trim(c).startswith("{") & F.try_parse_json(c).isNotNull(), F.lit(False))


def file_name(kind: str, key: Column, at: Column, prefix: str = "corpus") -> Column:
    """prefix_kind_key_yyyyMMdd_HHmmss.json, in the session's time zone; characters that file names can't have go."""
    safe = T.trim(F.regexp_replace(key.cast("string"), r'[<>:"/\\|?*\x00-\x1f]', ""))
    safe = F.coalesce(F.nullif(safe, F.lit("")), F.lit("unknown"))
    return F.concat(F.lit(f"{prefix}_{kind}_"), safe, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(".json"))


#: How a corpus is made and what it can't say, for its README.
METHOD = (
    "Pages are opened one at a time, at a bounded rate, and read once their text is there.",
    "Text is what the browser shows; each act has it as captured, in canonical composition, and corrected.",
    "A hash of the captured text goes with each act and is checked when it is read back.",
    "References, regions and markers are matches of patterns, with their places in the captured text.",
)
LIMITS = (
    "Acts, schedules and footnotes may be missing or incomplete on the pages themselves.",
    "Nothing is compared with printed sources, and no legal force is implied.",
    "Places of sections depend on how a page is laid out.",
)


def documents(stats: DataFrame, title: str, version: str = "1.0", url: str = "", licence: str = "", authors: tuple[str, ...] = (), keywords: tuple[str, ...] = (), coverage: DataFrame | None = None) -> DataFrame:
    """name and content of README.md and CITATION.cff, from the one row of manifest.stats() and, if given, that of manifest.coverage().

    With capture times in stats both say the period, and the citation has the day of the last capture.
    """
    n, v, c = (F.col(x).cast("string") for x in ("total_acts", "total_volumes", "total_characters"))
    day = lambda x: F.coalesce(F.date_format(x, "yyyy-MM-dd"), F.lit("unknown")) if x in stats.columns else F.lit("unknown")
    first, last = day("first_capture"), day("last_capture")
    k = coverage.first() if coverage is not None else None
    covered = "Not computed." if k is None else f"{k.in_corpus} of {k.referenced} referenced acts are in the corpus ({k.coverage_percent} %)."
    listed = lambda xs: "".join(f"- {x}\n" for x in xs)
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    readme = text(
        f"# {title}\n\n| | |\n|---|---|\n| Acts | ", n, " |\n| Volumes | ", v, " |\n| Characters | ", c, " |\n| Captured | ", first, " to ", last, " |\n\n## Method\n\n", listed(METHOD), "\n## Coverage\n\n", covered, "\n\n## Known limits\n\n", listed(LIMITS),
        f"\n## Licence and citation\n\n{licence or 'See the source.'} Version {version}; cite it by CITATION.cff.\n",
    )
    quoted = lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'
    cff = text(
        f"cff-version: 1.2.0\ntype: dataset\ntitle: {quoted(title)}\nversion: {quoted(version)}\ndate-released: ", last, "\n", f"url: {quoted(url)}\n" if url else "", f"license: {quoted(licence)}\n" if licence else "",
        "abstract: ", n, " acts in ", v, " volumes, ", c, " characters\n", "keywords:\n" + listed(map(quoted, keywords)) if keywords else "", "authors:\n" + listed(f"name: {quoted(a)}" for a in authors) if authors else "",
    )
    return stats.select(F.explode(F.create_map(F.lit("README.md"), readme, F.lit("CITATION.cff"), cff)).alias("name", "content"))


#: What the fields of an exported act mean.
DESCRIPTIONS = {
    "identifiers.internal_id": "Number of the act in its source; not a citation", "title_raw": "Title as captured", "title_normalized": "Title in canonical composition", "content_raw": "Text as captured; hashes and offsets are of it",
    "content_normalized": "Text in canonical composition", "content_corrected": "Text after logged repairs, for display", "content_raw_sha256": "SHA-256 of content_raw; null for empty text", "volume_number": "Volume, or unknown", "legal_status": "What words of the text say; no legal force",
    "lexical_references.references": "Matches of citation patterns with their places", "numeric_regions": "Places whose numbers must not be changed", "protected_sections": "Kinds of sections that aren't corrected", "schedules.html_content": "Markup of the schedules as it is",
    "data_quality.flags": "What is wrong with the text", "extraction_risk.detected_risks": "Signs that the page shows less than all", "transformation_log": "What was changed or only flagged, and its risk",
}


def data_dictionary(df: DataFrame, descriptions: dict[str, str] | None = None) -> DataFrame:
    """field, type, description, n_rows and n_filled of each field of df's rows, those of structs by their path.

    Filled are values that aren't null, and lists and maps that aren't empty; one pass with partial counts. Fields
    within lists are described by the type of the list. A table without rows has zeros.
    """
    said = DESCRIPTIONS if descriptions is None else descriptions
    found: list[tuple[str, str, str]] = []

    def walk(fields, path, quoted):
        for f in fields:
            at = f"{quoted}`{f.name}`"
            found.append((path + f.name, f.dataType.simpleString(), at))
            if hasattr(f.dataType, "fields"):
                walk(f.dataType.fields, f"{path}{f.name}.", f"{at}.")

    walk(df.schema.fields, "", "")
    filled = lambda kind, at: (F.size(at) > 0) if kind.startswith(("array", "map")) else F.col(at).isNotNull()
    counts = df.agg(F.count("*").alias("n"), *[F.count(F.when(filled(kind, at), 1)).alias(f"c{i}") for i, (_, kind, at) in enumerate(found)])
    each = [F.struct(F.lit(name).alias("field"), F.lit(kind).alias("type"), F.lit(said.get(name, "")).alias("description"), F.col("n").alias("n_rows"), F.col(f"c{i}").alias("n_filled")) for i, (name, kind, _) in enumerate(found)]
    return counts.select(F.explode(F.array(*each)).alias("x")).select("x.*")


#: What a provenance record must say.
REQUIRED = ("source", "source_url", "scraped_at", "scraping_method", "tool", "tool_version", "language", "research_purpose", "robots_txt_status", "disclaimer")


def provenance(url: Column, at: Column, source: str, tool: str, version: str, language: str = "bn", disclaimer: str = "Publicly available legal texts for academic research; not modified, not interpreted.") -> Column:
    """The provenance record of a capture."""
    said = {"source": source, "scraping_method": "manual page-level extraction", "tool": tool, "tool_version": version, "language": language, "research_purpose": "academic legal corpus construction", "robots_txt_status": "not_present", "disclaimer": disclaimer}
    return F.struct(url.alias("source_url"), at.alias("scraped_at"), at.alias("extracted_at"), *[F.lit(v).alias(k) for k, v in said.items()])


def provenance_errors(record: str, required: tuple[str, ...] = REQUIRED, fields: tuple[str, ...] | None = None) -> Column:
    """The required fields that a record lacks, or has as null or empty text; fields: those that it has, all by default."""
    given = required if fields is None else fields
    lacks = lambda c: F.coalesce(F.col(f"{record}.{c}").cast("string"), F.lit("")) == "" if c in given else F.lit(True)
    return F.array_compact(F.array(*[F.when(lacks(c), F.lit(c)) for c in required]))
