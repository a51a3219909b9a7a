"""Queue, duplicates, sync, recovery, manifest, pages, exports and streams on small tables."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions import dom
from lexloom.operators import acts, export, html, manifest, queueing, recovery, sync, urls
from lexloom.sources import files
from lexloom.streaming import capture


def test_queue_add(spark):
    df = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4), (None, 5), ("a", 6)], "k string, n int")
    out = queueing.add(batch, df("a", "a"), df("c"), "k", "n")
    assert [r.outcome for r in out.orderBy("n").collect()] == ["skipped_in_queue", "added", "skipped_in_queue", "skipped_captured", "invalid", "skipped_in_queue"]
    assert queueing.outcome_counts(out).first() == (1, 3, 1)


def test_failures_and_retries(spark):
    a = spark.createDataFrame([(1, 1, "network_error"), (1, 2, "dom_timeout"), (2, 1, "act_not_found"), (3, 1, "new")], "k int, timestamp int, reason string")
    f = queueing.failures(a, "k")
    plan = {r.k: r for r in queueing.retry_plan(f, 3).collect()}
    assert (plan[1].retry_count, plan[1].failure_classification, plan[1].next_retry_delay_ms) == (1, "transient", 10000)
    assert plan[2].failure_classification == plan[3].failure_classification == "permanent"
    assert {r.k: r.failure_classification for r in queueing.retry_plan(f, 1).collect()}[1] == "transient_exhausted"
    assert queueing.retry_stats(queueing.retry_plan(f, 3)).first() == (3, 1, 2)


def test_validation_and_tabs(spark):
    v = lambda *a: queueing.validation(*[F.lit(x) for x in a])
    r = spark.range(1).select(v(False, "boom", True, "x"), v(True, "", False, ""), v(True, "", True, ""), v(True, "", True, "x"), v(True, "", True, "x" * 100)).first()
    assert list(r) == ["boom", "container_not_found", "content_empty", "content_below_threshold", None]
    t = lambda u, x, d=False: queueing.tab_failure(F.lit(u), F.lit(x), F.lit(d))
    r = spark.range(1).select(t("", ""), t("http://a/", "404"), t("http://a/", "Gateway Timeout"), t("http://a/not-found", "ok"), t("http://a/not-found", "ok", True), t("http://a/", "An error")).first()
    assert list(r) == ["site_unavailable", "act_not_found", "site_unavailable", "act_not_found", None, "site_unavailable"]


def test_settings_and_readiness(spark):
    r = spark.range(1).select(queueing.setting("max_retry_attempts", F.lit(9)), queueing.setting("extraction_delay_ms", F.lit(None).cast("int")), queueing.retry_delay(F.lit(3))).first()
    assert list(r) == [5, 3000, 20000]
    d = lambda state, ms, title, n, sig: queueing.readiness(F.lit(state), F.lit(ms), {"act_title": F.lit(title)}, F.lit(n), F.lit(sig))
    r = spark.range(1).select(d("complete", 0, True, 0, False), d("loading", 0, True, 0, True), d("complete", 40000, True, 0, True), d("complete", 0, False, 100, True)).first()
    assert [(x.ready, x.reason, x.signal_type, x.should_wait) for x in r] == [(True, None, "act_title", False), (False, None, None, True), (False, "content_selector_mismatch", None, False), (True, None, "content_threshold_with_signal", False)]


def test_language_duplicates(spark):
    old = spark.createDataFrame([("1", "english"), ("2", "bengali"), ("3", None)], "k string, content_language string")
    new = spark.createDataFrame([("1", "bengali"), ("2", "english"), ("3", "english"), ("4", "english")], "k string, content_language string")
    got = {r.k: (r.is_duplicate, r.replace_existing, r.allow_extraction) for r in sync.language_duplicates(new, old, "k").collect()}
    assert got == {"1": (True, True, True), "2": (True, False, False), "3": (True, False, False), "4": (False, False, True)}


def test_sync(spark):
    new = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None), ("", "x"), ("5", "n")], "act_number string, content_hash string")
    old = spark.createDataFrame([("1", "a"), ("2", "z"), ("3", "c")], "act_number string, content_hash string")
    assert {r.act_number: r.sync_reason for r in sync.changed(new, old).collect()} == {"1": "unchanged", "2": "content_changed", "3": "metadata_changed", "": "invalid_act", "5": "new"}
    u = sync.upsert(old.withColumn("at", F.lit(1)), new.withColumn("at", F.lit(1)), "act_number", "at")
    assert {r.act_number: r.content_hash for r in u.collect()}["2"] == "b"
    s = spark.range(1).select(sync.status(F.lit(True), F.lit("f"), F.lit("denied"), F.lit(None).cast("string"), F.lit(False)).alias("s")).first().s
    assert (s.label, s.paused) == ("Permission lost", True)


def test_recovery(spark):
    acts = spark.createDataFrame([("1", "abc"), ("2", "")], "k string, c string")
    r = recovery.receipt(acts, "k", "c", F.lit("2024-01-01").cast("timestamp"))
    assert r.count() == 1 and r.withColumn("e", recovery.receipt_errors()).first().e == []
    assert [x.outcome for x in recovery.write_outcomes(acts, r, "k", "c").orderBy("k").collect()] == ["persisted", "integrity_error"]
    wal = spark.createDataFrame([("e1", "1", "intent", 1, None), ("e2", "1", "intent", 2, None), ("e3", "2", "intent", 3, None), ("e4", "2", "complete", 1, "a" * 64), ("e5", "3", "complete", 4, "short")], "entry_id string, act_id string, entry_type string, timestamp int, content_hash string")
    assert [x.entry_id for x in recovery.incomplete(wal).collect()] == ["e2"] and recovery.wal_entries(wal).count() == 4
    q = spark.createDataFrame([("1", "pending"), ("2", "done"), ("3", "processing")], "k string, status string")
    rec = recovery.reconstructed(recovery.reset_processing(q), spark.createDataFrame([("1",), ("9",), ("9",)], "k string"), "k")
    assert recovery.reconstruction_stats(rec).first() == (4, 2, 2, 1, 1)


def test_storage_errors(spark):
    e = lambda m, n="": recovery.storage_error(F.lit(m), F.lit(n))
    r = spark.range(1).select(e("Quota hit"), e("", "SecurityError"), e("IndexedDB unavailable"), e("database blocked"), e("commit failed"), e("hash differs"), e(None)).first()
    assert list(r) == ["quota_exceeded", "permission_denied", "backend_unavailable", "backend_unavailable", "transaction_failed", "integrity_error", "unknown_error"]


def test_manifest(spark):
    a = spark.createDataFrame([("1", "v1", 10, 1), ("2", "unknown", 5, 3)], "k string, volume_number string, content_length int, at int")
    assert manifest.stats(a, at="at").first() == (2, 1, 15, 1, 3)
    none = spark.createDataFrame([], "k string")
    assert manifest.coverage(none, none, "k").first().coverage_percent == 100
    h = manifest.history(spark.createDataFrame([("a", 1, 0), ("a", 2, 1)], "k string, at int, t int"), "k", "at", "t").orderBy("at").collect()
    assert [(r.version, r.archived_at, r.is_current) for r in h] == [(1, 2, False), (2, None, True)]
    log = spark.createDataFrame([(i, i % 3, "x") for i in range(30)], "log_id int, timestamp int, operation string")
    assert [r.log_id for r in manifest.tail(log, 3, ["log_id"]).collect()] == [27, 28, 29]
    p = manifest.export_progress(spark.createDataFrame([("1",), ("2",), ("3",)], "k string"), spark.createDataFrame([("1", "failed"), ("1", "exported"), ("2", "failed")], "k string, status string"), "k").first()
    assert p == (3, 1, 1, 1, 67)


def test_addresses(spark):
    s = urls.LEGAL_SITE
    df = spark.createDataFrame([(u,) for u in ("http://bdlaws.minlaw.gov.bd/act-details-12.html", "http://bdlaws.minlaw.gov.bd/act-12.html", "http://bdlaws.minlaw.gov.bd/volume-3.html?x=1", "http://evil.org/act-12.html", None)], "u string")
    kinds = [r.t for r in df.select(urls.page_type(F.col("u"), s).alias("t")).collect()]
    assert kinds == ["act_details", "act_summary", "volume", "invalid_domain", "invalid_domain"]
    r = spark.range(1).select(urls.layer(F.lit("volume"), s), urls.label(F.lit("act_details")), urls.is_document(F.lit("HTTP://BDLAWS.minlaw.gov.bd/ACT-5.html"), s), urls.absolute(F.lit("/a"), s.base), urls.absolute(F.lit("//h/a"), s.base), urls.number(F.lit("x"), s.volume, "unknown")).first()
    assert list(r) == [2, "Act Details", True, s.base + "/a", "http://h/a", "unknown"]


PAGE = """<html><head><title> The &amp; Act </title></head><body><nav>menu</nav>
<a href="/act-12.html">Act of 1950</a><a href='act-details-12.html'>Longer Act of 1951</a><a href="/x">12</a>
<div class="lineremoves"><div class="txt-head">1. Short</div><div class="txt-details">Body <b>one</b><table><tr><td>x</td></tr></table></div></div>
<table id="t"><tr><td rowspan="2">A</td><td>B</td></tr><tr><td>C</td></tr></table></body></html>"""


def test_pages(spark):
    p = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id int, html string")
    found = html.links(p)
    assert [(r.link_at, r.href, r.title) for r in found.orderBy("link_at").collect()] == [(0, "/act-12.html", "Act of 1950"), (1, "act-details-12.html", "Longer Act of 1951"), (2, "/x", "12")]
    v = html.volume_links(found, urls.LEGAL_SITE)
    assert [(r.act_number, r.year, r.url) for r in v.orderBy("link_at").collect()] == [("12", y, "http://bdlaws.minlaw.gov.bd/act-details-12.html") for y in ("1950", "1951")]
    assert [r.title for r in html.catalog(v, "act_number").collect()] == ["Longer Act of 1951"]
    assert [r.t for r in p.select(html.tag_text(F.col("html"), "title").alias("t")).collect()] == ["The & Act", None, None]
    s = html.section_rows(p, ".lineremoves", ".txt-head", ".txt-details").collect()
    assert [(r.title, r.has_table) for r in s] == [("1. Short", True)] and s[0].body.startswith("Body one")
    t = html.tables(p, selector="#t").first()
    assert (t.data, t.has_merged_cells, t.row_count, t.col_count) == ([["A", "B"], ["", "C"]], True, 2, 2)
    x = {r.page_id: r for r in html.extract(p, ["#none", ".txt-details"], ["main"], ["nav"]).collect()}
    assert (x[1].method, x[1].selector, len(x[1].attempts)) == ("primary", ".txt-details", 2) and not x[2].extraction_success
    assert html.noise_free(F.lit("Top")) is not None
    assert [a.text() for a in dom.select(dom.parse(PAGE), "a[href*=act-], nav")] == ["menu", "Act of 1950", "Longer Act of 1951"]


def test_exports(spark, tmp_path):
    d = spark.createDataFrame([("1", "আইন", "Act V of 1898 [1]", "u", None)], "act_number string, title string, content_raw string, url string, volume_number string")
    e = export.act(d)
    r = e.first()
    assert r.volume_number == "unknown" and r.editorial_content_present and r.identifiers.internal_id == "1" and r.marker_frequency["ধারা"]["count"] == 0
    files.write_by_volume(e, str(tmp_path / "acts"))
    back = files.acts(spark, str(tmp_path / "acts")).select("content_raw", "content_raw_sha256").first()
    assert back.content_raw == "Act V of 1898 [1]" and back.content_raw_sha256 == r.content_raw_sha256
    both = export.corpus(d, spark.createDataFrame([("2", "dom_timeout")], "act_number string, failure_reason string"))
    assert export.corpus_header(both).first() == (2, 1, 1)
    bad = export.errors(both, ["act_number", "title"]).orderBy("act_number").collect()
    assert [x.valid for x in bad] == [True, False] and bad[1].errors == ["missing title"]
    j = spark.range(1).select(export.json_valid(F.lit('{"a": 1}')), export.json_valid(F.lit("[1]")), export.json_valid(F.lit("{")), export.json_valid(F.lit(None).cast("string"))).first()
    assert list(j) == [True, False, False, False]
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    n = spark.range(1).select(export.file_name("act", F.lit(' a/b:"c '), at), export.file_name("volume", F.lit("?*"), at), export.file_name("act", F.lit(None).cast("string"), at)).first()
    assert list(n) == ["corpus_act_abc_20240102_030405.json", "corpus_volume_unknown_20240102_030405.json", "corpus_act_unknown_20240102_030405.json"]
    cleaned = export.act(spark.createDataFrame([("1", "t", "say æhiæ", "u", "v"), ("2", "t", None, "u", "")], "act_number string, title string, content_raw string, url string, volume_number string"), clean=True)
    one_, two = cleaned.orderBy("identifiers.internal_id").collect()
    assert one_.content_corrected == 'say "hi"' and one_.content_raw == "say æhiæ" and "cleaning_applied" in one_.data_quality.flags
    assert (two.content_raw, two.content_raw_sha256, two.volume_number, two.lexical_references["count"]) == ("", None, "unknown", 0)
    one = spark.createDataFrame([("v", 3, None)], "volume_number string, content_length int, at timestamp")
    docs = {x.name: x.content for x in export.documents(manifest.stats(one, at="at"), 'The "Laws"', licence="CC0", authors=("A",)).collect()}
    assert "| Acts | 1 |" in docs["README.md"] and "Not computed." in docs["README.md"] and "unknown to unknown" in docs["README.md"] and 'title: "The \\"Laws\\""' in docs["CITATION.cff"] and 'authors:\n- name: "A"' in docs["CITATION.cff"]
    fields = {r.field: (r.n_rows, r.n_filled) for r in export.data_dictionary(cleaned).collect()}
    assert fields["content_raw_sha256"] == (2, 1) and fields["transformation_log"] == (2, 1) and fields["data_quality.completeness"] == (2, 2)
    log = {r.identifiers.internal_id: (r.transformation_log, r.formatting_scope) for r in (one_, two)}
    assert [(x.transformation_type, x.original, x.corrected, x.risk_level, x.applied) for x in log["1"][0]] == [("encoding_fix", "Corrupted quotation mark", '"', "non-semantic", True)] and log["1"][1] == "presentation_only" and log["2"] == ([], None)


def test_logs(spark, tmp_path):
    log = spark.createDataFrame([(1, "save"), (2, "load")], "log_id bigint, operation string")
    files.append_log(log, str(tmp_path / "log"))
    files.append_log(log, str(tmp_path / "log"))
    assert files.log(spark, str(tmp_path / "log")).count() == 4
    assert files.read_or_empty(spark, str(tmp_path / "none"), files.WAL).count() == 0


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "x" * 120), (2, "short"), (3, None)], "id int, content string").write.parquet(str(src))
    args = (spark, str(src), "id int, content string", "id", "content", str(tmp_path / "out"), str(tmp_path / "check"))
    capture.capture(*args).awaitTermination()
    spark.createDataFrame([(4, "y" * 120)], "id int, content string").write.mode("append").parquet(str(src))
    capture.capture(*args).awaitTermination()
    assert {r.id for r in spark.read.parquet(str(tmp_path / "out/acts")).collect()} == {1, 4}
    assert {r.reason for r in spark.read.parquet(str(tmp_path / "out/failed")).collect()} == {"content_below_threshold", "container_not_found"}
    assert spark.read.parquet(str(tmp_path / "out/receipts")).count() == 2


LAW = """<html><head><title>The Sea Act - bdlaws</title></head><body><nav>menu ধারা</nav><div class="boxed-layout">
<div class="bg-act-section"> Act No. V </div><div class="act-role-style">An Act for the sea</div><p class="lineremove">যেহেতু sea</p>
<div class="lineremoves"><div class="col-sm-3 txt-head">Short title ১৷</div><div class="col-sm-9 txt-details">(১) See <a href="/act-details-12.html">Act V of 1898</a> (ক) and Act X of 1900<table><tr><td colspan=2>a</td></tr><tr><td>b</td><td>c</td></tr></table></div></div>
<div class="lineremoves"><div class="col-sm-3 txt-head">No number</div><div class="col-sm-9 txt-details">Top
প্রিন্ট ভিউ
rest</div></div></div><footer>ধারা</footer></body></html>"""


def test_act_content(spark):
    """Section rows, else selectors, fallback, head matter and the body, for which a legal signal is needed."""
    pages = [LAW, "<body><article>in the article<div class=schedule>List</div></article></body>", "<body><div class=act-meta>only meta</div></body>", "<body><nav>ধারা</nav>plain</body>", "<body><p>ধারা ১</p><script>x</script></body>", "<h1>Title</h1><div id=lawContent>Copyright © 2020 text</div>", "", None]
    r = acts.act_content(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")).orderBy("page_id").collect()
    assert [(x.method, x.selector, x.extraction_success) for x in r] == [("structured", ".boxed-layout", True), ("fallback", "article", True), ("meta", ".act-meta", True), ("body_fallback", "body", False), ("body_fallback", "body", True), ("primary", "#lawContent", True), (None, None, False), (None, None, False)]
    law = r[0]
    assert (law.title, law.metadata) == ("The Sea Act", "Act No. V") and law.content.startswith("Act No. V\n\nAn Act for the sea\n\nযেহেতু sea\n\nShort title ১৷\n(১) See Act V of 1898")
    assert [(s.dom_index, s.section_title, s.has_table) for s in law.sections] == [(0, "Short title ১৷", True), (1, "No number", False)] and law.sections[1].section_body == "rest"
    assert [(t.section_index, t.data, t.has_merged_cells) for t in law.tables] == [(0, [["a", ""], ["b", "c"]], True)]
    assert r[1].content == "in the articleList" and r[5].content == "text" and r[5].title == "Title" and [a.selector for a in r[5].attempts] == ["#lawContent"]
    wider = acts.act_content(spark.createDataFrame([(1, "<main>the main part</main>")], "page_id int, html string"), broader=True).first()
    assert (wider.method, wider.selector, len(wider.attempts)) == ("broader", "main", 14) and acts.strategy(True) == "broader_selectors"


def test_references_of_a_page(spark):
    read = acts.act_content(spark.createDataFrame([(1, LAW), (2, None)], "page_id int, html string"))
    refs = acts.references(read, "page_id").orderBy("position").collect()
    content = read.where("page_id = 1").first().content
    assert [(x.citation_text, x.source, x.act_id, x.scope.section_number, x.scope.subsection, x.scope.clause) for x in refs] == [("Act V of 1898", "link", "12", "১৷", "(১)", None), ("Act X of 1900", "pattern", None, "১৷", "(১)", "(ক)")]
    assert all(content[x.position :].startswith(x.citation_text) for x in refs)
    d = {x.page_id: x for x in acts.derived(read).collect()}
    assert (d[1].structure.total_sections, d[1].structure.total_subsections, d[1].structure.total_clauses, d[1].unchanged) == (2, 1, 1, True) and len(d[1].cross_references) == 2
    assert d[2].structure is None and d[2].cross_references == []
    assert [(s.section_number, s.heading) for s in d[1].structure.sections] == [("১৷", "Short title"), (None, "No number")]
    m = {x.page_id: x for x in acts.marked_content(spark.createDataFrame([(1, LAW)], "page_id int, html string")).collect()}[1]
    assert m.has_preamble and not m.has_enactment and m.marker_frequency["ধারা"]["count"] == 1 and m.schedule_tables == 1


def test_a_page_is_read_once(spark):
    """Every field of a page that is made by a grouping comes from one call of the page's reader."""
    parts = spark.createDataFrame([(1, LAW[:40]), (1, LAW[40:])], "page_id int, part string")
    made = parts.groupBy("page_id").agg(F.array_join(F.collect_list("part"), "").alias("html"))
    few = acts.derived(acts.act_content(made)).select("page_id", "structure.total_sections", F.size("cross_references"), "unchanged")
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1 and plan.count("run(") == 1


def test_years_and_order(spark):
    t = spark.createDataFrame([("10", "Act, 1950 (২০০১)"), ("9", "আইন ১৯৭৩"), ("x", "Act 3000"), ("2", "Act 1899 of 2020")], "act_number string, title string")
    r = html.by_number(t.withColumn("year", html.year_of(F.col("title")))).collect()
    assert [(x.act_number, x.year) for x in r] == [("2", "2020"), ("9", "১৯৭৩"), ("10", "1950"), ("x", "")]
    assert [x.act_number for x in html.chronological(t.withColumn("year", html.year_of(F.col("title")))).collect()][:2] == ["2", "10"]
    assert len(html.alphabetical(t).collect()) == 4


def test_years_within_numbers(spark):
    t = spark.createDataFrame([(1, "Act 120190 (1999)"), (2, "Act 000001900"), (3, "আইন ১২০১৯০"), (4, "2001")], "k int, title string")
    years = lambda whole: [x.year for x in t.select("k", html.year_of(F.col("title"), whole).alias("year")).orderBy("k").collect()]
    assert years(True) == ["1999", "", "", "2001"] and years(False) == ["2019", "1900", "২০১৯", "2001"]


def test_noise_goes(spark):
    text = "Top\nপ্রিন্ট ভিউআইন Top\nCopyright © 2024 x Legislative and Parliamentary Affairs Division\n \t"
    assert spark.range(1).select(html.noise_free(F.lit(text)).alias("t")).first().t == "আইন Top\n x"


def test_corpus_errors(spark):
    rows = spark.createDataFrame([("1", "t", None, None, None, None, "c", "{}", "v"), ("2", "t", "failed", None, "", None, None, None, None), ("3", None, None, "x", None, None, None, None, "v"), ("4", "t", "failed", "x", "r", 2, None, None, None)], "act_number string, title string, extraction_status string, content_raw string, failure_reason string, attempts int, content string, marker_frequency string, volume_number string")
    got = [r.errors for r in export.corpus_errors(rows).orderBy("act_number").collect()]
    assert got == [[], ["failed act missing failure_reason", "failed act missing attempts count"], ["title is not a string", "content is not a string", "marker_frequency is not an object"], ["failed act should have content_raw as null"]]


def test_receipts_are_of_what_was_read_back(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "x" * 120)], "id int, content string").write.parquet(str(src))
    capture.capture(spark, str(src), "id int, content string", "id", "content", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    r = spark.read.parquet(str(tmp_path / "out/receipts")).first()
    assert r.persisted_at.year > 2000 and r.content_raw_sha256 == spark.range(1).select(F.sha2(F.lit("x" * 120), 256)).first()[0]
    assert spark.read.parquet(str(tmp_path / "out/integrity_errors")).count() == 0


@pytest.mark.parametrize("kind", ["receipts", "sessions"])
def test_streams_of_logs(spark, tmp_path, kind):
    if kind == "receipts":
        spark.createDataFrame([("a", 0), ("a", 1), ("b", 2)], "receipt_id string, t int").select("receipt_id", F.timestamp_seconds("t").alias("persisted_at")).write.parquet(str(tmp_path / "in"))
        out = capture.distinct_receipts(spark.readStream.schema("receipt_id string, persisted_at timestamp").parquet(str(tmp_path / "in")))
    else:
        spark.createDataFrame([("x", 0), ("x", 60), ("x", 90000), ("y", 10)], "operation string, t int").select("operation", F.timestamp_seconds("t").alias("timestamp")).write.parquet(str(tmp_path / "in"))
        out = capture.sessions(spark.readStream.schema("operation string, timestamp timestamp").parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName(f"seen_{kind}").option("checkpointLocation", str(tmp_path / "c")).outputMode("append" if kind == "receipts" else "complete").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table(f"seen_{kind}").collect()
    assert len(rows) == 2 if kind == "receipts" else sorted(r.n for r in rows) == [1, 1, 2]


def test_running_totals_by_blocks(spark):
    d = spark.createDataFrame([(i, "a" if i % 3 else "b", i) for i in range(200)] + [(5, "a", 7)], "id long, g string, n long")
    for group in ("g", None):
        got = {(r.id, r.g, r.n): r.used for r in manifest.running_usage(d, group, ["id", "n"], "n", 10**6, blocks=8).collect()}
        used = {}
        for r in sorted(d.collect(), key=lambda r: (r.id, r.n)):
            used[r.g if group else 0] = used.get(r.g if group else 0, 0) + r.n
            assert got[r.id, r.g, r.n] == used[r.g if group else 0]
    assert manifest.running_usage(d.limit(0), "g", ["id"], "n", 1).count() == 0
    assert manifest.running_usage(d, "g", ["g", "id"], "n", 1).count() == 201
