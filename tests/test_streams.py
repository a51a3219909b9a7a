"""Streams that keep state, and stores that change in part: the work queue, the mirror, keyed tables, files of acts."""

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lexloom.operators import queueing
from lexloom.streaming import mirror, queue

SCHEMA = "act_id string, timestamp timestamp, event_id long, reason string, size long"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def attempts(spark, rows):
    return spark.createDataFrame([(a, None if t is None else START + timedelta(seconds=t), e, r, s) for a, t, e, r, s in rows], SCHEMA)


def runs(spark, tmp_path, parts, **options):
    for i, part in enumerate(parts):
        attempts(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = queue.run(spark, f"{tmp_path}/in", SCHEMA, f"{tmp_path}/out", f"{tmp_path}/cp", **options)  # each is a restart
        q.awaitTermination()
    return {r.act_id: (r.status, r.retry_count, r.failure_reason, r.next_retry_delay_ms) for r in queue.states(spark, f"{tmp_path}/out").collect()}


def final(rows, most=3):
    out = {}
    for act in {r[0] for r in rows} - {None}:
        mine = sorted((t, e, r) for a, t, e, r, _ in rows if a == act and t is not None)
        done = max((x[:2] for x in mine if x[2] is None), default=(-1, 0))
        bad = [x for x in mine if x[2] is not None and x[:2] > done]
        n, reason = max(len(bad) - 1, 0), bad[-1][2] if bad else None
        status = "completed" if not bad else "permanent" if reason not in queueing.TRANSIENT else "transient" if n < most else "transient_exhausted"
        out[act] = (status, n, reason, 5000 * 2**n if status == "transient" else None)
    return out


def test_queue_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"a{rng.randrange(12)}", rng.randrange(500), i, rng.choice([None, "dom_timeout", "network_error", "network_error", "act_not_found", "strange"]), 10) for i in range(90)]
    odd = [(None, 3, 1000, "dom_timeout", 1), ("lost", None, 1001, "dom_timeout", None)]
    rng.shuffle(rows)
    got = runs(spark, tmp_path, [rows[:30] + odd, rows[30:60], rows[60:]])
    assert got == final(rows)
    plan = attempts(spark, [r for r in rows if r[3] is not None])
    only_bad = runs(spark, tmp_path / "bad", [[r for r in rows[i::3] if r[3] is not None] for i in range(3)])
    failed = queueing.failures(plan.select("act_id", F.struct("timestamp", "event_id").alias("timestamp"), "reason"), "act_id")
    want = {r.act_id: (r.failure_classification, r.retry_count, r.failure_reason, r.next_retry_delay_ms) for r in queueing.retry_plan(failed, 3).collect()}
    assert only_bad == want
    orders = queue.due(spark, f"{tmp_path}/bad/out").collect()  # all are long past, so that each fell due in its batch
    assert {(r.act_id, r.attempt) for r in orders} >= {(a, n + 2) for a, (s, n, _, _) in want.items() if s == "transient"}
    assert len({(r.act_id, r.attempt, r.due_at) for r in orders}) == len(orders)


def test_retry_fires_when_due(spark, tmp_path):
    now = (datetime.now(timezone.utc) - START).total_seconds()
    attempts(spark, [("soon", now, 1, "dom_timeout", 0), ("later", now + 600, 2, "dom_timeout", 0), ("never", now, 3, "act_not_found", 0)]).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = queue.run(spark, f"{tmp_path}/in", SCHEMA, f"{tmp_path}/out", f"{tmp_path}/cp", base=4000, every="1 second")
    try:
        deadline, fired = time.time() + 90, []
        while time.time() < deadline and not fired:
            time.sleep(1)
            assert q.exception() is None
            if (tmp_path / "out" / "rows").exists():
                fired = queue.due(spark, f"{tmp_path}/out").collect()
    finally:
        q.stop()
    assert [(r.act_id, r.attempt, r.selector_strategy) for r in fired] == [("soon", 2, "broader_selectors")] and fired[0].n > 0
    assert fired[0].due_at == int((START.timestamp() + now) * 1000) + 4000 or abs(fired[0].due_at - ((START.timestamp() + now) * 1000 + 4000)) <= 1


def test_quota_pauses_the_stream(spark, tmp_path):
    for i in range(3):
        attempts(spark, [(f"a{i}", i, i, None, 50)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    go = lambda **o: queue.run(spark, f"{tmp_path}/in", SCHEMA, f"{tmp_path}/out", f"{tmp_path}/cp", size=F.col("size"), quota=100, files=1, **o)
    q = go()
    with pytest.raises(Exception, match=queue.PAUSED):
        q.awaitTermination()
    assert queue.paused(q) and queue.states(spark, f"{tmp_path}/out").count() == 2  # the third would begin at 100 %
    go(freed=60).awaitTermination()
    assert {r.status for r in queue.states(spark, f"{tmp_path}/out").collect()} == {"completed"} and queue.states(spark, f"{tmp_path}/out").count() == 3


ACTS = "act_number string, content_hash string, captured_at int, note string"


def latest(rows):
    out = {}
    for r in rows:
        if r[0] is not None and (r[0] not in out or r[2] >= out[r[0]][2]):
            out[r[0]] = r
    return out


def test_mirror_rewrites_changed_buckets_only(spark, tmp_path):
    rng, out, seen = random.Random(3), str(tmp_path), []
    for n in range(5):
        size = [40, 3, 30, 1, 2][n]
        batch = [(rng.choice([f"a{rng.randrange(30)}", f"a{rng.randrange(30)}", None]), f"h{rng.randrange(3)}", 100 * n + i - 150 * (n == 2), f"{n}") for i in range(size)]
        done = mirror.merge(spark, out, spark.createDataFrame(batch, ACTS), n, buckets=16)
        seen += batch
        assert len(done) <= len({r[0] for r in batch if r[0]}) and {tuple(r) for r in mirror.current(spark, out, ACTS).collect()} == set(latest(seen).values())
        again = mirror.merge(spark, out, spark.createDataFrame(batch, ACTS), n, buckets=16)  # a replay does the same
        assert again == done and {tuple(r) for r in mirror.current(spark, out, ACTS).collect()} == set(latest(seen).values())
    versions = {b: v for b, v in mirror._manifest(spark, out)[0].items()}
    assert mirror.vacuum(spark, out) > 0 and mirror._manifest(spark, out)[0] == versions
    kept = {(int(p.name.split("=")[1]), int(p.parent.name.split("=")[1])) for p in (tmp_path / "data").glob("v=*/lx_bucket=*")}
    assert kept == set(versions.items()) and {tuple(r) for r in mirror.current(spark, out, ACTS).collect()} == set(latest(seen).values())


def test_mirror_of_a_stream(spark, tmp_path):
    put = lambda *rows: spark.createDataFrame(rows, ACTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: mirror.mirrored(spark, f"{tmp_path}/in", ACTS, f"{tmp_path}/out", f"{tmp_path}/cp", buckets=8).awaitTermination()
    put(("1", "a", 1, ""), ("2", "b", 1, ""), ("2", "c", 2, ""), (None, "x", 1, ""))
    run()
    put(("1", "a", 3, ""), ("3", "d", 3, ""), ("2", "e", 3, ""), ("2", "old", 0, ""))
    run()
    now = {r.act_number: (r.content_hash, r.captured_at) for r in mirror.current(spark, f"{tmp_path}/out", ACTS).collect()}
    assert now == {"1": ("a", 3), "2": ("e", 3), "3": ("d", 3)}
    log = {(r.act_number, r.sync_reason, r.v) for r in mirror.log(spark, f"{tmp_path}/out").collect()}
    assert log == {("1", "new", 0), ("2", "new", 0), (None, "invalid_act", 0), ("3", "new", 1), ("2", "content_changed", 1)}


def test_mirror_without_touch_and_without_rows(spark, tmp_path):
    out, rows = str(tmp_path), lambda *r: spark.createDataFrame(list(r), ACTS)
    assert mirror.merge(spark, out, rows(), 0) == [] and mirror.current(spark, out, ACTS).count() == 0
    mirror.merge(spark, out, rows(("1", "a", 1, "")), 1, touch=False)
    assert mirror.merge(spark, out, rows(("1", "a", 2, "")), 2, touch=False) == []
    assert mirror.current(spark, out, ACTS).first().captured_at == 1


def test_keyed_tables(spark, tmp_path):
    from lexloom.sources import keyed

    rows = spark.createDataFrame([(i, f"t{i}", 1) for i in range(200)] + [(None, "none", 1)], "k int, t string, at int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = keyed.write(rows, "keyed_a", "k", 8, f"{tmp_path}/a")
        b = keyed.write(rows.where("k % 3 = 0").withColumnRenamed("t", "u"), "keyed_b", "k", 8, f"{tmp_path}/b")
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't name the buckets
        got = keyed.get(spark, "keyed_a", "k", [5, 7])
        text = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        assert sorted(r.t for r in got.collect()) == ["t5", "t7"] and any(f"SelectedBucketsCount: {n} out of 8" in text for n in (1, 2)), text
        assert keyed.get(spark, "keyed_a", "k", []).count() == 0 and a.count() == 201
        joined = a.join(b.select("k", "u"), "k")
        assert joined.count() == 67 and "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert keyed.lookup(spark, "keyed_a", "k", spark.createDataFrame([(1,), (1,), (None,), (999,)], "k int")).count() == 1
        new = spark.createDataFrame([(5, "new", 2), (6, "older", 0), (500, "more", 1)], "k int, t string, at int")
        keyed.put(spark, "keyed_a", new, "k", "at", 8, f"{tmp_path}/a2")
        assert {r.k: r.t for r in keyed.get(spark, "keyed_a", "k", [5, 6, 500]).collect()} == {5: "new", 6: "t6", 500: "more"}
        with pytest.raises(ValueError):
            keyed.add(spark, "keyed_a", new, "k", "at", 8, f"{tmp_path}/a3")
        keyed.add(spark, "keyed_a", new.where("k = 500").withColumn("k", F.lit(501)), "k", "at", 8, f"{tmp_path}/a4")
        assert spark.table("keyed_a").count() == 203
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("keyed_a", "keyed_b"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_files_of_acts(spark, tmp_path):
    from lexloom.sources import act_files

    path, schema = f"{tmp_path}/acts", "act_number string, content string, url string"
    rows = [("1", "a\nb", None), ("x/../y", "é \"q\"", "u"), ("%", "p", ""), ("_h", "h", None), (".", "dot", None)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    act_files.write(df, path, "act_number", indent=2)
    assert sorted(map(str, (tuple(r)[:3] for r in act_files.read(spark, path, schema).collect()))) == sorted(map(str, rows))
    names = {p.name for p in (tmp_path / "acts").iterdir()}
    assert len(names) == 5 and "1.json" in names and not any(n.startswith(("_", ".")) for n in names)
    assert '"url" : null' in (tmp_path / "acts" / "1.json").read_text() and "\n" in (tmp_path / "acts" / "1.json").read_text()
    act_files.write(spark.createDataFrame([("1", "new", None), ("2", "b", None)], schema), path, "act_number")
    assert {r.act_number: r.content for r in act_files.read(spark, path, schema).collect()}["1"] == "new"
    act_files.write(spark.createDataFrame([("9", "b", None)], schema), path, "act_number", mode="overwrite")
    assert [p.name for p in (tmp_path / "acts").iterdir()] == ["9.json"]
    (tmp_path / "acts" / "bad.json").write_text("{")
    assert sorted((r._corrupt_record or "", r.act_number or "") for r in act_files.read(spark, path, schema).collect()) == [("", "9"), ("{", "")]
    for wrong in ([("1", "a", None), ("1", "b", None)], [(None, "a", None)], [("", "a", None)]):
        with pytest.raises(ValueError):
            act_files.write(spark.createDataFrame(wrong, schema), path, "act_number")


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    from lexloom.sources import act_files

    fails = F.udf(lambda x: 1 // (x - 150))
    rows = spark.range(300).repartition(3).select(F.col("id").alias("act_number"), F.when(F.col("id") == 150, fails("id")).alias("c"))
    with pytest.raises(Exception):
        act_files.write(rows, f"{tmp_path}/acts", "act_number")
    seen = [*(tmp_path / "acts").glob("*")]
    assert all(p.name.startswith("_") for p in seen)  # a task that was still running may have left its folder
    act_files.clean(f"{tmp_path}/acts")
    assert not [*(tmp_path / "acts").glob("*")]


def test_history_in_any_order(spark, tmp_path):
    from lexloom.operators import manifest

    rng, out = random.Random(6), str(tmp_path)
    rows = [(rng.choice([f"a{rng.randrange(9)}", f"a{rng.randrange(9)}", None]), f"h{i % 50}", rng.randrange(40), "") for i in range(120)]
    for n in range(4):
        part = spark.createDataFrame(rows[30 * n : 30 * n + 30] + rows[:3], ACTS)  # captures that came before come again
        done = mirror.merge_history(spark, out, part, n, buckets=8)
        assert done == mirror.merge_history(spark, out, part, n, buckets=8) and len(done) <= 8
    want = manifest.history(spark.createDataFrame(rows, ACTS).where("act_number is not null").distinct(), "act_number", "captured_at", "content_hash")
    got = mirror.history_of(spark, out, ACTS)
    plain = lambda df: sorted(map(str, df.select("act_number", "content_hash", "captured_at", "archived_at", "is_current").collect()))
    assert plain(got) == plain(want) and got.count() == got.select("act_number", "version").distinct().count()
    touched = mirror.merge_history(spark, out, spark.createDataFrame([("a1", "late", 5, "")], ACTS), 4, buckets=8)
    assert len(touched) == 1 and mirror.history_of(spark, out, ACTS).count() == got.count() + 1


def test_intents_in_any_order(spark, tmp_path):
    from lexloom.operators import recovery
    from lexloom.streaming import intents

    schema = "entry_id string, act_id string, entry_type string, timestamp timestamp, pruned boolean"
    rng = random.Random(9)
    rows = [(f"e{i:03}", rng.choice([f"a{rng.randrange(25)}", f"a{rng.randrange(25)}", None]), rng.choice(["intent", "intent", "intent", "complete", "other"]), START + timedelta(seconds=rng.randrange(30)), rng.choice([True, False, None])) for i in range(70)]
    for part in (rows[:25], rows[25:60], rows[60:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        intents.run(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {(r.act_id, r.timestamp, r.entry_id) for r in intents.open_intents(spark, f"{tmp_path}/out").collect()}
    want = {(r.act_id, r.timestamp, r.entry_id) for r in recovery.incomplete(spark.createDataFrame(rows, schema), tie="entry_id").collect() if r.act_id is not None}
    assert got == want and got


def test_audit_contexts(spark):
    from lexloom.operators import audit

    rows = [("write_attempt", '{"a": {"b": 7}, "s": "x"}'), ("odd", '{"a": {"b": "7"}}'), ("", "{}"), (None, None), ("read_success", "no json"), ("read_success", '{"a": [1, 2], "ok": true}')]
    log = audit.typed(spark.createDataFrame(rows, "operation string, context string"))
    good, bad = audit.split(log)
    assert [r.verdict for r in audit.checked(log).collect()] == ["accepted", "accepted_unknown", "rejected", "rejected", "accepted", "accepted"]
    assert (good.count(), bad.count()) == (4, 2)
    assert [r.operation for r in audit.where(log, {"$.a.b": 7, "$.s": "x"}).collect()] == ["write_attempt"]
    assert audit.where(log, {"$.ok": True}).count() == 1 and log.select(audit.value("$.a[1]", "int").alias("v")).where("v = 2").count() == 1
    typed = audit.typed(spark.createDataFrame([({"k": "v"},), (None,)], "context map<string,string>"))
    assert audit.where(typed, {"$.k": "v"}).count() == 1
