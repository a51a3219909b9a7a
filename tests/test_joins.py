"""Interval and contains joins against their definitions, and plans that pair nothing in vain."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import contains, intervals


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark, seed):
    rng = random.Random(seed)
    length = lambda: rng.choice([1, 5, 64, 65, 700, 5000, 100000])
    regions = [(rng.choice("ab"), s, s + length(), i) for i, s in enumerate(rng.randrange(-300, 6000) for _ in range(60))]
    regions += [("a", 5, 5, 900), ("a", 9, 3, 901), ("a", None, 3, 902), (None, 1, 9, 903), ("b", 1, None, 904)]
    points = [(rng.choice("abc"), rng.randrange(-400, 7000)) for _ in range(150)] + [("a", None), (None, 5), ("a", 6), ("a", 6)]
    return regions, points, spark.createDataFrame(regions, "k string, start long, `end` long, n int"), spark.createDataFrame(points, "k string, position int")


@pytest.mark.parametrize("seed", [1, 2])
def test_covering(spark, seed):
    regions, points, r, p = tables(spark, seed)
    found = intervals.covering(p, r, "k")
    good = [x for x in regions if None not in x]
    want = sorted((k, at, s, e, n) for k, at in points if at is not None for rk, s, e, n in good if rk == k and s <= at < e)
    assert sorted(map(tuple, found.collect())) == want
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    got = {(x.k, x.position): x.inside for x in intervals.inside(p, r, "k").collect()}
    assert got == {(k, at): any(w[:2] == (k, at) for w in want) for k, at in set(points)}


@pytest.mark.parametrize("seed", [1, 2])
def test_overlapping(spark, seed):
    regions, _, r, _ = tables(spark, seed)
    other = r.sample(0.5, seed=3).cache()
    found = intervals.overlapping(r, other, "k")
    whole = lambda rows: [tuple(x) for x in rows if None not in tuple(x) and x[1] < x[2]]
    want = sorted((*a, b[1], b[2]) for a in whole(regions) for b in whole(other.collect()) if a[0] == b[0] and a[1] < b[2] and b[1] < a[2])
    assert sorted(map(tuple, found.collect())) == want
    assert "NestedLoop" not in plan(found)


def test_long_regions_make_few_cells(spark):
    r = spark.createDataFrame([("a", i, i + 3 * 10**8) for i in range(50)], "k string, start long, `end` long")
    p = spark.createDataFrame([("a", 10**8)], "k string, position long")
    assert intervals.covering(p, r, "k").count() == 50
    placed = intervals._own_cells(intervals._placed(r, "start", "end"), "start", "end")
    assert placed.count() <= 100
    assert intervals.overlapping(r, r.limit(1), "k").count() == 50


def test_anchored_points(spark):
    rng = random.Random(7)
    spans = [("a", 10, 50, "s1"), ("a", 50, 400, "s2"), ("b", 0, 90, "s3")]
    marks = [(rng.choice("ab"), at, f"m{at}") for at in rng.sample(range(0, 450), 40)]
    points = [(rng.choice("abc"), rng.randrange(0, 450)) for _ in range(80)]
    got = intervals.anchored(spark.createDataFrame(points, "k string, position int"), spark.createDataFrame(spans, "k string, content_start int, content_end int, section string"), spark.createDataFrame(marks, "k string, marker_offset int, marker string"), "k")
    want = []
    for k, at in points:
        for sk, s, e, name in spans:
            if sk == k and s <= at < e:
                before = [(o, m) for mk, o, m in marks if mk == k and s <= o < e and o <= at]
                want.append((k, at, s, e, name, max(before)[1] if before else None))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_contains(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "c", "dd", "ee", "the"])
    texts = [(i, " ".join(word() for _ in range(rng.randrange(60))).replace("c dd", "c\ndd")) for i in range(60)] + [(60, None), (61, ""), (None, "a b c"), (3, "the b the dd the")]
    lines = [(i, " ".join(word() for _ in range(rng.randrange(1, 6)))) for i in range(60)] + [(70, None), (71, ""), (None, "a b c"), (72, "e the d"), (73, "x a x"), (74, " b the "), (75, "b the dd t")]
    t, l = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(lines, "line_id int, line string")
    full = {(i, j) for i, x in texts for j, y in lines if None not in (i, x, j, y) and y in x}
    found = contains.pairs(t, l)
    long = {j for j, y in lines if y is not None and len(y.split()) >= 3}
    assert {tuple(r) for r in found.collect()} == {p for p in full if p[1] in long} and found.count() > 10
    by = contains.pairs(t.withColumn("g", F.col("doc_id") % 2), l.withColumn("g", F.col("line_id") % 2), by=["g"])
    assert {(r.doc_id, r.line_id) for r in by.collect()} == {(i, j) for i, j in full if i % 2 == j % 2}
    assert contains.pairs(t.limit(0), l).count() == 0 and contains.pairs(t, l.limit(0)).count() == 0
