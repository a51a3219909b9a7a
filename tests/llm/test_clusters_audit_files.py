"""Centroid clustering, the filter audit and token files against brute force."""

import hashlib
import itertools
import math
import random
import re
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import centroid_clustering, filter_audit, token_files
from lexloom.llm._shared import shared_dir
from lexloom.llm.packing import tokenizer_path
from lexloom.llm.queries import QUERIES

from ..compare import sql
from .test_operators import docs, odd

# ---- centroid clustering


def brute_clusters(rows, k, rounds, size, scale=64):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    cent = [v for _, v in sorted(kept, key=key)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for i in range(rounds + 1):
        mine = [min(range(len(cent)), key=lambda j: (dist(v, cent[j]), j)) for _, v in kept]
        if i < rounds:
            for j in set(mine):
                group = [v for (_, v), m in zip(kept, mine) if m == j]
                cent[j] = [sum(c) // len(group) for c in zip(*group)]
    return sorted(((i, m, dist(v, cent[m])) for (i, v), m in zip(kept, mine)), key=str), cent


@pytest.mark.parametrize("kind", ["spread", "grid", "copies", "few"])
def test_clusters_as_by_brute_force(spark, kind):
    rng = random.Random(kind)
    n, size = {"few": 3}.get(kind, 300), 4
    draw = {"spread": lambda: rng.gauss(0, 1), "grid": lambda: rng.randrange(-2, 3) / 64, "copies": lambda: rng.choice([0.5, -0.5]), "few": lambda: rng.random()}[kind]
    rows = [(rng.choice([i, i, i, 7]), [draw() for _ in range(size)]) for i in range(n)]
    rows += [(None, [0.1] * size), (n, None), (n + 1, []), (n + 2, [0.1] * 5), (n + 3, [0.1, None, 0.1, 0.1]), (n + 4, [math.nan, 0.0, 0.0, 0.0]), (n + 5, [math.inf, 0.0, 0.0, 0.0]), (n + 6, [0.25] * size)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("clash"), "v": F.lit(1), "a": F.lit(2)}).repartition(3)
    found, cent = centroid_clustering.cluster(df, clusters=8, size=size)
    want, want_cent = brute_clusters(rows, 8, 3, size)
    got = found.collect()
    assert cent.tolist() == want_cent
    assert sorted(((r.id, r.cluster, r.distance) for r in got), key=str) == want
    if kind == "spread":  # bounds spare distances: 4 rounds of 8 centroids are 32 for each vector
        assert sum(r.computed for r in got) < 0.75 * 32 * len(got)


def test_clusters_described(spark):
    rows = [(i, [i % 5 / 8.0, i % 3 / 8.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found, cent = centroid_clustering.cluster(df, clusters=4, size=2)
    r = centroid_clustering.described(found, cent).collect()
    for j in range(4):
        mine = [x for x in r if x.cluster == j]
        assert {x.cluster_inertia for x in mine} <= {sum(x.distance for x in mine)}
        assert {x.centroid_sha256 for x in mine} <= {hashlib.sha256(",".join(map(str, cent[j])).encode()).hexdigest()}
    assert {x.inertia for x in r} == {sum(x.distance for x in r)}


def test_clusters_of_nothing_and_of_large_numbers(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    for df in (none, none.limit(0)):
        found = centroid_clustering.described(*centroid_clustering.cluster(df))
        assert found.count() == 0 and found.columns == ["id", "cluster", "distance", "computed", "cluster_inertia", "inertia", "centroid_sha256"]
    far = spark.createDataFrame([(1, [-2.0**21] * 64), (2, [2.0**21] * 64), (3, [2.0**21 - 1] * 64)], "vec_id long, embedding array<double>")
    got = centroid_clustering.cluster(far, clusters=1)[0].collect()
    assert sorted((r.id, r.cluster, r.distance) for r in got) == brute_clusters([(r.vec_id, r.embedding) for r in far.collect()], 1, 3, 64)[0]
    with pytest.raises(Exception, match="no exact squared distance"):
        centroid_clustering.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))


def test_bounds_never_cut_a_tie():
    """Points halfway between centroids, where a careless bound would keep the larger number."""
    cent = np.array([[4, 0], [0, 0], [2, 0], [0, 0]])
    v = np.array([[1, 0], [3, 0], [0, 0], [2, 5], [3, 1]])
    a, square, upper, lower, _ = centroid_clustering.nearest(v, cent, centroid_clustering.between(cent))
    want = [min(range(4), key=lambda j: (((x - cent[j]) ** 2).sum(), j)) for x in v]
    assert a.tolist() == want
    new = cent + np.array([[0, 0], [0, 0], [0, 0], [1, 0]])
    shift = centroid_clustering.moved(cent, new)
    again = centroid_clustering.nearest(v, new, centroid_clustering.between(new), a, upper + shift[a], np.maximum(lower - shift, 0), settle=True)
    assert again[0].tolist() == [min(range(4), key=lambda j: (((x - new[j]) ** 2).sum(), j)) for x in v]
    assert again[1].tolist() == [((x - new[j]) ** 2).sum() for x, j in zip(v, again[0])]


# ---- filter audit


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    facts = []
    for i, t, s in rows:
        t = t or ""
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        f = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        facts.append((s or "", {k for k, x in f.items() if x}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in facts}:
        mine = [f for f in facts if f[0] == part]
        gone = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                removed = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                failing = sum(x in f[1] for f in mine)
                out[part, order, step] = [len(left), len(removed), failing - len(removed), sum(f[1] == {x} for f in mine), sum(f[2] for f in removed), sum(f[3] for f in removed)]
                gone[x] += len(removed)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(gone[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(df, labels, **options):
    rows = filter_audit.interactions(filter_audit.failures(df, labels), **options).collect()
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("parts", [filter_audit.PARTS, 2])
def test_audit_as_by_brute_force(spark, parts):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["w%d", "W%d", "x"]).replace("%d", str(rng.randrange(400))) for _ in range(rng.choice([3, 150, 230, 400]))) + rng.choice(["", " #", " a|b"])
    texts = [text() for _ in range(25)] + ["", None]
    rows = [(rng.choice([i, i, None, 5]), rng.choice(texts), rng.choice(["a", "b", "", None, "c", "d"])) for i in range(150)]
    labels = [(rng.choice([i, 5, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 170, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for name in ("id", "part", "t", "w", "hash", "failed", "first", "good", "toxic", "quality", "o", "step"):
        df = df.withColumn(name, F.lit("clash"))
    assert audited(df, spark.createDataFrame(labels, LABELS), parts=parts) == brute_audit(rows, labels)


def test_audit_odd(spark):
    d, none = odd(spark), spark.createDataFrame([], LABELS)
    rows = [(r.doc_id, r.text, r.source) for r in d.collect()]
    assert audited(d, none) == brute_audit(rows, [])
    assert audited(docs(spark), none) == {}


def test_first_failure():
    table = filter_audit.first_failure("ABC")
    for failed, (j, order) in itertools.product(range(8), enumerate(filter_audit.orders("ABC"))):
        assert table[failed, j] == next((s for s, x in enumerate(order) if failed >> "ABC".index(x) & 1), 3)


# ---- token files


def tokens_of(texts, end=2):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in texts]


@pytest.mark.parametrize("n,top", [(0, 9), (1, 1), (5, 70000), (1000, 2**32 - 1), (3000, 49408), (70000, 3), (513, 300), (1024, 1)])
def test_format(n, top):
    rng = np.random.default_rng(n)
    ids = (rng.random(n) ** 3 * top).astype("u4")
    ends, at = [], 0
    while at < n:
        at = min(n, at + int(rng.integers(0, n // 3 + 2)))
        ends.append(at)
    names = [None if rng.random() < 0.2 else int(rng.integers(-5, 99)) for _ in ends]
    data, read = token_files.encoded_file(names, np.array(ends, int), ids), []
    f = token_files.TokenFile(lambda a, size: read.append(size) or data[a : a + size])
    assert f.doc_ids() == names and f.ends().tolist() == [0, *ends] and (f.tokens(0, n) == ids).all()
    for a, b in np.sort(rng.integers(0, n + 1, (40, 2)), 1).tolist():
        assert (f.tokens(a, b) == ids[a:b]).all()
    for i in rng.integers(0, n, 40).tolist() if n else []:
        del read[:]
        assert f.token(i) == ids[i] and sum(read) <= 80 * len(f.levels)  # no block is decoded


def test_widths_are_the_best():
    def bits(ids, sizes):
        total, left = 0, ids
        for k, w in enumerate(sizes):
            total += len(left) * (w + (1 + 32 / token_files.BLOCK if k + 1 < len(sizes) else 0))
            left = left[left >> w > 0] >> w
        return total

    rng = np.random.default_rng(4)
    for top in (1, 2, 9, 200, 1000):
        ids = (rng.random(500) ** 4 * top).astype("u4")
        n = max(1, int(ids.max()).bit_length())
        cuts = ([b - a for a, b in zip((0, *c), (*c, n))] for k in range(n) for c in itertools.combinations(range(1, n), k))
        assert bits(ids, token_files.widths(ids)) == min(bits(ids, c) for c in cuts)


@pytest.mark.parametrize("file_tokens", [token_files.FILE_TOKENS, 300])
def test_round_trip(spark, file_tokens):
    texts = ["one two", None, "", "Zwei é 漢字 " * 40, "the <|endoftext|> of it", "x", "x"] + [f"text number {i} " * (i % 9) for i in range(60)]
    rows = [(None if i == 3 else 5 if i in (5, 6) else 97 * i % 61 - 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("clash"), "ids": F.lit(1), "n": F.lit(2)}).repartition(3)
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    manifest = token_files.write(df, folder, file_tokens=file_tokens)
    got = sorted(token_files.read(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((i is not None, i or 0) for i, _ in rows)
    want = sorted((str(i), x.tobytes()) for (i, _), x in zip(rows, tokens_of(texts)))
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == want
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
        at += r.n_tokens
    all_ids = np.frombuffer(b"".join(bytes(r.ids) for r in got), "<u4")
    assert manifest.count() > (file_tokens == 300) and manifest.agg(F.sum("n_tokens")).first()[0] == at
    places = [*range(0, at, 7), at - 1, at, at + 50, -1, None, 3, 3]
    found = token_files.lookup(spark, folder, spark.createDataFrame([(p,) for p in places], "position long")).collect()
    assert sorted(map(str, found)) == sorted(f"Row(position={p}, token={int(all_ids[p]) if p is not None and 0 <= p < at else None})" for p in places)


def test_files_that_no_manifest_names_are_not_read(spark):
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    token_files.write(docs(spark, "a b", "c"), folder)
    store, top = token_files._file_system(folder)
    with store.open_output_stream(f"{top}/lost.dact") as f:
        f.write(b"a task that was lost")
    assert token_files.read(spark, folder).count() == 2
    name = token_files.manifest_of(spark, folder).first().file
    with store.open_output_stream(f"{top}/{name}") as f:
        f.write(b"damaged")
    with pytest.raises(Exception, match="isn't as it was written"):
        token_files.read(spark, folder).collect()


def test_files_odd(spark):
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    d = odd(spark)
    token_files.write(d, folder)
    got = token_files.read(spark, folder).collect()
    texts = d.select("doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(r.doc_id), zlib.crc32(x.tobytes())) for r, x in zip(texts, tokens_of([r.text for r in texts])))
    token_files.write(docs(spark), folder + "-none")
    assert token_files.read(spark, folder + "-none").count() == 0
    assert token_files.lookup(spark, folder + "-none", spark.range(3).withColumnRenamed("id", "position")).where("token is null").count() == 3


def test_op13_on_the_table(spark, sf):
    table = sql(sf, "SELECT doc_id, text FROM documents ORDER BY doc_id")
    want, at = [], 0
    for i, ids in zip(table.doc_id, tokens_of(table.text)):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, QUERIES["op13_token_files"](spark, sf).collect())) == want
