"""The stages of the pipeline one by one, on their own input, and the whole."""

import random

import corpus_pipeline as P
from lexloom.llm import decontamination
from lexloom.llm.queries import table

from .test_operators import brute_groups, brute_hits, check_places, words


def test_stages(spark, sf):
    d = table(spark, sf, "documents")
    start = {r.doc_id: r for r in d.collect()}
    civil = {r.doc_id: r for r in P.keep_civil(spark, d, sf).collect()}
    assert P.keep_civil(spark, d, sf).columns == d.columns and 0.6 * len(start) < len(civil) <= len(start)
    left = P.drop_repeated_lines(spark, d, sf)
    kept = {r.doc_id: r for r in left.collect()}
    assert left.columns == d.columns and all(len(kept[i].text) <= len(start[i].text) and kept[i].n_chars == len(kept[i].text) for i in kept if kept[i].text != start[i].text)
    one = {r.doc_id for r in P.keep_one_of_each_group(spark, d, sf).collect()}
    want = brute_groups([(i, r.text) for i, r in start.items()], 90)
    assert one == {i for i, (n, c) in want.items() if c == i}
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    clean = P.keep_uncontaminated(spark, d, sf)
    bad = {i for i, r in start.items() if (h := brute_hits(r.text, items))[1] and 20 * h[1] >= h[0]}
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == set(start) - bad and bad


def test_planted(spark, sf):
    rng = random.Random(1)
    b = table(spark, sf, "benchmark").first().text
    new = lambda n: " ".join(f"z{rng.randrange(10**6)}" for _ in range(n))
    base, passage = new(300), new(60)
    near = base.split(" ")
    near[150] = "other"
    texts = [base, base, " ".join(near), f"{new(80)}\n{passage}\n{new(20)}", f"{new(80)}\n{passage}", f"{new(30)} {b} {new(30)}", new(200), ""]
    d = spark.createDataFrame([(10**6 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)], table(spark, sf, "documents").schema)
    got = {r.doc_id - 10**6: r.text for r in P.drop_repeated_lines(spark, d, sf).collect()}
    assert passage in got[3] and passage not in got[4] and 1 not in got and got[6] == texts[6] and got[7] == ""
    assert {r.doc_id - 10**6 for r in P.keep_one_of_each_group(spark, d, sf).collect()} == {0, 3, 4, 5, 6, 7}
    assert {r.doc_id - 10**6 for r in P.keep_uncontaminated(spark, d, sf).collect()} == set(range(8)) - {5}


def test_rows_that_share_an_id(spark, sf):
    """Repeated rows leave one; of two texts with one id only the linked one goes; nulls, and columns named as the operators' own, stay."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_deleted string, words_deleted string, rid string, salt string, row string, score string, doc string"
    mine = ("x",) * 8
    texts = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "u v w x y z"), (2, "A b c d e f"), (None, "u v w x y z"), (None, None), (3, ""), (3, None)]
    d = spark.createDataFrame([(i, t, "en", "s", 0, *mine) for i, t in texts], schema)
    key = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=str)
    got = P.keep_one_near_copy(spark, d, sf)
    assert key(got.collect()) == sorted([(1, "a b c d e f"), (2, "u v w x y z"), (None, None), (3, ""), (3, None)], key=str)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == d.columns and {x for r in out.collect() for x in r[5:]} == {"x"}, name
        empty = stage(spark, d.limit(0), sf)
        assert empty.columns == d.columns and empty.count() == 0, name
    assert len(P.pack(spark, d, sf).collect()) == 8 and P.pack(spark, d.limit(0), sf).count() == 0


def test_run(spark, sf):
    got = P.run(spark, sf).collect()
    assert check_places(got, 2048) > 0 and [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    assert P.ORACLE_SQL is None and decontamination.PATTERN_WORDS and words("a b") == ["a", "b"]


def test_near_copies_between_80_and_90(spark, sf):
    """Two separate changes in 100 words: 86 of 106 five-word shingles, but 92 of 104 three-word ones."""
    near_copy = dict(P.STAGES)["ngram_jaccard_join"]
    base = [f"w{i}" for i in range(100)]
    edit = lambda *at: " ".join(f"e{i}" if i in at else w for i, w in enumerate(base))
    texts = [edit(), edit(30, 60), edit(20, 50, 80), " ".join(f"v{i}" for i in range(100)), "", edit(31, 61)]
    want = brute_groups(list(enumerate(texts)), 80, 5)
    assert want[1][1] == 0 and want[2][1] == 2 and brute_groups(list(enumerate(texts)), 90)[1][1] == 1
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], table(spark, sf, "documents").schema)
    assert {r.doc_id for r in near_copy(spark, d, sf).collect()} == {i for i, (_, c) in want.items() if c == i}
    d = table(spark, sf, "documents")
    want = brute_groups([(r.doc_id, r.text) for r in d.collect()], 80, 5)
    assert {r.doc_id for r in near_copy(spark, d, sf).collect()} == {i for i, (_, c) in want.items() if c == i}
