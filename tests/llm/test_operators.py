"""The training-data operators against brute force, on small tables with nulls, empty and repeated rows, and clashing names."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import decontamination, jaccard_join, language_id, line_dedup, packing, quality_classifier, quality_rules, sharding, toxicity, url_filter
from lexloom.llm._shared import hadoop, held_out, shared_dir, stage
from lexloom.llm.queries import ORACLE_SQL, QUERIES

from ..compare import rows, sql

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
GAP = re.compile(r"[\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def words(t):
    return [w for w in GAP.split(t or "") if w]


def docs(spark, *texts, source="s", lang="en"):
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def odd(spark):
    """Nulls, empty and long texts, repeated rows, rows without id, and columns named like the operators' own."""
    long = " ".join(f"w{i % 977}" for i in range(30000))
    data = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", None, "a", 3), (5, long, "en", None, len(long)), (6, long, "en", "b", len(long)), (6, long, "en", "b", len(long)), (None, "no id here", "fr", "b", 10), (None, None, None, None, None), (7, "1 2 3 % # *", "de", "b", 11)]
    df = spark.createDataFrame(data, DOCS)
    for name in ("rid", "lines", "deleted", "hits", "n_words", "n_hit", "items", "row", "length", "piece", "node", "key", "host", "path", "p", "v", "y", "score", "h", "n", "kept", "rule", "verdict", "salt", "component_id"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def labels(spark, n=40):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(n)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), sql(sf, ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


# ---- quality rules


def test_repeated_words_and_base(spark):
    def brute(ws):
        seen = collections.Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        return len({j for i in range(len(ws) - 7) if seen[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)})

    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(80)] + ["x " * 40, "a b\n\na b\nc #$\n", "", None]
    got = quality_rules.judge(docs(spark, *texts)).collect()
    for r in got:
        t = texts[r.doc_id] or ""
        ws, ls = words(t), [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_symbols) == (len(ws), sum(map(len, ws)), len(ls) - len(set(ls)), sum(c in "#*$%&|<>" for c in t))
        assert r.n_repeat_words == brute(ws) and r.base_failed == (len(ws) < 20 or 100 * brute(ws) > 30 * len(ws))


def test_frequent_lines_deplete(spark):
    rng = random.Random(8)
    own = [" ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(30)) for i in range(40)]
    head = "the very same long heading line of every page of this host with twenty words or more in it as you can see"
    texts = [f"{head}\n{own[i]}" if i < 30 else f"{head.upper()}\ntail {i}" for i in range(40)]
    r = {x.doc_id: x for x in quality_rules.judge(docs(spark, *texts), min_docs=20, min_share=0.5).collect()}
    assert all(r[i].kept for i in range(30)) and not any(r[i].kept for i in range(30, 40)) and not r[35].base_failed
    one = docs(spark, *[texts[0]] * 3).withColumn("doc_id", F.lit(1).cast("long"))
    assert all(x.removed_chars == 0 for x in quality_rules.judge(one, min_docs=2, min_share=0.0).collect())  # one document, three rows


def test_frequent_lines_go(spark):
    texts = [f"Own {chr(97 + i)}\n\nCookie  Notice {i % 10}\n last {chr(97 + i)} " for i in range(20)] + ["cookie notice 7", None, "", "cookie\nnotice"]
    got = {r.doc_id: r for r in quality_rules.without_frequent_lines(docs(spark, *texts), min_docs=15, min_share=0.5).collect()}
    assert [got[i].text for i in range(24)] == [f"Own {chr(97 + i)}\n\n last {chr(97 + i)} " for i in range(20)] + ["", None, "", "cookie\nnotice"]
    assert (got[3].line_chars, got[3].chars_left) == (26, 11) and (got[20].line_chars, got[20].chars_left) == (15, 0) and got[3].source == "s"
    joined = quality_rules.without_frequent_lines(docs(spark, *texts), min_docs=15, min_share=0.5, broadcast_lines=0)  # the salted join
    assert sorted(map(str, joined.collect())) == sorted(map(str, got.values()))


def test_quality_rules_odd(spark):
    r = quality_rules.judge(odd(spark)).collect()
    assert len(r) == 10 and sum(x.kept for x in r) == 0 and all(x.kept is not None for x in r)
    assert quality_rules.judge(odd(spark).limit(0)).count() == 0


# ---- language


def test_language(spark):
    en, fr = "the house and the garden with many words", "la maison et le jardin avec des mots"
    texts = [en if i % 2 else fr for i in range(60)]
    d = spark.createDataFrame([(i, t, "en" if i % 2 else "fr", "s", 0) for i, t in enumerate(texts)], DOCS)
    m = language_id.learn(d)
    assert m.languages == ["en", "fr"]
    test = docs(spark, "the garden", "le jardin", "gardens housing", "12 34", None, "", "мир")
    got = [(r.lang_pred, 0 <= r.score <= 1) for r in language_id.predict(test, m, ["doc_id"]).orderBy("doc_id").collect()]
    assert [x[0] for x in got[:6]] == ["en", "fr", "en", "und", "und", "und"] and all(x[1] for x in got) and got[6][0] in ("en", "fr")


def test_small_languages_keep_their_words(spark):
    """A language with one document in a thousand has the same share of the table as one with the rest."""
    rng = random.Random(7)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(4))
    big, small = [word("abcdefgh") for _ in range(900)], [word("stuvwxyz") for _ in range(30)]
    data = [(i, " ".join(rng.choices(big, k=30)), "en", "s", 0) for i in range(1000)]
    data += [(1000 + i, " ".join(rng.choices(small, k=200)), "xx", "s", 0) for i in range(2)]
    d = spark.createDataFrame([x for x in data if zlib.crc32(str(x[0]).encode()) % 4 != 2], DOCS)
    m = language_id.learn(d, 100, 400)
    assert m.languages == ["en", "xx"] and len(set(m.words) & set(small)) == len(set(small)) and 40 <= len(m.words) <= 100
    assert len(m.grams) <= 400 and {len(g) for g in m.grams} == {1, 2, 3, 4}
    again = language_id.learn(d.where("lang = 'xx'").unionByName(d.where("lang = 'en'").limit(100)), 100, 400)
    assert set(again.words) & set(small) == set(m.words) & set(small)


def test_language_scores_are_those_of_plain_sums(spark):
    """Known words by their log frequency, others by the longest n-grams that are known, against dictionaries."""
    texts = ["aa ab aa abc abcd"] * 3 + ["ba bb ba bbc abcd"] * 3
    d = spark.createDataFrame([(i * 4 + 1, t, "x" if i < 3 else "y", "s", 0) for i, t in enumerate(texts)], DOCS).where(~held_out(F.col("doc_id")))
    count = {k: collections.Counter(w for r in d.collect() if r.lang == k for w in r.text.split()) for k in "xy"}
    m = language_id.learn(d)
    assert set(m.words) == {w for k in "xy" for w, n in count[k].items() if n >= 3}
    grams = {k: collections.Counter() for k in "xy"}
    for k in "xy":
        for w, n in count[k].items():
            for size in range(1, 5):
                for i in range(len(w) + 3 - size):
                    grams[k][f"<{w}>"[i : i + size]] += n
    relative = lambda c, keys: {q: np.array([math.log((c[k][q] + 1) / sum(c[k][x] + 1 for x in keys)) for k in "xy"]) for q in keys}
    kept = {q for k in "xy" for q, n in grams[k].items() if n >= 3}
    known, parts = relative(count, m.words), {}
    for size in range(1, 5):
        parts |= relative(grams, [q for q in kept if len(q) == size])
    for text in ("aa", "bbcd aa", "zz", "abab bb bb", "q<"):
        total = np.zeros(2)
        for w in language_id.words(text):
            found = known.get(w)
            for size in range(min(4, len(w) + 2), 0, -1):
                at = [parts[q] for i in range(len(w) + 3 - size) if (q := f"<{w}>"[i : i + size]) in parts]
                if found is None and at:
                    found = np.mean([x - x.mean() for x in at], 0)
            found = np.zeros(2) if found is None else found - found.mean()
            total += found
        z = total / math.sqrt(len(language_id.words(text)))
        got = language_id.identify(text, language_id._Known(m))
        assert got[0] == "xy"[int(np.argmax(z))] and math.isclose(got[1], math.exp(z.max()) / np.exp(z).sum(), rel_tol=1e-5)


def test_language_held_out_accuracy(spark):
    big = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in QUERIES["op2_language_id"](spark, big).collect() if r.held_out]
    assert len(got) > 150 and sum(r.lang_pred == truth[r.doc_id] for r in got) / len(got) > 0.93


def test_language_learns_nothing_from_held_out(spark):
    d = docs(spark, *["abc"] * 40).where(held_out(F.col("doc_id")))
    assert language_id.learn(d).languages == []
    assert {r.lang_pred for r in language_id.predict(odd(spark), language_id.learn(d)).collect()} == {"und"}


@pytest.mark.parametrize("most", [1, 7, 40, 1000])
def test_most_frequent_keys(spark, most):
    rng = random.Random(most)
    rows = [(f"w{i}", lang, rng.choice([1, 2, 3, 3, 3, 4, 9, i])) for i in range(200) for lang in rng.sample(["a", "b", "c"], 2)]
    got = language_id._most_frequent(spark.createDataFrame(rows, "word string, lang string, n long").repartition(3), "word", F.length("word"), most)
    want = set()
    for lang in "abc":
        for size in (2, 3, 4):
            mine = sorted((-n, w) for w, x, n in rows if x == lang and len(w) == size and n >= 3)
            want |= {w for _, w in mine[:most]}
    assert sorted(r.word for r in got.collect()) == sorted(want)


def test_any_number_of_languages(spark):
    rng = random.Random(12)
    vocabulary = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(8)] for k in range(300)}
    rows = [(20 * k + i, " ".join(rng.choices(v, k=12)), lang) for k, (lang, v) in enumerate(vocabulary.items()) for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language_id.learn(d)
    assert len(m.languages) == 300 and m.word_scores.shape[1] == 300
    got = language_id.predict(d.where(held_out(F.col("doc_id"))), m).collect()
    assert len(got) > 500 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95


# ---- packing


def test_tokens_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    texts = ["It's we're I'LL 'd ''s ...'s x's2's", "ÀÉ×÷ß naïve ÿŸ Žižek İstanbul ΑΣ", "<|endoftext|> a<|startoftext|>b", "á 中文 ½ ² ٣", "\x00 \x1c\x1dab\x85cd", "", None, "12,345.67% #$%", "word " * 5000]
    tok = Tokenizer.from_file(packing.tokenizer_path())
    got = collections.defaultdict(dict)
    for r in packing.tokenized(docs(spark, *texts), with_ids=True).collect():
        got[r.doc_id][r.piece] = r
    for i, t in enumerate(texts):
        want = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        pieces = [got[i][k] for k in sorted(got[i])]
        assert b"".join(p.ids for p in pieces) == want.tobytes() and [p.start for p in pieces] == [2048 * k for k in range(len(pieces))]
        assert all(p.ids_crc32 == zlib.crc32(p.ids) and p.length == len(p.ids) // 4 for p in pieces) and all(p.length == 2048 for p in pieces[:-1])


def check_places(got, capacity):
    held = collections.defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for v in held.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and v[-1][0] + v[-1][1] <= capacity
    return len(held)


def test_packing(spark):
    rng = random.Random(5)
    lengths = [rng.choice([100, 100, 99, rng.randrange(1, 101)]) for _ in range(3000)]
    d = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    got = packing.pack(d, 100).collect()
    assert collections.Counter(r.length for r in got) == collections.Counter(lengths) and len({r.doc_id for r in got}) == 3000
    full = sum(n == 100 for n in lengths)
    assert check_places(got, 100) <= full + 1.02 * sum(n for n in lengths if n < 100) / 100 + 2 + sum(n == 99 for n in lengths) * 0.01


def test_plan_holds_each_length_once():
    rng = np.random.default_rng(1)
    for _ in range(6):
        counts = rng.integers(0, 50, 65) * (rng.random(65) < 0.7)
        counts[0] = 0
        held = np.zeros(65, int)
        for n, lengths in packing.plan(counts, 64):
            assert sum(lengths) <= 64
            for x in lengths:
                held[x] += n
        assert (held == counts).all()


def test_packing_odd(spark):
    own = ("rid", "salt", "nth", "before", "rank", "row", "sequence_id", "offset")
    d = spark.createDataFrame([(5, i, "mine") for i in range(9)], "length long, id long, rid string")
    for c in own[1:]:
        d = d.withColumn(c, F.lit("mine"))
    got = packing.pack(d, 10).collect()
    assert all(r[c] == "mine" for r in got for c in own[:-2]) and check_places(got, 10) == 5 and len(got) == 9
    with pytest.raises(ValueError):
        packing.pack(d.withColumn("length", F.lit(11)), 10)
    got = packing.pack_documents(odd(spark).select("doc_id", "text")).collect()
    assert check_places(got, 2048) >= 1 and sum(r.piece == 0 for r in got) == 10
    assert packing.pack_documents(docs(spark)).count() == 0


# ---- quality classifier


def test_classifier(spark):
    rng = random.Random(2)
    good, bad = " ".join(["plain words here"] * 20), " ".join(["x%%% y### z***"] * 20)
    data = [(i, good if (y := rng.random() < 0.6) else bad, "en", "clean" if y else "spam", 0) for i in range(400)]
    d = spark.createDataFrame(data, DOCS)
    lab = spark.createDataFrame([(i, int(t == good)) for i, t, *_ in data if i % 2], "doc_id long, quality int")
    r = quality_classifier.judge(d, lab).collect()
    assert all(x.kept == (data[x.doc_id][1] == good) for x in r)
    assert min(x.host_score for x in r if x.kept) > max(x.host_score for x in r if not x.kept)


def test_sparse_sites_shrink(spark):
    """Among many hosts alike, one bad document says little of its host."""
    d = spark.createDataFrame([(i, "text", "en", f"big{i % 10}" if i < 400 else f"tiny{i}", 0) for i in range(410)], DOCS)
    lab = spark.createDataFrame([(i, int(i % 11 != 0 and i != 401)) for i in range(410)], "doc_id long, quality int")
    r = {x.doc_id: x for x in quality_classifier.judge(d, lab).collect()}
    assert not r[401].held_out and abs(r[401].host_score - r[1].host_score) < 0.2


def test_own_label_is_taken_out(spark):
    """host_score and path_score by plain sums over the other documents; a document's own label doesn't move its own."""
    d = spark.createDataFrame([(i, "same text here", f"p{i % 3}", f"h{i % 4}", 0) for i in range(48)], DOCS)
    lab = [(i, int(i % 4 < 2 or i % 5 == 0)) for i in range(48)]
    run = lambda rows: {x.doc_id: x for x in quality_classifier.judge(d, spark.createDataFrame(rows, "doc_id long, quality int")).collect()}
    r, y = run(lab), {}
    for i, v in lab:
        y[i] = r[i].doc_score if r[i].held_out else v
    base, of = sum(y.values()) / 48, lambda f: {k: [y[i] for i in y if f(i) == k] for k in {f(i) for i in y}}

    def strength(groups, up):
        n, k = sum(map(len, groups.values())), len(groups)
        inside = sum(sum(v * v for v in g) - sum(g) ** 2 / len(g) for g in groups.values()) / (n - k)
        between = sum(len(g) * (sum(g) / len(g) - up[q]) ** 2 for q, g in groups.items())
        between = (between - k * inside) / (n - sum(len(g) ** 2 for g in groups.values()) / n)
        return inside / between if between > inside / 1e12 else 1e12

    hosts, paths = of(lambda i: i % 4), of(lambda i: (i % 4, i % 3))
    a = strength(hosts, dict.fromkeys(hosts, base))
    b = strength(paths, {q: (sum(hosts[q[0]]) + a * base) / (len(hosts[q[0]]) + a) for q in paths})
    for i in y:
        h, p = hosts[i % 4], paths[i % 4, i % 3]
        host = (sum(h) - y[i] + a * base) / (len(h) - 1 + a)
        path = (sum(p) - y[i] + b * host) / (len(p) - 1 + b)
        assert math.isclose(r[i].host_score, host, rel_tol=1e-6, abs_tol=1e-9) and math.isclose(r[i].path_score, path, rel_tol=1e-6, abs_tol=1e-9)


def test_classifier_odd(spark):
    r = quality_classifier.judge(odd(spark), labels(spark)).collect()
    assert len(r) == 10 and all(0 <= x.score <= 1 for x in r)
    r = quality_classifier.judge(odd(spark), labels(spark).limit(0)).collect()
    assert all(x.doc_score == 0.5 for x in r) and quality_classifier.judge(docs(spark), labels(spark)).count() == 0


# ---- URL filter


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(FOLD)
    fits = [(len(r), r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_rules(spark, sf):
    urls = [None, "", "com/", "http://", "http://COM/", "https://com", "x://a.example.com/en/1?x#y", "https://www.Example.com/en/", "http://m.www.example.com/en/a", "http://a.net/es/", "http://net/fr/x", "http://net/frx", "http://a#b/c://d.com/", "http://notcom/", "a://b://c.com/", "http://a.com?x=/en/", "http://é.com/\nx", "HTTP://u@h.com:80/p"]
    urls += [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("url").collect()]
    p = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.judge(p).collect():
        host, path, rule, verdict = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.block_score >= 0.5 else "allow"))


def test_rare_blocks_are_learned(spark):
    """With one block among hundreds of addresses the sample still has it; repeated rows and clashing columns change nothing."""
    t = spark.createDataFrame([(f"http://s{i}.org/{'casino' if i < 3 else 'news'}/{i}", int(i < 3)) for i in range(900)], "url string, label int")
    p = spark.createDataFrame([(0, "http://q.org/casino/9", "x"), (0, "http://q.org/casino/9", "x"), (1, None, "y")], "page_id long, url string, host string").withColumns({c: F.lit("mine") for c in ("path", "rule", "ruled", "grams", "features", "probability", "label", "weight")})
    got = url_filter.judge(p, t, rules=(), sample=20, cut=0.05).collect()
    assert [(r.page_id, r.host, r.verdict) for r in got] == [(0, "q.org", "block")] * 2 + [(1, "", "allow")]
    assert url_filter.judge(p.limit(0), t).count() == 0 and url_filter.judge(p.limit(0)).count() == 0


def test_url_model(spark):
    t = spark.createDataFrame([(f"http://s{i}.org/{'casino' if i % 2 else 'news'}/{i}", i % 2) for i in range(60)], "url string, label int")
    p = spark.createDataFrame([(0, "http://q.org/casino-royal/"), (1, "http://q.org/newspaper/")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(p, t, rules=()).orderBy("page_id").collect()] == ["block", "allow"]
    assert {r.verdict for r in url_filter.judge(p, t.limit(0), rules=()).collect()} == {"allow"}


# ---- line dedup


def fold(line):
    return GAP.sub(" ", line.lower()).strip(" ")


def brute_dedup(data, least):
    out, before = {}, []
    for rid, (doc, text) in enumerate(sorted(data, key=lambda r: r[0])):
        ls = [(p, fold(x)) for p, x in enumerate((text or "").split("\n")) if fold(x)]
        gone = set()
        for a in range(len(ls)):
            for o, b in [(o, b) for o in before for b in range(len(o))] + [(ls, b) for b in range(a)]:
                k = n = 0
                while a + k < len(ls) and b + k < len(o) and ls[a + k][1] == o[b + k][1]:
                    n += len(ls[a + k][1].split(" "))
                    k += 1
                if n >= least:
                    gone |= {ls[t][0] for t in range(a, a + k)}
        before.append(ls)
        out[doc] = "\n".join(x for p, x in enumerate(text.split("\n")) if p not in gone)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    pool = ["a b", "C  d e", "f", "g h i j", "", "k l m"]
    data = [(i, "\n".join(rng.choice(pool[: 2 + i % 5]) for _ in range(rng.randrange(1, 9)))) for i in range(40)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(data, "doc_id long, text string"), 6).collect()}
    assert got == brute_dedup(data, 6)


def test_long_passages_go(spark):
    passage = " ".join(f"p{i}" for i in range(51))
    got = {r.doc_id: r for r in line_dedup.dedup(docs(spark, f"own one\n{passage}\nend", f"{passage}\nown two", "short", "short", passage.upper())).collect()}
    assert got[0].n_deleted == 0 and got[1].text == "own two" and got[2].text == got[3].text == "short" and got[4].text == ""


def test_line_dedup_odd(spark):
    d = odd(spark)
    r = line_dedup.dedup(d).collect()
    assert len(r) == 10 and [c for c in line_dedup.dedup(d).columns if c not in ("n_lines", "n_deleted", "words_deleted")] == [c for c in d.columns if c not in ("n_lines", "n_deleted", "words_deleted")]
    assert sorted(x.n_deleted for x in r if x.doc_id in (5, 6)) == [0, 1, 1] and all(x.text is None for x in r if x.doc_id == 1)
    assert line_dedup.dedup(d.limit(0)).count() == 0


# ---- sharding


def test_store_round_trip(spark, tmp_path):
    s = sharding.Store(spark, str(tmp_path / "s"), target=1 << 20, fan_in=3)
    with pytest.raises(ValueError):
        s.read()
    whole = odd(spark).select("doc_id", "text", "lang")
    for k in range(4):
        s.append(whole.withColumn("batch", F.lit(k)).repartition(2))
    before = s.read().collect()
    shards = len(s.shards())
    assert s.version() == 4 and len(before) == 40
    v = s.compact()
    assert v == 5 and len(s.shards()) < shards and sorted(map(str, s.read().collect())) == sorted(map(str, before))
    assert sorted(map(str, s.read(4).collect())) == sorted(map(str, before))  # the old version stays
    assert s.compact() == v and sum(x["rows"] for x in s.shards()) == 40
    assert s.vacuum() > 0 and len(s.read().collect()) == 40
    with pytest.raises(sharding.Conflict):
        s.commit(4, [], s.manifest()["schema"])
    with pytest.raises(ValueError):
        s.append(whole)
    assert s.version() == 5 and not [f for f in (tmp_path / "s/manifests").iterdir() if f.name.startswith(".tmp")]


def test_placed_keeps_columns_that_clash(spark, tmp_path):
    s = sharding.Store(spark, str(tmp_path / "s"))
    s.append(odd(spark).withColumn("name", F.lit("mine")).withColumn("shard_id", F.lit("theirs")))
    r = sharding.placed(s).collect()
    assert len(r) == 10 and {x.name for x in r} == {"mine"} and all(x.shard_id >= 1 for x in r) and len(set(sharding.placed(s).columns)) == len(sharding.placed(s).columns)


def test_one_of_two_writers_wins(spark, tmp_path):
    s = sharding.Store(spark, str(tmp_path / "s"))
    s.append(docs(spark, "a"))
    other = sharding.Store(spark, s.path)
    base = other.manifest()
    s.append(docs(spark, "b"))
    with pytest.raises(sharding.Conflict):
        other.commit(base["version"], base["lists"], base["schema"])
    assert {r.text for r in s.read().collect()} == {"a", "b"}


def test_finished_shards_stay(spark, tmp_path):
    s = sharding.Store(spark, str(tmp_path / "s"), target=4000, fan_in=2)
    rng = random.Random(5)
    for _ in range(6):
        s.append(docs(spark, *["".join(rng.choice("abcdefghij") for _ in range(900)) for _ in range(2)]).repartition(1))
    s.compact()
    done = {x["file"] for x in s.shards(finished=True)}
    for _ in range(2):
        s.append(docs(spark, "x").repartition(1))
    s.compact()
    assert done and done <= {x["file"] for x in s.shards()} and s.read().count() == 14


def test_store_of_nothing(spark, tmp_path):
    s = sharding.Store(spark, str(tmp_path / "s"))
    s.append(docs(spark))
    assert s.read().count() == 0 and s.compact() == 1 and sharding.placed(s).count() == 0


def test_stored_columns_named_as_sparks_own(spark):
    store = sharding.Store(spark, f"{shared_dir(spark)}/store-{random.random()}")
    d = docs(spark, "a", "b", "c").withColumns({"_metadata": F.lit("mine"), "name": F.lit("clash")})
    store.append(d)
    store.append(d.limit(1))
    store.compact()
    got = sharding.placed(store).collect()
    assert len(got) == 4 and {(r["_metadata"], r["name"]) for r in got} == {("mine", "clash")} and all(r.shard_id for r in got)


# ---- Jaccard join


def brute_groups(data, percent, size=3):
    sets = {}
    for i, t in data:
        ws = words((t or "").translate(FOLD))
        sets[i] = {tuple(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))} if ws else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(rng, n, size, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        ws = list(base)
        for _ in range(rng.randrange(edits + 1)):
            ws[rng.randrange(len(ws))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(ws))
    return out


@pytest.mark.parametrize("percent", [90, 60])
def test_groups(spark, percent):
    rng = random.Random(percent)
    texts = [t for k in range(12) for t in copies(rng, 12, rng.choice([4, 9, 12, 40, 90]), 4)] + ["a", "a", "A b", "a b", "", None, "  "]
    data = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.groups(spark.createDataFrame(data, "doc_id long, text string"), percent).collect()}
    assert got == brute_groups(data, percent)


@pytest.mark.parametrize("percent", [50, 60, 75, 80, 90, 95])
def test_linked_sets_meet_in_a_block(percent):
    """Pairs at the very edge of a link, of sets as small and as large as may be, below and above the ring's size."""
    rng, run = np.random.default_rng(3), jaccard_join.run_length(percent)
    lists = jaccard_join.lists_entered(percent, run)
    keys = lambda x: jaccard_join.block_keys(np.sort(x), run, lists)
    for n in [*range(1, 60), *range(lists - 3, lists + 8), 333, 1000, 5000] * 4:
        members = np.unique(rng.integers(0, 1 << 64, 3 * n + 3, dtype=np.uint64, endpoint=False))
        members = members[rng.permutation(len(members))]
        others = n * (100 - percent) // percent  # members that are not common
        lost = int(rng.integers(0, others + 1))
        a, b = members[: n + lost], np.concatenate([members[:n], members[n + lost : n + others]])
        assert 100 * n >= percent * (n + others)
        assert (others == 0 and (np.sort(a) == np.sort(b)).all()) or np.intersect1d(keys(a), keys(b)).size
    assert jaccard_join.lists_entered(80, 1) == 28 and jaccard_join.lists_entered(90, 3) < jaccard_join.lists_entered(80, 3) < 130
    long = rng.integers(0, 1 << 64, 10000, dtype=np.uint64, endpoint=False)
    other = np.concatenate([long[:100], rng.integers(0, 1 << 64, 9900, dtype=np.uint64, endpoint=False)])
    if percent >= 80:
        assert np.intersect1d(keys(long), keys(other)).size <= 1  # a shared passage fills no block


def test_groups_at_80_of_five_words(spark):
    rng = random.Random(80)
    texts = [t for _ in range(10) for t in copies(rng, 10, rng.choice([4, 9, 12, 40, 90, 200]), 4)] + ["a", "a", "A b", "", None]
    data = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.groups(spark.createDataFrame(data, "doc_id long, text string"), 80, 5).collect()}
    assert got == brute_groups(data, 80, 5)


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    rng = random.Random(9)
    data = list(enumerate(copies(rng, 120, 60, 3)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.groups(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == brute_groups(data, 90)


def test_groups_odd(spark):
    r = jaccard_join.groups(odd(spark)).collect()
    assert len(r) == 10 and {x.component_id for x in r if x.doc_id in (5, 6)} == {5} and all(x.component_id is None for x in r if x.doc_id is None)
    assert jaccard_join.groups(docs(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (103, 102), (102, 101)]
    got = dict(jaccard_join.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 104)}}


# ---- toxicity


def test_toxicity(spark):
    rng = random.Random(4)
    plain = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(60)]
    data, lab = [], []
    for i in range(400):
        ws = [rng.choice(plain) for _ in range(40)]
        toxic = rng.random() < 0.3
        if toxic:
            ws[rng.randrange(40)] = ws[rng.randrange(40)] = "scoundrel"
        data.append((i, " ".join(ws)))
        lab.append((i, int(toxic)))
    d = spark.createDataFrame(data, "doc_id long, text string")
    m = toxicity.learn(d, spark.createDataFrame(lab, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(d, m, ["doc_id"]).collect()}
    out = [(got[i] >= 0.3, y) for i, y in lab if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(out) > 60 and sum(a == bool(b) for a, b in out) / len(out) > 0.9
    assert m.score("balo scoundrell mire") > m.score("balo mire")


def test_toxicity_held_out_accuracy(spark):
    big = "/root/testdata/sf0.1"
    lab = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    held = [r for r in QUERIES["op9_toxicity"](spark, big).collect() if r.held_out and r.doc_id in lab]
    hit = sum(r.predicted and lab[r.doc_id] for r in held)
    assert hit / max(1, sum(lab[r.doc_id] for r in held)) > 0.7 and hit / max(1, sum(r.predicted for r in held)) > 0.72
    assert abs(sum(r.score for r in held) / sum(lab[r.doc_id] for r in held) - 1) < 0.25  # calibrated


def test_toxicity_scores_are_the_means_of_words():
    """Scores by vectors against a plain sum over words and n-grams; bags survive packing."""
    rng = np.random.default_rng(1)
    m = toxicity.Model(rng.normal(size=toxicity.ROWS), -0.3)
    for text in ("a", "naïve naïve IDIOT x2", "জনগণ of বাংলাদেশ", "\U0001F600 ok \ud800 end", "w " * 3000 + "long"):
        ws = toxicity.words(text)
        each = [float(m.weights[toxicity.rows_of([w])[0]].mean()) for w in ws]
        assert math.isclose(m.score(text), 1 / (1 + math.exp(0.3 - sum(each) / len(each))), rel_tol=1e-5)
        used, share = toxicity.bag(text)
        again = toxicity.unpacked(*toxicity.packed(used, share))
        assert (again[0] == used).all() and np.allclose(again[1], share, rtol=2e-3) and math.isclose(share.sum(), 1, rel_tol=1e-4)
        assert len(toxicity.rows_of(["জনগণ"])[0]) == 1 + sum(max(0, 6 - n + 1) for n in range(3, 7))  # characters, not bytes
    dense = np.full(toxicity.ROWS, 1 / toxicity.ROWS, np.float32)
    assert np.allclose(toxicity.unpacked(*toxicity.packed(np.arange(toxicity.ROWS), dense))[1], dense, rtol=2e-3)


def test_toxicity_fits_on_packed_bags(spark, monkeypatch):
    """The driver holds four bytes for each row of a bag at most; the model is that of bags that are unpacked first."""
    seen, real = {}, toxicity.fit_calibrated

    def spy(bags, *rest):
        seen["bytes"] = sum(memoryview(x).nbytes for b in bags for x in b)
        seen["rows"] = sum(len(toxicity.unpacked(*b)[0]) for b in bags)
        return real(bags, *rest)

    monkeypatch.setattr(toxicity, "fit_calibrated", spy)
    sf = "/root/testdata/sf0.001"
    m = toxicity.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert 0 < seen["bytes"] <= 4 * seen["rows"] and len(m.weights) == toxicity.ROWS


def test_toxicity_odd(spark):
    m = toxicity.learn(odd(spark), labels(spark))
    r = toxicity.score(odd(spark), m).collect()
    assert len(r) == 10 and all(0 <= x.score <= 1 for x in r)
    none = toxicity.learn(docs(spark), labels(spark).limit(0))
    assert none.score(None) < 0.01 and toxicity.score(docs(spark), none).count() == 0


# ---- decontamination


def brute_hits(text, items, width=13):
    w = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    ws = w.findall((text or "").translate(FOLD))
    hit, ids = set(), set()
    for i, t in items:
        iw = w.findall((t or "").translate(FOLD))
        k = min(width, len(iw))
        for s in range(len(iw) - k + 1 if k else 0):
            for p in range(len(ws) - k + 1):
                if ws[p : p + k] == iw[s : s + k]:
                    hit |= set(range(p, p + k))
                    ids.add(str(i))
    return len(ws), len(hit), sorted(ids)


@pytest.mark.parametrize("most", [10**6, 40])
def test_decontamination(spark, most):
    rng = random.Random(6)
    item = lambda n: " ".join(rng.choice("abcdé") for _ in range(n))
    items = [(10, item(5)), (9, item(4)), (2, item(1)), (11, item(7)), (3, ""), (4, None), (5, "...")]
    texts = [" - ".join(rng.choice("ABcdÉé1") for _ in range(rng.randrange(60))) for _ in range(60)] + [items[3][1].upper(), "", None]
    b = spark.createDataFrame(items, "item_id long, text string")
    for r in decontamination.find_overlaps(docs(spark, *texts), b, 4, ["doc_id"], most).collect():
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(texts[r.doc_id], items, 4)


def test_decontamination_by_text_ids(spark):
    b = spark.createDataFrame([("x10", "one two"), ("x9", "two three"), ("é,", "three one")], "item_id string, text string")
    r = decontamination.find_overlaps(docs(spark, "one two three", "three two one", "three one two"), b, 2, ["doc_id"], 3).orderBy("doc_id").collect()
    assert [x["items"] for x in r] == [["x10", "x9"], [], ["x10", "é,"]] and [x.n_hit for x in r] == [3, 0, 3]


def test_decontamination_odd(spark):
    b = spark.createDataFrame([(1, "w1 w2 w3 w4"), (None, "one"), (2, None)], "item_id long, text string")
    d = odd(spark)
    r = decontamination.find_overlaps(d, b).collect()
    assert len(r) == 10 and sorted(x.n_hit > 0 for x in r) == [False] * 7 + [True] * 3
    assert all(x.n_hit == 0 for x in decontamination.find_overlaps(d, b.limit(0)).collect())
    assert decontamination.find_overlaps(docs(spark), b).count() == 0


# ---- the registered queries without SQL, on whole tables


def corpus(sf, name="documents", columns="*"):
    return sql(sf, f"SELECT {columns} FROM {name}")


def test_op3_on_the_table(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    got = collections.defaultdict(list)
    rows_ = QUERIES["op3_best_fit_packing"](spark, sf).collect()
    for r in rows_:
        got[r.doc_id].append(r)
    total = 0
    for d in corpus(sf).itertuples():
        ids = np.array(tok.encode(d.text or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        want = [(k, 2048 * k, len(ids[2048 * k : 2048 * k + 2048]), zlib.crc32(ids[2048 * k : 2048 * k + 2048].tobytes())) for k in range(-(-len(ids) // 2048))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got[d.doc_id]) == want
    assert check_places(rows_, 2048) <= 1.02 * total / 2048 + 2


def test_op4_on_the_table(spark, sf):
    """Scores from the parts that the row shows: evidence moved by the posterior of the others of its path."""
    r = QUERIES["op4_quality_classifier"](spark, sf).collect()
    lab = corpus(sf, "labels").set_index("doc_id").quality.to_dict()
    assert sorted(x.doc_id for x in r) == sorted(corpus(sf).doc_id)
    value = {x.doc_id: float(lab[x.doc_id]) if x.doc_id in lab and not x.held_out else x.doc_score for x in r}
    base = sum(value.values()) / len(value)
    odds = lambda p: math.log(max(p, 1e-6) / max(1 - p, 1e-6))
    for x in r:
        want = 1 / (1 + math.exp(-(odds(x.doc_score) + odds(x.path_score) - odds(base))))
        assert math.isclose(x.score, want, rel_tol=1e-6, abs_tol=1e-9) and x.kept == (x.score >= 0.5)
    held = [x for x in r if x.held_out and x.doc_id in lab]
    assert sum(x.kept == bool(lab[x.doc_id]) for x in held) / len(held) > 0.8


def test_op5_on_the_table(spark, sf):
    got = {r.page_id: r for r in QUERIES["op5_url_filters"](spark, sf).collect()}
    ruled = 0
    for p in corpus(sf, "pages").itertuples():
        r, (host, path, rule, verdict) = got.pop(p.page_id), brute_rule(p.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.block_score >= 0.5 else "allow"))
        ruled += verdict is None or (r.block_score >= 0.5) == (verdict == "block")
    assert not got and ruled >= 0.95 * len(corpus(sf, "pages"))  # the model agrees with the rules that it learned from


def test_op7_on_the_table(spark, sf):
    got = QUERIES["op7_sharding"](spark, sf).collect()
    want = sql(sf, "SELECT doc_id, sha256(text) AS h FROM documents")
    assert sorted((r.doc_id, r.text_sha256) for r in got) == sorted(zip(want.doc_id, want.h)) and all(r.shard_id >= 1 for r in got) and len({r.version for r in got}) == 1


# ---- shared


def test_stage_is_in_the_shared_folder(spark):
    inside, top = (hadoop(spark, p) for p in (stage(docs(spark, "a"), "x").inputFiles()[0], shared_dir(spark)))
    plain = lambda x: x[0].makeQualified(x[1]).toUri().getPath()
    assert plain(inside).startswith(plain(top) + "/")
