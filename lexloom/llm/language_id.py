"""Language identification by words first, then by ever shorter character n-grams.

Words that are frequent enough in the training documents have a log frequency for each language. Any other word is
scored by the longest of its character n-grams that are known, from LONGEST letters down to one. Counts are taken over
all training documents by grouped aggregation. The model, which the driver collects and the executors get as a
broadcast, is a table of bounded size: each language has the same share of it, and within its n-grams each length has,
which the language's own most frequent ones fill. What a language keeps so depends on its own texts and on the number
of languages, not on how much there is of the others.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import held_out, ship, stage

#: Words and n-grams that the model holds at most, dealt evenly to the languages; the least count of a word in its
#: language, the longest n-gram.
WORDS, GRAMS, LEAST, LONGEST = 120_000, 120_000, 3, 4
UNKNOWN = "und"
#: Scores of a language and a word or n-gram that a table has at most; with many languages it has fewer words.
SCORES = 40_000_000
#: Parts in which equally frequent keys of a language are ranked before they are ranked together.
PARTS = 64
#: Words and scores that a task keeps of those that it worked out.
CACHE, CACHED_SCORES = 200_000, 20_000_000
_RUN = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters, in lower case."""
    found = _RUN.findall(text.lower())
    if not all(map(str.isalpha, found)):  # digits of other kinds
        found = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return found


class Model:
    """words and grams: each key's row in the scores, which have a column for each language."""

    def __init__(self, languages: list[str], words: tuple[list[str], np.ndarray], grams: tuple[list[str], np.ndarray]):
        self.languages = languages
        self.words = {w: i for i, w in enumerate(words[0])}
        self.word_scores = _relative(words[1])
        self.grams = {g: i for i, g in enumerate(grams[0])}
        self.gram_scores = _relative(grams[1], [len(g) for g in grams[0]])


def _relative(counts: np.ndarray, kinds: list[int] | None = None) -> np.ndarray:
    """Log frequencies for each language, with one added to each count, less their mean over the languages."""
    kind = np.zeros(len(counts), int) if kinds is None else np.array(kinds, int)
    scores = np.empty(counts.shape, np.float32)
    for k in np.unique(kind):
        total = np.log(counts[kind == k].sum(0) + (kind == k).sum())
        for i in np.flatnonzero(kind == k):  # a row at a time, as the table may be large
            row = np.log(counts[i] + 1) - total
            scores[i] = row - row.mean()
    return scores


class _Known(dict):
    """Each word's row in `rows`: its own if it is known, else one worked out from its n-grams."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model, self.first = model, len(model.words)
        self.cache = max(1, min(CACHE, CACHED_SCORES // max(1, len(model.languages))))
        self.rows = np.concatenate([model.word_scores, np.zeros((self.cache, len(model.languages)), np.float32)])
        self.next = self.first

    def make_room(self, n: int) -> None:
        if self.next + n > len(self.rows):
            self.clear()
            self.update(self.model.words)
            self.rows = np.concatenate([self.model.word_scores, np.zeros((max(self.cache, n), len(self.model.languages)), np.float32)])
            self.next = self.first

    def __missing__(self, word: str) -> int:
        marked, grams = f"<{word}>", self.model.grams
        for n in range(min(LONGEST, len(marked)), 0, -1):
            at = [grams[g] for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in grams]
            if at:
                self.rows[self.next] = self.model.gram_scores[at].mean(0)
                break
        else:
            self.rows[self.next] = 0
        self[word] = row = self.next
        self.next += 1
        return row


def identify(text: str | None, known: _Known) -> tuple[str, float]:
    """Language and score. The score is the softmax over languages of the mean score times the root of the number of words."""
    counts = Counter(words(text)) if text else None
    languages = known.model.languages
    if not counts or not languages:
        return UNKNOWN, 0.0
    known.make_room(len(counts))
    rows = np.fromiter(map(known.__getitem__, counts), np.int64, len(counts))
    n = np.fromiter(counts.values(), np.float64, len(counts))
    total = n @ known.rows[rows] / np.sqrt(n.sum())
    best = int(np.argmax(total))
    return languages[best], float(1 / np.exp(total - total[best]).sum())


def learn(docs: DataFrame, words_kept: int = WORDS, grams_kept: int = GRAMS) -> Model:
    """Counts the words of all documents that have a language and text and are not held out.

    Ties in frequency go to the word that sorts first. Without such documents, as in a table without rows, the model
    knows no language. Repeated rows count each; texts of any length are counted whole. There may be any number of
    languages; each has the same share of the table. Only doc_id, text and lang are read.
    """
    train = docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    each = train.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    counts = stage(each.groupBy("word", "lang").agg(F.count("*").alias("n")), "words")
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    marked = F.concat(F.lit("<"), "word", F.lit(">"))
    size = F.length(marked)
    grams = F.flatten(F.array(*[F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), partial(_cut, marked, n))).otherwise(F.array().cast("array<string>")) for n in range(1, LONGEST + 1)]))
    pieces = counts.select(F.explode(grams).alias("gram"), "lang", "n").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    if not languages:
        return Model([], ([], np.zeros((0, 0))), ([], np.zeros((0, 0))))
    share = lambda kept, kinds: max(1, min(kept, SCORES // len(languages)) // (len(languages) * kinds))
    known = _top(counts, "word", languages, F.lit(0), share(words_kept, 1))
    return Model(languages, known, _top(stage(pieces, "grams"), "gram", languages, F.length("gram"), share(grams_kept, LONGEST)))


def _cut(text: Column, n: int, at: Column) -> Column:
    return F.substring(text, at, F.lit(n))


def _most_frequent(counts: DataFrame, key: str, kind: Column, most: int) -> DataFrame:
    """The keys that are among the `most` most frequent ones of a language and kind; of equally frequent ones those that sort first.

    A histogram of the counts says from which count on all keys are taken, and how many are missing then. Only keys
    with just that count are ranked, first in parts of each language and kind, so that no task has all of a language.
    """
    rows = counts.where(F.col("n") >= LEAST).withColumn("__kind", kind)
    group = ["lang", "__kind"]
    above = F.sum("__rows").over(Window.partitionBy(*group).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))
    histogram = rows.groupBy(*group, "n").agg(F.count("*").alias("__rows")).withColumn("__above", above).where(F.col("__above") > most)
    last = histogram.groupBy(*group).agg(F.max(F.struct("n", (most - F.col("__above") + F.col("__rows")).alias("need"))).alias("last"))
    found = rows.join(F.broadcast(last.select(*group, F.col("last.n").alias("__last"), F.col("last.need").alias("__need"))), group, "left")  # a row for each language and kind
    ties = found.where((F.col("n") == F.col("__last")) & (F.col("__need") > 0)).withColumn("__part", F.pmod(F.xxhash64(key), F.lit(PARTS)))
    for by in ([*group, "__part"], group):
        ties = ties.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(key))).where((F.col("__n") <= most) & (F.col("__n") <= F.col("__need")))
    return found.where(F.col("__last").isNull() | (F.col("n") > F.col("__last"))).select(key).unionByName(ties.select(key)).distinct()


def _top(counts: DataFrame, key: str, languages: list[str], kind: Column, most: int) -> tuple[list[str], np.ndarray]:
    """The `most` most frequent keys of each language and kind, in order, and their counts in all languages."""
    chosen = F.broadcast(_most_frequent(counts, key, kind, most))  # no more than the table holds
    place = {x: i for i, x in enumerate(languages)}
    rows: dict[str, int] = {}
    entries = [(rows.setdefault(r[0], len(rows)), place[r[1]], r[2]) for r in counts.join(chosen, key, "left_semi").orderBy(key).select(key, "lang", "n").toLocalIterator()]
    table = np.zeros((len(rows), len(languages)), np.float32 if len(languages) > 64 else np.float64)
    for row, column, n in entries:
        table[row, column] = n
    return list(rows), table


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all) with lang_pred and score of each whole text, however long.

    `und` and 0 for null and texts without a letter. Of languages that tie the first in order is taken. Repeated rows
    get the same answer each; columns of docs named as the two new ones are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = source.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = _Known(shared.value)
        for b in batches:
            out = [identify(t.as_py(), known) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)


ship(__name__)
