"""Which texts hold which lines, by an inverted index of the lines' words.

A line that stands in a text brings its inner words with it, those with a word before and after them: they stand there
as whole words too. So a text is a candidate for a line only if it has the line's rarest inner pair of words, or, where
there is no pair, its inner word. The index has a hash and an id for each of the lines' pairs in each text; texts are
read twice, once for the index and once to confirm what it found, and are in no row of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

GAP = "[ \\t\\n\\r\\f]+"
#: Candidates up to this number are broadcast; texts are then not shuffled.
BROADCAST = 200_000


def words(c: Column) -> Column:
    return F.split(F.regexp_replace(c, f"^{GAP}|{GAP}$", ""), GAP, -1)


def _grams(w: Column, single: bool) -> Column:
    """Hashes of the pairs of neighbours in a column of words, and of the words themselves if asked for."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda x, y: F.xxhash64(x, y))
    ones = F.transform(w, lambda x: F.xxhash64(x))
    return F.concat(pairs, ones) if single else pairs


def _inner(line: Column) -> Column:
    w = words(line)
    return F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0)))


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = scratch.folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pairs(texts: DataFrame, lines: DataFrame, text_id: str = "doc_id", text: str = "text", line_id: str = "line_id", line: str = "line", by: list[str] | None = None) -> DataFrame:
    """The distinct (text_id, line_id), with the columns `by`, of texts that hold a line as it is.

    by: columns that both sides have and that must be equal, such as the document; without them every text is asked.
    Lines of three words or more are found through the index. Shorter ones have no inner word; they are compared with
    the texts of their `by` alone and are left out without it. Null texts, lines and ids are in no pair; rows that share
    an id are one text or one line. All sides may be large; words that many texts have are only asked for where a line
    has nothing rarer.
    """
    by = list(by or [])
    t = texts.select(*by, F.col(text_id).alias("__t"), F.col(text).alias("__text")).where("__t is not null and __text is not null")
    l = lines.select(*by, F.col(line_id).alias("__l"), F.col(line).alias("__line")).where("__l is not null and __line is not null")
    long = _staged(l.withColumn("__w", _inner(F.col("__line"))).where("size(__w) > 0"), "lines")
    asked = long.select(*by, "__l", F.explode(F.array_distinct(F.when(F.size("__w") > 1, _grams(F.col("__w"), False)).otherwise(_grams(F.col("__w"), True)))).alias("__g"))
    asked = _staged(asked, "asked")
    # how often a pair of words is in texts is counted for the lines' pairs alone
    held = t.withColumn("__w", words(F.col("__text"))).select(*by, "__t", F.explode(F.array_distinct(_grams(F.col("__w"), True))).alias("__g"))
    wanted = asked.select(*by, "__g").distinct()
    postings = _staged(held.join(wanted, [*by, "__g"], "left_semi"), "postings")
    counts = postings.groupBy(*by, "__g").agg(F.count("*").alias("__n"))
    rarest = asked.join(counts, [*by, "__g"]).groupBy(*by, "__l").agg(F.min(F.struct("__n", "__g"))["__g"].alias("__g"))
    candidates = _staged(postings.join(_staged(rarest, "rarest"), [*by, "__g"]).select(*by, "__t", "__l").distinct(), "candidates")
    asked_texts = candidates.join(long.drop("__w"), [*by, "__l"])
    side = F.broadcast(asked_texts) if candidates.count() <= BROADCAST else asked_texts
    out = t.join(side, [*by, "__t"]).where(F.contains("__text", "__line")).select(*by, "__t", "__l")
    if by:
        short = l.where(F.size(_inner(F.col("__line"))) <= 0)
        out = out.unionByName(t.join(short, by).where(F.contains("__text", "__line")).select(*by, "__t", "__l"))
    return out.distinct().select(*by, F.col("__t").alias(text_id), F.col("__l").alias(line_id))
