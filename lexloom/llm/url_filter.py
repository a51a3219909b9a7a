"""URL filters: rules by host and path, and for the rest a logistic regression on hashed character n-grams.

The regression sees the character n-grams of host and path, hashed to a fixed number of features, and learns from a
small table of labelled URLs. Training and scoring are DataFrame operations: hashing by SQL functions, and Spark's own
DataFrame estimator, which runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stage

#: (host/path, verdict). A rule holds for its host and all hosts below, for paths that start with its path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
FEATURES, SHORTEST, LONGEST = 1 << 13, 2, 5
#: Labelled URLs that the model is fitted on at most.
SAMPLE = 4000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. rules is a short list."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later, longer ones win
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def grams(host: str, path: str, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """Features of a URL: the n-grams of host and path between marks, as strings, digits of the path as 0."""
    parts = []
    for kind, text in (("h", f"concat('^', {host}, '$')"), ("p", f"concat('^', regexp_replace({path}, '[0-9]+', '0'), '$')")):
        parts += [f"transform(sequence(1, greatest(length({text}) - {n - 1}, 1)), i -> concat('{kind}', substring({text}, i, {n})))" for n in range(shortest, longest + 1)]
    return F.array_distinct(F.expr(f"concat({', '.join(parts)})"))


def fit(labelled: DataFrame, sample: int = SAMPLE):
    """A fitted pipeline from rows (host, path, label: 1 for block, 0), or None without rows of both labels.

    Distinct (host, path) count once, as 1 if they have both labels; at most `sample` of them are used, half of each
    label where there are so many, those with the least hash. Each label weighs as much as it has addresses in all.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    rows = labelled.where("host is not null and path is not null and label in (0, 1)").groupBy("host", "path").agg(F.max("label").cast("double").alias("label"))
    rows = stage(rows, "addresses")
    counts = dict(rows.groupBy("label").count().collect())
    if len(counts) < 2:
        return None
    few = min(sample // 2, min(counts.values()))
    take = {y: few if n == min(counts.values()) else min(n, sample - few) for y, n in counts.items()}
    order = (F.xxhash64("host", "path"), "host", "path")
    each = [rows.where(F.col("label") == y).orderBy(*order).limit(n).withColumn("weight", F.lit(counts[y] / n)) for y, n in sorted(take.items())]
    rows = stage(each[0].unionByName(each[1]).withColumn("grams", grams("host", "path")), "labelled")
    hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features")
    return PipelineModel([hashing, LogisticRegression(regParam=0.001, maxIter=60, weightCol="weight").fit(hashing.transform(rows))])


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, sample: int = SAMPLE, cut: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score of each row of pages; repeated rows are judged one by one.

    labelled has url and label (1 for block); without it the URLs that a rule decides are the labels. A URL without a
    rule is blocked from a score of `cut` on, and allowed if there was nothing to learn from. Null URLs have empty
    host and path, and very long ones are read whole. A table without rows gives none. Only page_id and url are read,
    so no other column can clash.
    """
    from pyspark.ml.functions import vector_to_array

    rows = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    if labelled is None:
        known = rows.where("rule is not null").select("host", "path", (F.col("ruled") == "block").cast("int").alias("label"))
    else:
        known = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label")
    model = fit(known, sample)
    if model is None:
        scored = rows.withColumn("block_score", F.lit(0.0))
    else:
        scored = model.transform(rows.withColumn("grams", grams("host", "path"))).withColumn("block_score", vector_to_array("probability")[1])
    learned = F.when(F.col("block_score") >= cut, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "block_score")
