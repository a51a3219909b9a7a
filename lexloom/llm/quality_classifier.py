"""Quality classifier by hierarchical empirical Bayes.

A logistic regression on measures of a text gives each document's own evidence. Documents are then pooled by host, and
by path within the host: grouped sums of what is known of each document, its label if the model may see it, else its
probability. The spread between hosts beyond what chance explains sets how far a host's rate is drawn to the global
one, and in the same way the paths to their host. A document's score is its own evidence, moved by the posterior of
its path, from which its own part is taken out, in the path as in the host.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import held_out, numbered, ship, stage

#: Labelled documents that the regression is fitted on at most.
SAMPLE = 8000
RIDGE, ROUNDS = 1.0, 25
NO_SPREAD = 1e12
FEATURES = ("log words", "mean word length", "symbols a word", "capitals a letter", "digits a character", "bars a word", "exclamations a word", "distinct words a root of words", "repeated lines", "commonest word", "stops a word", "bias")
_UPPER = {c: None for c in range(128) if not chr(c).isupper()}


def features(text: str | None) -> list[float]:
    ws = text.split() if text else []
    if not ws:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    n, size = len(ws), len(text)
    counts: dict[str, int] = {}
    for w in ws:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    symbols = sum(map(text.count, "#*$%&|<>"))
    capitals = sum(map(str.isupper, text)) if not text.isascii() else len(text.translate(_UPPER))
    digits = sum(map(text.count, "0123456789"))
    return [
        math.log(n), size / n, symbols / n, capitals / size, digits / size, text.count("|") / n, text.count("!") / n,
        len(counts) / math.sqrt(n), 1 - len(set(lines)) / len(lines), max(counts.values()) / n, text.count(".") / n, 1.0,
    ]


class Model:
    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray):
        self.mean, self.spread, self.weights = mean, spread, weights

    def score(self, rows: list[list[float]]) -> np.ndarray:
        z = np.clip((np.array(rows).reshape(-1, len(self.mean)) - self.mean) / self.spread, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Newton's method with a ridge. Without rows every score is a half."""
    n = len(FEATURES)
    if not len(x):
        return Model(np.zeros(n), np.ones(n), np.zeros(n))
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    mean[-1], spread[-1] = 0.0, 1.0
    z, w, ridge = np.clip((x - mean) / spread, -8, 8), np.zeros(n), RIDGE * np.eye(n)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -12, 12)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return Model(mean, spread, w)


def learn(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> tuple[Model, DataFrame]:
    """The regression, and (doc_id, y) of the labels that may be learned from: not held out, one for each document, 1 if it has both."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # at most `sample` rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(chosen, "doc_id").mapInArrow(_featured, "doc_id long, y int, x array<double>").collect()
    rows.sort(key=lambda r: (r[0], r[2]))
    return fit(np.array([r[2] for r in rows]).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], float)), known


def _featured(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([features(t.as_py()) for t in b.column("text")], pa.list_(pa.float64()))], names=["doc_id", "y", "x"])


def _scored(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            p = model.score([features(t.as_py()) for t in b.column("text")])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "host", "path")), pa.array(p, pa.float64())], names=["doc_id", "host", "path", "p"])

    return run


def strength(groups: DataFrame) -> float:
    """How many documents the prior of a group weighs: the variance within groups over the one between them.

    Without any spread between groups beyond chance it is NO_SPREAD, by which all are drawn to the prior in full.

    groups: n, s and q, the number, sum and sum of squares of each group, and `up`, the rate that it is drawn to.
    """
    g = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("inside"), F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("up")) ** 2).alias("between"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not g["k"] or g["n"] <= g["k"]:  # no group has two documents
        return 1.0
    inside = max(g["inside"] / (g["n"] - g["k"]), 1e-9)
    between = (g["between"] - g["k"] * inside) / max(g["n"] - g["nn"] / g["n"], 1e-9)
    return inside / between if between > inside / NO_SPREAD else NO_SPREAD


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", label: str = "quality", sample: int = SAMPLE, cut: float = 0.5) -> DataFrame:
    """doc_id, held_out, doc_score, host_score, path_score, score and kept of each row of docs; scores from 0 to 1.

    host_score and path_score are of the other documents there: a document's own label or probability is in neither.

    Null hosts are a host of their own, null paths a path of their own. Null and empty texts are scored by the bias,
    and texts of any length as a whole.
    Without labels doc_score is a half. Repeated rows count each. A table without rows gives none. Only doc_id, text, host and path are read.
    """
    model, known = learn(docs, labels, label, sample)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = source.mapInArrow(_scored(shared), "doc_id long, host string, path string, p double").join(known, "doc_id", "left")
    rows = stage(numbered(scored.withColumn("v", F.coalesce(F.col("y").cast("double"), "p")).drop("y")), "evidence")
    sums = [F.count("*").cast("double").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")]
    paths = stage(rows.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    total = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    base = min(max(0.5 if total is None else total, 1e-6), 1 - 1e-6)
    at_host = strength(hosts.withColumn("up", F.lit(base)))
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("n_host"), F.col("s").alias("s_host"))
    paths = paths.join(hosts, paths["host"].eqNullSafe(hosts["h"])).drop("h")
    at_path = strength(paths.withColumn("up", (F.col("s_host") + at_host * base) / (F.col("n_host") + at_host)))
    paths = paths.select(F.col("host").alias("h"), F.col("path").alias("f"), "n", "s", "n_host", "s_host")
    out = rows.join(paths, rows["host"].eqNullSafe(paths["h"]) & rows["path"].eqNullSafe(paths["f"]))
    out = out.withColumn("host_score", (F.col("s_host") - F.col("v") + at_host * base) / (F.col("n_host") - 1 + at_host))
    others = (F.col("s") - F.col("v") + at_path * F.col("host_score")) / (F.col("n") - 1 + at_path)
    odds = lambda p: F.log(F.greatest(p, F.lit(1e-6)) / F.greatest(1 - p, F.lit(1e-6)))
    out = out.withColumn("path_score", others)
    out = out.withColumn("score", 1 / (1 + F.exp(-(odds(F.col("p")) + odds(F.col("path_score")) - math.log(base / (1 - base))))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("p").alias("doc_score"), "host_score", "path_score", "score", (F.col("score") >= cut).alias("kept"))


ship(__name__)
