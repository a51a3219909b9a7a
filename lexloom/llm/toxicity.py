"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of itself and its character n-grams, each hashed to one of a fixed number of embedding rows, so that
a misspelling shares most of its vector with the word that it hides. A document is the mean of its words' vectors.
The embeddings and the softmax weights are learned together; the embeddings start from the log ratio of each row's
mean share in the two labels. For scoring, every row is projected on the difference of the two classes' weights
beforehand; a document's logit is then a mean of numbers, and any text costs one look-up a word.

Scores are calibrated: the sample is dealt into folds, a model is fitted without each of them and scores it, and a
scale and a shift of these held-back logits are chosen by the likelihood under the labels' true shares. The mean of
the folds' models, which are linear in the same rows, is the model, so that no single seed decides.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import held_out, ship

#: Labelled documents that a model is fitted on at most, half of them of each label where there are so many.
SAMPLE = 4000
ROWS, DIM, EPOCHS, BATCH, RATE, SCALE, DECAY = 1 << 16, 4, 6, 32, 0.03, 60.0, 3e-5
SHORTEST, LONGEST = 3, 6
#: Rows that fewer labelled documents touch stay at zero. What is added to mean shares before their ratio is taken.
SEEN, SMOOTH = 3, 2e-5
FOLDS = 4
CACHE = 300_000
_WORD = re.compile(r"\w+")
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def rows_of(ws: list[str], rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The embedding rows of each word, and the word's index beside each: its n-grams between end marks, and the whole."""
    marked = "".join([f"<{w}>" for w in ws])
    code = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    size = np.fromiter(map(len, ws), np.int64, len(ws)) + 2
    word, start = np.repeat(np.arange(len(ws)), size), np.cumsum(size) - size
    with np.errstate(over="ignore"):
        place = np.cumprod(np.full(int(size.max(initial=1)), _ODD))
        whole = np.add.reduceat(code * place[np.arange(len(code)) - start[word]], start) + np.uint64(77) if len(ws) else code
        at, of = [whole], [np.arange(len(ws))]
        for n in range(SHORTEST, LONGEST + 1):
            if len(code) >= n:
                gram = code[: len(code) - n + 1] * place[0]
                for k in range(1, n):
                    gram = gram + code[k : len(code) - n + 1 + k] * place[min(k, len(place) - 1)]
                inside = word[: len(gram)] == word[n - 1 :]
                at.append(gram[inside] + np.uint64(n))
                of.append(word[: len(gram)][inside])
        h = np.concatenate(at)
        h = (h ^ (h >> np.uint64(33))) * _MIX
        return ((h >> np.uint64(40)) & np.uint64(rows - 1)).astype(np.int64), np.concatenate(of)


class Model:
    """weights: each row's projection; bias. logit = bias + mean over words of the mean over the word's rows."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def values(self, ws: list[str]) -> list[float]:
        """What each word adds before the mean over words is taken."""
        at, of = rows_of(ws, len(self.weights))
        return (np.bincount(of, self.weights[at], len(ws)) / np.maximum(np.bincount(of, minlength=len(ws)), 1)).tolist()

    def scores(self, texts: list[str | None], known: dict[str, float]) -> list[float]:
        """From 0 to 1; texts without words get the bias's score. known: a cache of words' values."""
        bags = [Counter(words(t)) for t in texts]
        if len(known) > CACHE:
            known.clear()
        new = [w for w in {}.fromkeys(w for b in bags for w in b) if w not in known]
        for at in range(0, len(new), 1 << 15):
            known.update(zip(new[at : at + (1 << 15)], self.values(new[at : at + (1 << 15)])))
        out = []
        for b in bags:
            logit = self.bias + (math.sumprod(b.values(), map(known.__getitem__, b)) / b.total() if b else 0.0)
            out.append(1 / (1 + math.exp(-max(-60.0, min(60.0, logit)))))
        return out

    def score(self, text: str | None) -> float:
        return self.scores([text], {})[0]


def bag(text: str | None, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The rows that a text touches, in order, and their shares in the mean."""
    counts = Counter(words(text))
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    at, of = rows_of(list(counts), rows)
    each = np.fromiter(counts.values(), np.float64, len(counts)) / counts.total() / np.bincount(of, minlength=len(counts))
    share = np.bincount(at, each[of], rows)
    used = np.flatnonzero(share)
    return used, share[used].astype(np.float32)


def packed(used: np.ndarray, share: np.ndarray, rows: int = ROWS) -> tuple[bytes, bytes]:
    """A bag in 4 bytes a row, or 2 for each row there is where that is less; shares to one part in a thousand."""
    small = (share / share.max(initial=1e-30) * 3e4).astype(np.float16)
    if 2 * len(used) <= rows:
        return used.astype(np.uint16).tobytes(), small.tobytes()
    dense = np.zeros(rows, np.float16)
    dense[used] = small
    return b"", dense.tobytes()


def unpacked(at: bytes | pa.Buffer, share: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    s = np.frombuffer(share, np.float16).astype(np.float32)
    used = np.frombuffer(at, np.uint16).astype(np.int32) if at else np.flatnonzero(s).astype(np.int32)
    s = s if at else s[used]
    return used, s / max(float(s.sum()), 1e-30)


def fit(bags: list[tuple[bytes, bytes]], labels: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Row weights and bias that minimise the cross-entropy, both labels weighing the same, by Adam.

    bags: as packed() makes them; those of one batch at a time are unpacked.
    """
    rng, n = np.random.default_rng(seed), len(bags)
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * n
    seen, mass = np.zeros(ROWS, np.int64), np.zeros((2, ROWS))
    for bag_, y in zip(bags, labels):
        used, share = unpacked(*bag_)
        seen[used] += 1
        mass[y, used] += share
    mass /= np.maximum(np.bincount(labels, minlength=2), 1)[:, None]
    learned = seen >= SEEN
    table = rng.normal(0, 0.05, (ROWS, DIM)).astype(np.float32)
    table[:, 0] = np.clip(np.log((mass[1] + SMOOTH) / (mass[0] + SMOOTH)), -3, 3)
    table[~learned] = 0
    heads, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    heads[0] = -0.25, 0.25
    params, step = [table, heads, bias], 0
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            chosen = order[at : at + BATCH]
            batch = [unpacked(*bags[i]) for i in chosen]
            rows = np.concatenate([used for used, _ in batch])
            share = np.concatenate([s for _, s in batch]) * np.float32(SCALE)
            doc = np.repeat(np.arange(len(chosen)), [len(used) for used, _ in batch])
            mean = np.stack([np.bincount(doc, share * table[rows, d], len(chosen)) for d in range(DIM)], 1)
            logits = mean @ heads + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), labels[chosen]] -= 1
            error = p * (weight[chosen] / len(chosen))[:, None]
            back = (error @ heads.T).astype(np.float32)
            to_rows = np.stack([np.bincount(rows, share * back[doc, d], ROWS) for d in range(DIM)], 1) + DECAY * table
            to_rows[~learned] = 0
            step += 1
            rate = RATE * (1 - (epoch * n + at) / (EPOCHS * n))
            for param, (m, v), g in zip(params, moments, (to_rows, mean.T @ error + DECAY * heads, error.sum(0))):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                param -= (rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return (table @ (heads[:, 1] - heads[:, 0])) * SCALE, float(bias[1] - bias[0])


def logits_of(bags, weights: np.ndarray, bias: float) -> np.ndarray:
    return np.array([bias + float(share @ weights[used]) for used, share in (unpacked(*b) for b in bags)])


def calibrated(logits: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logits with the least weighted cross-entropy; scales from a tenth to three."""
    best = (math.inf, 1.0, 0.0)
    for scale in np.geomspace(0.1, 3, 30):
        z, shift = np.clip(scale * logits, -40, 40), 0.0
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z + shift, -40, 40)))
            shift -= float(np.clip((weight * (p - labels)).sum() / ((weight * p * (1 - p)).sum() + 1e-9), -2, 2))
        p = np.clip(1 / (1 + np.exp(-np.clip(z + shift, -40, 40))), 1e-9, 1 - 1e-9)
        loss = -float((weight * np.where(labels == 1, np.log(p), np.log(1 - p))).sum())
        best = min(best, (loss, float(scale), shift))
    return best[1:]


def fit_calibrated(bags, labels: np.ndarray, folds: np.ndarray, prior: float) -> Model:
    """The mean of a model for each fold, calibrated on the folds held back; prior: the true share of label 1."""
    held, weights, bias, models = np.zeros(len(bags)), np.zeros(ROWS), 0.0, 0
    for k in range(FOLDS):
        rest, out = np.flatnonzero(folds != k), np.flatnonzero(folds == k)
        if len(np.unique(labels[rest])) < 2:  # too few to hold any back
            rest = np.arange(len(bags))
        w, b = fit([bags[i] for i in rest], labels[rest], k)
        held[out] = logits_of([bags[i] for i in out], w, b)
        weights, bias, models = weights + w, bias + b, models + 1
    true = np.where(labels == 1, prior / max(1, (labels == 1).sum()), (1 - prior) / max(1, (labels == 0).sum())) * len(bags)
    scale, shift = calibrated(held, labels, true)
    return Model(scale * weights / models, scale * bias / models + shift)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from the labelled documents that are not held out.

    At most `sample` documents are used, half of them of each label where there are so many, those with the least hash
    of their id; each has its whole text, and reaches the driver as at most 2 * ROWS bytes. The share of label 1 is
    counted over all labelled rows. A document with both labels counts as 1; labels that are neither 0 nor 1, and rows
    without id, are left out. Rows that share a doc_id are a document each. Without a labelled document of both labels
    the model gives every text that share (0 if there is none). Only doc_id, text and the label are read.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = dict(known.groupBy("y").count().collect())
    n = sum(counts.values())
    prior = counts.get(1, 0) / n if n else 0.0
    alone = Model(np.zeros(1), math.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if len(counts) < 2:
        return alone
    few = min(sample // 2, min(counts.values()))
    take = {y: few if c == min(counts.values()) else min(c, sample - few) for y, c in counts.items()}
    order = F.xxhash64("doc_id")
    each = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(take[y]) for y in (0, 1)]
    chosen = F.broadcast(each[0].unionByName(each[1]))  # at most `sample` rows of two numbers
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(chosen, "doc_id").mapInArrow(_bags, "doc_id long, y int, rows binary, shares binary").toArrow()
    columns = "doc_id", "y", "rows", "shares"
    order = pc.sort_indices(found, [(c, "ascending") for c in columns]).to_pylist()
    bags = [(found["rows"][i].as_buffer(), found["shares"][i].as_buffer()) for i in order]  # no copies
    ids, y = (np.array(found[c].to_pylist(), np.int64)[order] for c in columns[:2])
    if len(np.unique(y)) < 2:
        return alone
    with np.errstate(over="ignore"):
        folds = ((ids.view(np.uint64) * _ODD) >> np.uint64(40)) % np.uint64(FOLDS)  # rows of one document share a fold
    model = fit_calibrated(bags, y, folds.astype(int), prior)
    del found, bags
    _give_back()
    return model


def _give_back() -> None:
    """Return freed memory to the system; glibc keeps what the fit took, for as long as the driver lives."""
    with contextlib.suppress(OSError, AttributeError, TypeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def _bags(batches):
    for b in batches:
        out = [packed(*bag(t.as_py())) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["doc_id", "y", "rows", "shares"])


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all) and score, from 0 to 1, of each whole text, however long.

    Null, empty and wordless texts get the bias's score. Repeated rows get one score each, the same. A column of docs
    named score is replaced. A table without rows gives none.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = source.select(*keep, F.lit(0.0).alias("score")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, known = shared.value, {}
        for b in batches:
            texts, scores = b.column("text"), []
            for at in range(0, len(texts), 64):
                scores += m.scores(texts.slice(at, 64).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(scores, pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)


ship(__name__)
