"""Centroid clustering by Elkan's bounds over integer vectors, with exact distances.

Each vector keeps an upper bound of the distance to its centroid and a lower bound for each centroid. A round moves the
bounds by how far the centroids moved and computes a distance only where neither a lower bound nor half the distance
between two centroids excludes the centroid. Bounds are floating-point numbers rounded outwards, and a centroid is
passed over only if the comparison is strict, so that ties are always computed; what decides is an exact integer.

A round is one pass without a shuffle over a staged table of vectors with their bounds, and one over its vectors and
clusters for the sums, of which each task gives as many as centroids have components. The driver has the centroids only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import delete_path, ship, staged

CLUSTERS, ROUNDS, SIZE, SCALE, SEED = 16, 3, 64, 64, 1
#: Scaled components of a larger magnitude could overflow the exact square distance of 64 of them.
LARGEST = 1 << 27
#: Relative slack of a bound: more than what a conversion, a square root and a sum or difference can be off together.
SLACK = 2.0**-50


def _up(x):
    return x * (1 + SLACK)


def _down(x):
    return np.maximum(x * (1 - SLACK), 0)


def _down32(x):
    """x as a 32-bit number that is not above it."""
    return np.maximum(np.nextafter(x.astype("<f4"), np.float32(-np.inf)), np.float32(0))


def exact(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of v to c, or to the same row of c."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def between(centroids: np.ndarray) -> np.ndarray:
    """Half the distances between centroids, none rounded up."""
    return _down(np.sqrt(np.stack([exact(centroids, c) for c in centroids]).astype(float))) / 2


def moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each centroid moved, none rounded down."""
    return _up(np.sqrt(exact(old, new).astype(float)))


def nearest(v, centroids, half, a=None, upper=None, lower=None, settle=False):
    """The nearest centroid of each row of v, the smaller number of equally near ones, with the bounds and the work done.

    a, upper, lower: the last round's answer and its bounds for the present centroids; without them the first centroid
    is where the search begins. settle: also compute the distances that bounds made needless.
    Returns a, squared distances (-1 where not computed), upper, lower, computed distances of each row.
    """
    n, k = len(v), len(centroids)
    if a is None:
        a, upper, lower = np.zeros(n, int), np.full(n, np.inf), np.zeros((n, k))
    square, computed, rows = np.full(n, -1), np.zeros(n, int), np.arange(n)

    def settled(at):
        at = at[square[at] < 0]
        if len(at):
            square[at] = exact(v[at], centroids[a[at]])
            root = np.sqrt(square[at].astype(float))
            upper[at], lower[at, a[at]] = _up(root), _down(root)
            computed[at] += 1

    gap = half + np.where(np.eye(k, dtype=bool), np.inf, 0)
    busy = rows[upper >= gap.min(1)[a]]  # the others are nearer than half the way to any other centroid
    for j in range(k):
        near = lambda at: at[(a[at] != j) & (upper[at] >= lower[at, j]) & (upper[at] >= half[a[at], j])]  # noqa: B023, E731
        at = near(busy)
        settled(at)
        at = near(at)
        if not len(at):
            continue
        d = exact(v[at], centroids[j])
        root = np.sqrt(d.astype(float))
        lower[at, j] = _down(root)
        computed[at] += 1
        better = (d < square[at]) | ((d == square[at]) & (j < a[at]))
        won = at[better]
        a[won], square[won], upper[won] = j, d[better], _up(root[better])
    if settle:
        settled(rows)
    return a, square, upper, lower, computed


def _matrix(column, dtype) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(dtype) if n else np.zeros((0, 1), dtype)


def _lists(m: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype="i4") * m.shape[1]), pa.array(m.ravel(), kind))


def _scaler(size: int, scale: int):
    def run(batches):
        for b in batches:
            e = b.column(1)
            full = np.asarray(e.is_valid()) & (np.asarray(e.value_lengths().fill_null(-1)) == size)
            b = b.filter(pa.array(full))
            values = b.column(1).flatten().cast(pa.float64())
            x = values.to_numpy(zero_copy_only=False).reshape(-1, size)
            good = np.isfinite(x).all(1) & np.asarray(values.is_valid()).reshape(-1, size).all(1)
            x = np.floor(x[good] * scale)
            if np.abs(x).max(initial=0) > LARGEST:
                raise ValueError(f"components over {LARGEST} / {scale} have no exact squared distance of 64 bits")
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), _lists(x.astype("<i4"), pa.int32())], names=["id", "v"])

    return run


def scaled(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """id and v: floor(scale * x) of each component, of vectors with `size` components that are all finite numbers."""
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("e"))
    return rows.mapInArrow(_scaler(size, scale), f"id {rows.schema['id'].dataType.simpleString()}, v array<int>")


def _assigner(centroids: np.ndarray, shift: np.ndarray | None, last: bool):
    half = between(centroids)

    def run(batches):
        for b in batches:
            v = _matrix(b.column("v"), "i8").reshape(-1, centroids.shape[1])
            if shift is None:
                found = nearest(v, centroids, half, settle=last)
            else:
                a = b.column("a").to_numpy().astype(int)
                upper = _up(b.column("upper").to_numpy() + shift[a])
                lower = _down(_matrix(b.column("lower"), float).reshape(-1, len(centroids)) - shift)
                found = nearest(v, centroids, half, a, upper, lower, settle=last)
            a, square, upper, lower, computed = found
            if shift is not None:
                computed = computed + b.column("computed").to_numpy()
            out = [b.column("id"), pa.array(a, pa.int32()), pa.array(computed, pa.int32())]
            out += [pa.array(square, pa.int64())] if last else [b.column("v"), pa.array(upper), _lists(_down32(lower), pa.float32())]
            yield pa.RecordBatch.from_arrays(out, names=["id", "a", "computed"] + (["square"] if last else ["v", "upper", "lower"]))

    return run


def _summer(k: int, size: int):
    """Sums of each cluster's components, and its vectors as component -1: one row each for a task."""

    def run(batches):
        sums, n = np.zeros((k, size), "i8"), np.zeros(k, "i8")
        for b in batches:
            a = b.column("a").to_numpy()
            v = _matrix(b.column("v"), "i8").reshape(-1, size)
            for j in np.unique(a):
                mine = v[a == j]
                sums[j] += mine.sum(0)
                n[j] += len(mine)
        there = np.flatnonzero(n)
        c, p = np.repeat(there, size + 1), np.tile(np.arange(-1, size), len(there))
        x = np.column_stack([n, sums])[there].ravel()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(p, pa.int32()), pa.array(x, pa.int64())], names=["a", "p", "x"])

    return run


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids moved to floor(sum / count) of each component; empty ones stay."""
    parts = state.select("a", "v").mapInArrow(_summer(*centroids.shape), "a int, p int, x long")
    total = {(r.a, r.p): int(r.x) for r in parts.groupBy("a", "p").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect()}
    new = centroids.copy()
    for j in {a for a, _ in total}:
        new[j] = [total[j, p] // total[j, -1] for p in range(centroids.shape[1])]
    return new


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """id, cluster, distance (squared) and computed (distances computed for the vector in all rounds), and the final centroids.

    Vectors with another number of components, with null or non-finite ones and null vectors are left out. Repeated
    rows, and rows that share an id, count each. The first centroids are the vectors whose sha256 of `seed:id` is
    least; null ids come last, equal ids in the order of their components. With fewer vectors than clusters there are
    as many centroids as vectors; a table without rows has neither. Ids that are null stay null. No other column of
    vectors is read. A component over 2^27 after scaling is refused, as its squared distance may not fit a long.
    """
    spark = vectors.sparkSession
    state, path = staged(scaled(vectors, vec_id, embedding, size, scale), "vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = state.orderBy(hashed.asc_nulls_last(), "v").limit(clusters).select("v").collect()
    centroids, shift = np.array([r.v for r in first], "i8").reshape(len(first), size), None
    key = f"id {state.schema['id'].dataType.simpleString()}"
    if not len(centroids):
        return spark.createDataFrame([], f"{key}, cluster int, distance long, computed int"), centroids
    for i in range(rounds + 1):
        last = i == rounds
        schema = f"{key}, a int, computed int, " + ("square long" if last else "v array<int>, upper double, lower array<float>")
        before = path
        state, path = staged(state.mapInArrow(_assigner(centroids, shift, last), schema), "assigned")
        delete_path(spark, before)  # the new table has all that the old one had
        if not last:
            new = _means(state, centroids)
            centroids, shift = new, moved(centroids, new)
    return state.select("id", F.col("a").alias("cluster"), F.col("square").alias("distance"), "computed"), centroids


def described(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """found with cluster_inertia, inertia (null if they don't fit a long) and centroid_sha256, of as many rows as centroids."""
    if not len(centroids):
        return found.withColumns({"cluster_inertia": F.lit(None).cast("long"), "inertia": F.lit(None).cast("long"), "centroid_sha256": F.lit(None).cast("string")})
    sums = {r.cluster: int(r.x) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("x")).collect()}
    fits = lambda x: F.lit(x if x is not None and x < 1 << 63 else None).cast("long")
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    at = F.col("cluster") + 1
    return found.withColumns({
        "cluster_inertia": F.element_at(F.array(*[fits(sums.get(j)) for j in range(len(centroids))]), at),
        "inertia": fits(sum(sums.values())),
        "centroid_sha256": F.element_at(F.array(*map(F.lit, hashes)), at),
    })


ship(__name__)
