"""k-means on whole numbers whose lower bounds loosen by geometry instead of by the full drift.

Lloyd's rounds, exact: components are ``floor(scale * x)``, squared distances whole numbers, ties go to the smaller
centroid, and a new centroid is the floor of its vectors' mean. Each vector keeps its cluster, an upper bound of its
distance to that centroid, and a lower bound of its distance to every other. A vector whose upper bound stays below the
lower one, or below half the way to the nearest other centroid, keeps its cluster unseen; one that does not is measured
against its own centroid and, if it is still ambiguous, against all of them, exactly.

How far a lower bound must loosen. The vectors of a cluster lie in a sphere (old centroid c, radius r: their largest
upper bound). Another centroid moves from a to b, by d, with midpoint m. For a vector x at angle t to the move, seen
from m::

    |x - a| - |x - b| = 2 (x - m).(b - a) / (|x - a| + |x - b|)  <=  d cos t     as |x - a| + |x - b| >= 2 |x - m|

so the bound falls by no more than d cos t, and not at all past a right angle. In the plane through c and the move, the
sphere is seen from m within asin(r / |c - m|) of c's angle, so t is at least the difference of the two. A sphere that
holds m loosens by the full d. A vector's single bound falls by the largest of these over the other centroids.

Vectors travel in blocks of up to BLOCK rows, dealt evenly, so no hot cluster fills a task; a block also carries the
sums of its clusters, and only k sums of them reach the driver. Each round is a written table that replaces the one
before, so a lost executor costs one round. Vectors that are null, hold a null or a value that is not finite, or have
another number of components take no part; rows that repeat each do, and a null vec_id is last in the order of seeds.
A component beyond 2 ** 26 after scaling is refused, since its squares would leave a long. Other columns never clash.
An empty table gives no rows; with fewer vectors than k each starts a cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize, need

BLOCK = 4096
LARGEST = 1 << 26
#: What float bounds may be off by, relative and absolute.
SLACK, LEAST = 1e-9, 1e-6
_STATE = "ids binary, named binary, vectors binary, cluster binary, upper binary, lower binary, scanned long, counts array<long>, sums array<long>, radius array<double>"


def kept(vectors: DataFrame, scale: float, dim: int) -> DataFrame:
    """``(vec_id, v)`` of the vectors that take part; ``v``: whole numbers."""
    v = need(vectors, "vec_id", "embedding")
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = (F.size("embedding") == dim) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole: Column = F.transform(x, lambda c: F.floor(c * scale))
    return v.where(F.col("embedding").isNotNull()).where(F.coalesce(fine, F.lit(False))).select("vec_id", whole.alias("v"))


def seeds(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids hash lowest with ``seed``, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select("v", name.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, how much its vectors' lower bound falls when the centroids move from ``old`` to ``new``."""
    a, b = old.astype(np.float64), new.astype(np.float64)
    move, middle = b - a, (a + b) / 2
    d = np.sqrt((move * move).sum(1))
    out = np.zeros(len(a))
    for i in range(len(a)):
        away = a[i] - middle
        far = np.sqrt((away * away).sum(1))
        held = far <= radius[i] * (1 + SLACK) + LEAST
        with np.errstate(invalid="ignore", divide="ignore"):
            cos_c = np.clip((away * move).sum(1) / (far * d), -1, 1)
            sin_a = np.clip(radius[i] / far, 0, 1)
        angle = np.maximum(np.arccos(cos_c) - np.arcsin(sin_a), 0)
        falls = np.where(d == 0, 0.0, np.where(held, d, d * np.clip(np.cos(angle) + 1e-6, 0, 1)))
        falls[i] = 0
        out[i] = falls.max(initial=0)
    return out


@dataclass
class Move:
    """What a round tells every block: the centroids, their drift, the fall of lower bounds, half the way to the nearest other."""

    centroids: np.ndarray
    drift: np.ndarray
    fall: np.ndarray
    half: np.ndarray


def moved(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Move:
    a, b = old.astype(np.float64), new.astype(np.float64)
    between = np.sqrt(((b[:, None] - b[None]) ** 2).sum(2))
    np.fill_diagonal(between, np.inf)
    return Move(new, np.sqrt(((b - a) ** 2).sum(1)), loosening(old, new, radius), between.min(1) / 2)


def _squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def _scan(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, distance to it, and to the second nearest, of each vector; exact."""
    every = np.stack([_squares(v, c) for c in centroids], 1)
    best = every.argmin(1)  # the first of equals
    own = every[np.arange(len(v)), best]
    if every.shape[1] == 1:
        return best, np.sqrt(own.astype(np.float64)), np.full(len(v), np.inf)
    second = np.partition(every, 1, axis=1)[:, 1]
    return best, np.sqrt(own.astype(np.float64)), np.sqrt(second.astype(np.float64))


def reassign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, step: Move) -> int:
    """Brings cluster and bounds of a block up to ``step``, in place; returns how many vectors were scanned."""
    upper += step.drift[cluster] * (1 + SLACK) + LEAST
    lower -= step.fall[cluster] * (1 + SLACK) + LEAST
    least = lambda at: np.maximum(lower[at], step.half[cluster[at]]) * (1 - SLACK) - LEAST
    open_ = np.flatnonzero(upper >= least(slice(None)))
    if len(open_):
        upper[open_] = np.sqrt(_squares(v[open_], step.centroids[cluster[open_]]).astype(np.float64)) * (1 + SLACK)
        open_ = open_[upper[open_] >= least(open_)]
    if len(open_):
        cluster[open_], own, other = _scan(v[open_], step.centroids)
        upper[open_], lower[open_] = own * (1 + SLACK), other * (1 - SLACK)
    return len(open_)


def _row(ids: bytes, named: bytes, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, scanned: int, k: int) -> pa.RecordBatch:
    counts = np.bincount(cluster, minlength=k)
    sums, radius = np.zeros((k, v.shape[1]), np.int64), np.zeros(k)
    for c in np.flatnonzero(counts):
        own = cluster == c
        sums[c], radius[c] = v[own].sum(0), upper[own].max()
    data = [ids, named, v.tobytes(), cluster.tobytes(), upper.tobytes(), lower.tobytes()]
    cols = [pa.array([x], pa.binary()) for x in data] + [pa.array([scanned], pa.int64())]
    cols += [pa.array([x.ravel().tolist()], pa.list_(t)) for x, t in ((counts, pa.int64()), (sums, pa.int64()), (radius, pa.float64()))]
    return pa.RecordBatch.from_arrays(cols, [p.split()[0] for p in _STATE.split(", ")])


def _first(centroids: np.ndarray, dim: int):
    """Packs rows into blocks and scans each vector once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids, lists = part.column(0), part.column(1)
                v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
                if v.size and (v.max() > LARGEST or v.min() < -LARGEST):
                    raise ValueError(f"components beyond {LARGEST} after scaling")
                best, own, other = _scan(v, centroids)
                named = np.asarray(ids.is_valid())
                yield _row(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), named.tobytes(), v, best.astype(np.int32), own * (1 + SLACK), other * (1 - SLACK), len(v), len(centroids))

    return run


def _unpacked(batch: pa.RecordBatch, i: int, dim: int) -> tuple:
    raw = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)
    return raw("vectors", np.int64).reshape(-1, dim), raw("cluster", np.int32).copy(), raw("upper", np.float64).copy(), raw("lower", np.float64).copy()


def _next(step: Move, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                v, cluster, upper, lower = _unpacked(batch, i, dim)
                scanned = reassign(v, cluster, upper, lower, step)
                yield _row(batch.column("ids")[i].as_py(), batch.column("named")[i].as_py(), v, cluster, upper, lower, scanned, len(step.centroids))

    return run


def _placed(centroids: np.ndarray, dim: int):
    """A row for each vector: its cluster and exact squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                v, cluster, _, _ = _unpacked(batch, i, dim)
                ids, named = (np.frombuffer(batch.column(n)[i].as_py(), t) for n, t in (("ids", np.int64), ("named", np.bool_)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~named), pa.array(cluster), pa.array(_squares(v, centroids[cluster]))], ["vec_id", "cluster", "distance"])

    return run


def _total(state: DataFrame, column: str, how) -> list:
    """Element by element over all blocks; as many rows as the array has elements."""
    rows = state.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(how("x").alias("x")).orderBy("at").collect()
    return [r["x"] for r in rows]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: float = 1024, dim: int = 64, seed: int = 3) -> tuple[DataFrame, np.ndarray, list[int]]:
    """``(vec_id, cluster, distance)`` of every vector that takes part, the centroids, and how many vectors each assignment scanned.

    k centroids of ``dim`` whole numbers are all that reaches the driver. The frame reads a written table.
    """
    spark = vectors.sparkSession
    rows = materialize(kept(vectors, scale, dim), "vectors")
    centroids = seeds(rows, k, seed)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids, []
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // (8 * BLOCK)))
    state = materialize(rows.repartition(parts).mapInArrow(_first(centroids, dim), _STATE), "clusters")
    discard(rows)
    scanned = [state.agg(F.sum("scanned")).first()[0]]
    for _ in range(rounds):
        counts, sums, radius = (_total(state, c, h) for c, h in (("counts", F.sum), ("sums", F.sum), ("radius", F.max)))
        new = centroids.copy()
        for c, n in enumerate(counts):
            if n:
                new[c] = [s // n for s in sums[c * dim : (c + 1) * dim]]
        step = moved(centroids, new, np.array(radius) * (1 + SLACK))
        after = materialize(state.mapInArrow(_next(step, dim), _STATE), "clusters")
        discard(state)
        state, centroids = after, new
        scanned.append(state.agg(F.sum("scanned")).first()[0])
    return state.mapInArrow(_placed(centroids, dim), "vec_id long, cluster int, distance long"), centroids, scanned


def cluster_report(vectors: DataFrame, **how) -> DataFrame:
    """:func:`cluster` with each cluster's and the whole inertia, and a digest of the final centroids."""
    spark = vectors.sparkSession
    placed, centroids, _ = cluster(vectors, **how)
    placed = materialize(placed, "placed")
    names = [(c, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for c, row in enumerate(centroids)]
    own = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = placed.agg(F.sum("distance").alias("inertia"))
    per = spark.createDataFrame(names, "cluster int, centroid_sha256 string").join(own, "cluster").crossJoin(F.broadcast(total))
    # one row a centroid
    return placed.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
