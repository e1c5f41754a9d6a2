"""Exact inner-product top-k: a KD-tree per shard, searched best-first under a propagated k-th score."""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, need

#: Vectors of one shard: what one task holds while it builds a tree.
SHARD_ROWS = 4096
LEAF_ROWS = 128
#: Queries broadcast at once (16 MB at 64 dimensions); the query set is taken in blocks of this size.
QUERY_BLOCK = 32768


def complete(vectors: DataFrame, scale: float) -> DataFrame:
    """``(vec_id, embedding array<double>)`` of the rows that take part, with floor(scale * x) for each component x.

    Rows with a null id, a null vector, or a null or non-finite component take no part, nor do vectors whose
    scaled length is 2**31 or more: their products need not fit a long.
    """
    whole = F.transform("embedding", lambda x: x.cast("double"))
    rows = need(vectors, "vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", whole.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(finite).select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("embedding"))
    return rows.where(F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x * x) < F.lit(float(1 << 62)))


def _by_dim(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, integer vectors) of complete rows by their dimension."""
    if not len(ids):
        return {}
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, starts = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1]
    ids = ids.to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == dim)
        out[dim] = ids[own], flat[starts[own][:, None] + np.arange(dim)].astype(np.int64)
    return out


class KdTree:
    """Median splits on the widest side; every node has the tight bounding box of its own vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.arange(len(ids))
        lo, hi, first, last, left, right = [], [], [], [], [], []

        def grow(a: int, b: int) -> int:
            node, own = len(lo), vectors[order[a:b]]
            lo.append(own.min(0)), hi.append(own.max(0)), first.append(a), last.append(b), left.append(-1), right.append(-1)
            side = hi[node] - lo[node]
            if b - a > leaf_rows and side.size and side.max() > 0:
                axis, half = int(np.argmax(side)), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, axis], half)]
                left[node] = grow(a, a + half)
                right[node] = grow(a + half, b)
            return node

        grow(0, len(ids))
        self.ids, self.vectors = ids[order], vectors[order]
        self.lo, self.hi = np.array(lo), np.array(hi)
        self.first, self.last, self.left, self.right = (np.array(x, np.int64) for x in (first, last, left, right))

    FIELDS = ("ids", "vectors", "lo", "hi", "first", "last", "left", "right")

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> KdTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as z:
            for f in cls.FIELDS:
                setattr(tree, f, z[f])
        return tree

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, best: list[list[tuple[int, int]]], floor: np.ndarray) -> None:
        """Improve ``best``: per query a heap of (score, -vec_id). ``floor``: k-th scores already reached elsewhere.

        A box cannot hold a better vector than its corner nearest to the query's direction allows; a box
        whose bound is below the k-th score is never opened (an equal one is, for ties on the smaller id).
        """
        most = max(int(np.abs(queries).max(initial=0)), 1) * max(int(np.abs(self.vectors).max(initial=0)), 1) * max(1, queries.shape[1])
        kind = np.float64 if most < 1 << 53 else np.int64  # both exact
        q, vectors = queries.astype(kind), self.vectors.astype(kind)
        up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
        bounds = up @ self.hi.astype(np.float64).T + down @ self.lo.astype(np.float64).T
        if kind is np.int64:  # a bound may be rounded, but never below the products
            bounds += 1e-12 * (np.abs(queries).astype(np.float64) @ np.maximum(np.abs(self.hi), np.abs(self.lo)).astype(np.float64).T)
        for i, own in enumerate(query_ids.tolist()):
            heap, reach = best[i], bounds[i].tolist()
            kth = max(floor[i], heap[0][0]) if len(heap) == k else floor[i]
            todo = [(-reach[0], 0)]
            while todo and -todo[0][0] >= kth:
                _, node = heapq.heappop(todo)
                if self.left[node] >= 0:
                    for child in (int(self.left[node]), int(self.right[node])):
                        if reach[child] >= kth:
                            heapq.heappush(todo, (-reach[child], child))
                    continue
                a, b = self.first[node], self.last[node]
                scores = vectors[a:b] @ q[i]
                for at in np.flatnonzero(scores >= kth).tolist():
                    vec_id = int(self.ids[a + at])
                    entry = (int(scores[at]), -vec_id)
                    if vec_id == own:
                        continue
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        kth = max(kth, heap[0][0])


def build_index(vectors: DataFrame, scale: float = 256, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(vec_id, embedding)`` -> one row per shard and dimension: ``(seq, dim, n, tree binary)``, written once.

    Rows are dealt evenly, so a hot vector or id cannot overfill a shard. Rows that :func:`complete` leaves out
    take no part; rows that repeat a vec_id each do.
    """
    rows = complete(vectors, scale)
    shards = max(1, -(-rows.count() // shard_rows))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for dim, part in _by_dim(batch.column(0), batch.column(1)).items():
                found.setdefault(dim, []).append(part)
        for dim, parts in found.items():
            ids, v = (np.concatenate(x) for x in zip(*parts))
            tree = KdTree(ids, v)
            yield pa.RecordBatch.from_arrays([pa.array([int(ids[0])]), pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([tree.dump()], pa.binary())], ["seq", "dim", "n", "tree"])

    return materialize(rows.repartition(shards).mapInArrow(build, "seq long, dim int, n long, tree binary"), "kdtree")


def _searcher(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = block.value
        best = {dim: [[] for _ in ids] for dim, (ids, _, _) in held.items()}
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                if dim in held:
                    ids, queries, floor = held[dim]
                    KdTree.load(batch.column(1)[i].as_py()).search(ids, queries, k, best[dim], floor)
        out = [(int(q), -e[1], e[0]) for dim, heaps in best.items() for q, heap in zip(held[dim][0], heaps) for e in heap]
        for at in range(0, len(out), 65536):
            cols = zip(*out[at : at + 65536])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, index: DataFrame, k: int = 5, scale: float = 256, block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best other vectors of every query, ties to the smaller vec_id.

    ``queries``: (vec_id, embedding); of complete rows that repeat a vec_id the one with the smallest vector asks.
    The queries go over all shards in blocks of a fixed size. Each block first asks one shard, whose k-th
    scores travel with it as the floor; within a task they rise from shard to shard. A query without
    other vectors of its dimension gets no rows.
    """
    spark = queries.sparkSession
    asked = complete(queries, scale).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = materialize(asked, "queries")
    blocks = max(1, -(-asked.count() // block))
    parts = []
    for b in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        table = own.toArrow().combine_chunks()
        found = _by_dim(*(table.column(c).combine_chunks() for c in ("vec_id", "embedding"))) if table.num_rows else {}
        held = {d: (ids, v, np.full(len(ids), -(1 << 62))) for d, (ids, v) in found.items()}
        first = spark.sparkContext.broadcast(held)
        seed = index.orderBy(F.desc("n"), "seq").limit(1).select("dim", "tree").mapInArrow(_searcher(first, k), "query_id long, vec_id long, score long")
        kth = {r[0]: r[1] for r in seed.groupBy("query_id").agg(F.min("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).collect()}
        for d, (ids, vectors, floor) in held.items():
            held[d] = (ids, vectors, np.array([kth.get(int(i), f) for i, f in zip(ids, floor)], np.int64))
        second = spark.sparkContext.broadcast(held)
        found = index.select("dim", "tree").mapInArrow(_searcher(second, k), "query_id long, vec_id long, score long")
        parts.append(found if blocks == 1 else materialize(_ranked(found, k).drop("rank"), "found"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return _ranked(out, k).select("query_id", "rank", "vec_id", "score")
