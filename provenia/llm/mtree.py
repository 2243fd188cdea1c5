"""Exact top-k inner products by best-first search over M-trees.

Vectors are quantised to integers. Every batch of candidates becomes an M-tree of pages: the vectors
of a page lie around its pivot, with their distance to it stored, and pages hang under routing nodes
with covering radii and stored parent distances. Pivots are spread: each is the point farthest from
those before it. One extra coordinate, sqrt(R^2 - |x|^2), makes the
order by Euclidean distance the order by inner product. A query visits pages by their least possible
distance and stops when that exceeds its k-th best; a page's pivot distance is worked out only if the
bound from the parent's distance does not rule it out, and within a page only entries that the stored
distances leave in play are scored, with exact integer arithmetic: in doubles where no sum of products
can pass 2**53, else in 64-bit integers, which scores must fit. Bounds have a slack for rounding.

Queries are taken in blocks of ``BLOCK`` rows, one after the other: a block comes to the driver, is
broadcast and meets all candidates, a task keeps k results for each query, and these are merged by a
window and written before the next block. To build the trees of a batch costs about a hundredth of
what a full block of queries costs there.

Cases: null vectors, vectors with a null or non-finite component and rows of null id take no part;
vectors of different dimension are not compared; a query's own id is never its result, equal scores
go to the smaller id, equal rows (id and vector) count once for a query but each as a candidate; a
query with no candidate has no rows. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 1024
PAGE = 256
BLOCK = 4096
_EPS = 1e-6
#: Points of a batch among which pivots are chosen.
SAMPLE = 2048
#: Stands for no score yet.
NONE = np.iinfo(np.int64).min


class Tree:
    """Two levels of metric nodes over one batch of vectors of one dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, page: int = PAGE):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.real = self.x.astype(np.float64)
        self.largest = float(np.abs(self.real).max(initial=0))
        norm = (self.real**2).sum(1)
        self.reach = float(norm.max(initial=0))
        lifted = np.column_stack([self.real, np.sqrt(self.reach - norm)])
        pivots = _spread(lifted[:: max(1, len(x) // SAMPLE)], max(1, -(-len(x) // page)))
        far = _distances(lifted, pivots)
        own = far.argmin(1)
        self.entries, self.parent, keep = [], [], []
        for k in range(len(pivots)):
            rows = np.flatnonzero(own == k)
            if len(rows):
                keep.append(k)
                self.entries.append(rows)
                self.parent.append(far[rows, k])
        self.pivots = pivots[keep]
        self.radius = np.array([p.max() for p in self.parent])
        self.routes = _spread(self.pivots, max(1, int(len(self.pivots) ** 0.5)))
        to = _distances(self.pivots, self.routes)
        self.route = to.argmin(1)
        self.to_route = to[np.arange(len(self.pivots)), self.route]
        self.cover = np.array([max((self.to_route + self.radius)[self.route == r], default=0.0) for r in range(len(self.routes))])

    def search(self, qid: np.ndarray, q: np.ndarray, top_score: np.ndarray, top_id: np.ndarray) -> int:
        """Improve the running best k of every query in place; returns how many entries were scored."""
        real = q.astype(np.float64)
        lifted = np.column_stack([real, np.zeros(len(q))])
        base = (real**2).sum(1) + self.reach
        slack = _EPS * (1 + np.sqrt(base))
        exact_in_doubles = self.largest * np.abs(real).max(initial=0) * max(1, q.shape[1]) < 2.0**53

        def limit(rows):
            # Lowest score still of interest, as a distance; ties are kept.
            least = top_score[rows, -1]
            return np.where(least == NONE, np.inf, np.sqrt(np.maximum(0, base[rows] - 2 * least.astype(np.float64))) + slack[rows])

        route = _distances(lifted, self.routes)
        # Least distance to a page, from the parent's distances alone.
        bound = np.maximum(np.abs(route[:, self.route] - self.to_route) - self.radius, (route - self.cover)[:, self.route])
        order = np.argsort(bound, axis=1, kind="stable")
        live, scored = np.arange(len(q)), 0
        for step in range(len(self.pivots)):
            at = order[live, step]
            live = live[bound[live, at] <= limit(live)]
            if not len(live):
                break
            at = order[live, step]
            for page in np.unique(at):
                rows = live[at == page]
                near = _distances(lifted[rows], self.pivots[page : page + 1])[:, 0]
                edge = limit(rows)
                inside = near - self.radius[page] <= edge
                rows, near, edge = rows[inside], near[inside], edge[inside]
                if not len(rows):
                    continue
                play = np.abs(near[:, None] - self.parent[page]) <= edge[:, None]
                some = play.any(0)
                if not some.any():
                    continue
                entry = self.entries[page][some]
                score = (real[rows] @ self.real[entry].T).astype(np.int64) if exact_in_doubles else q[rows] @ self.x[entry].T
                score[~play[:, some] | (qid[rows][:, None] == self.ids[entry][None, :])] = NONE
                scored += int(play.sum())
                _merge(top_score, top_id, rows, score, self.ids[entry])
        return scored


def _spread(points: np.ndarray, count: int) -> np.ndarray:
    """``count`` points at most: first the one farthest from the mean, then always the one farthest from those chosen."""
    far = _distances(points, points.mean(0)[None, :])[:, 0]
    chosen = [int(far.argmax())]
    far = _distances(points, points[chosen])[:, 0]
    while len(chosen) < count and far.max(initial=0) > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T)))


def _merge(top_score: np.ndarray, top_id: np.ndarray, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
    """Keep the best k by score, then smaller id."""
    k = top_score.shape[1]
    both = np.concatenate([top_score[rows], score], axis=1)
    names = np.concatenate([top_id[rows], np.broadcast_to(ids, score.shape)], axis=1)
    first = np.argsort(names, axis=1, kind="stable")
    both, names = np.take_along_axis(both, first, 1), np.take_along_axis(names, first, 1)
    # Of a stable sort downwards: the smallest integer has no opposite, so places are reversed instead.
    best = k_first(both, k)
    top_score[rows], top_id[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)


def k_first(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each row, earlier places first among equals."""
    width = score.shape[1]
    return (width - 1 - np.argsort(score[:, ::-1], axis=1, kind="stable"))[:, ::-1][:, :k]


def _by_dimension(ids: np.ndarray, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(size)])
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield ids[rows], flat[start[rows][:, None] + np.arange(d)].reshape(len(rows), int(d)).astype(np.int64)


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): rows that take part, components floor(1024 x) as longs."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.filter(F.col(vec_id).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long")).alias("v")
    )


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of every query row."""
    spark = vectors.sparkSession
    rows = quantised(vectors, vec_id, vector)
    queries = written(quantised(vectors.filter(is_query), vec_id, vector).dropDuplicates(["id", "v"]), "queries")
    blocks = max(1, -(-queries.count() // block))
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = []
    for b in range(blocks):
        table = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        ids = table.column(0).to_numpy()
        own = spark.sparkContext.broadcast(list(_by_dimension(ids, table.column(1))) if len(ids) else [])

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            best = [(qid, q, np.full((len(qid), k), NONE), np.full((len(qid), k), np.iinfo(np.int64).max)) for qid, q in own.value]
            for batch in batches:
                for cid, x in _by_dimension(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)):
                    for qid, q, score, top in best:
                        if q.shape[1] == x.shape[1]:
                            Tree(cid, x).search(qid, q, score, top)
            for qid, _, score, top in best:
                real = score != NONE
                query = np.broadcast_to(qid[:, None], score.shape)[real]
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(top[real]), pa.array(score[real])], names=["query_id", "vec_id", "score"])

        block_best = rows.mapInArrow(run, "query_id long, vec_id long, score long").withColumn("rank", ranked).filter(F.col("rank") <= k)
        found.append(written(block_best, "top-k") if blocks > 1 else block_best)
        if blocks > 1:
            own.destroy()
    return reduce(DataFrame.unionByName, found).select("query_id", "rank", "vec_id", "score")
