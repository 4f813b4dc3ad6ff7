"""Approximate nearest neighbours: a forest of random-projection trees, searched through one priority queue.

Trees are fitted on a bounded sample; every row is then routed to its leaf in each tree. A query keeps one queue of open
nodes of all trees, ordered by the least margin on the way, and takes leaves until it has seen enough rows. Rows and
queries of a leaf meet in one task, which ranks them by exact distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors that the trees are fitted on, at most.
SAMPLE = 16_384
#: Trees of the forest.
TREES = 6
#: Leaves of a tree, so that a query takes as many leaves at every size of the table; a leaf is made for ``LEAF_ROWS`` rows
#: of the sample at least.
LEAVES = 64
LEAF_ROWS = 16
#: Share of all rows that a query looks at, counted over the leaves it takes (a row may come from several trees).
SHARE = 1.2
#: Rows of one leaf that meet the queries in one task; larger leaves are cut by a hash of the id.
PART_ROWS = 50_000


@dataclass
class Forest:
    """Complete binary trees: node i splits by normals[t, i] . v > offsets[t, i] into 2i + 1 and 2i + 2."""

    normals: np.ndarray
    offsets: np.ndarray
    depth: int

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def route(self, v: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        out = np.zeros((len(v), len(self.normals)), np.int32)
        for t in range(len(self.normals)):
            node = np.zeros(len(v), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", v, self.normals[t, node]) > self.offsets[t, node]
                node = 2 * node + 1 + right
            out[:, t] = node - (self.leaves - 1)
        return out

    def search(self, q: np.ndarray, enough: float, leaf_rows: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue until ``enough`` rows are expected."""
        margins = self.normals @ q - self.offsets
        inner = self.leaves - 1
        queue = [(-np.inf, t, 0) for t in range(len(self.normals))]
        found: list[tuple[int, int]] = []
        while queue and len(found) * leaf_rows < enough:
            bound, t, node = heapq.heappop(queue)
            if node >= inner:
                found.append((t, node - inner))
                continue
            m = float(margins[t, node])
            heapq.heappush(queue, (max(bound, m), t, 2 * node + 1))
            heapq.heappush(queue, (max(bound, -m), t, 2 * node + 2))
        return found


def fit_forest(sample: np.ndarray, trees: int = TREES, leaves: int = LEAVES, seed: int = 7) -> Forest:
    """Split at the median along the line through two random points of a node."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    depth = int(np.log2(max(min(leaves, len(sample) / LEAF_ROWS), 1)))
    inner = (1 << depth) - 1
    normals = np.zeros((trees, max(inner, 1), sample.shape[1]), np.float32)
    offsets = np.zeros((trees, max(inner, 1)), np.float32)
    for t in range(trees):
        members = {0: np.arange(len(sample))}
        for node in range(inner):
            own = members.pop(node)
            side = np.zeros(0, bool)
            if len(own) > 1:
                a, b = sample[rng.choice(own, 2, replace=False)]
                normal = (a - b) / max(float(np.linalg.norm(a - b)), 1e-12)
                along = sample[own] @ normal
                normals[t, node], offsets[t, node] = normal, np.median(along)
                side = along > offsets[t, node]
            members[2 * node + 1], members[2 * node + 2] = own[~side] if len(side) else own, own[side] if len(side) else own[:0]
    return Forest(normals, offsets, depth)


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: an id, no null or non-finite component, and not all zero."""
    v = F.col(vector_col).cast("array<float>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(good)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float32).reshape(-1, width)


def nearest(
    table: DataFrame, k: int = 10, every: int = 100, trees: int = TREES, share: float = SHARE, sample: int = SAMPLE,
    leaves: int = LEAVES, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row whose id is divisible by ``every``.

    Score is the Euclidean distance of the original vectors in double precision; ties go to the smaller id. Vectors that
    are null, zero or hold a null or non-finite component take no part, nor do those of another length than most of the
    sample. Rows that repeat an id and a vector count once. Of equal vectors only the k + 1 smallest ids can be among the
    k nearest of anything, so the others are put aside before the index is filled, on the mapping side. Each query gets
    all candidates if they are fewer than k. An empty table gives no rows; other columns are ignored.

    ``share`` is the number of rows looked at per query, in parts of all rows. On vectors without any structure (the
    worst case) a recall of 0.95 needs about as many as there are; for embeddings with structure a few hundredths do.
    """
    rows = usable(table, id_col, vector_col)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()  # bounded by ``sample``
    sizes = np.asarray([len(x) for x in picked.column("v").to_pylist()], np.int64) if picked.num_rows else np.zeros(1, np.int64)
    width = int(np.bincount(sizes).argmax())
    first = picked.filter(pa.array(sizes == width)) if picked.num_rows else picked
    rows = rows.where(F.size("v") == width)
    n = rows.count()
    forest = fit_forest(_matrix(first.column("v"), max(width, 1)), trees, leaves)
    parts = max(1, -(-n // (forest.leaves * PART_ROWS)))
    expected = n / forest.leaves

    same = Window.partitionBy("v").orderBy("vec_id")
    index = rows.withColumn("nth", F.dense_rank().over(same)).where(F.col("nth") <= k + 1).select("vec_id", "v")
    queries = rows.where(F.col("vec_id") % every == 0)

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = np.asarray(batch.column(0)), _matrix(batch.column(1), width)
            for a in range(0, len(ids), 4096):
                leaf = forest.route(v[a : a + 4096])
                m, t = leaf.shape
                at = np.repeat(np.arange(a, a + m), t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(t, dtype=np.int32), m)), pa.array(leaf.ravel()), pa.array((ids[at] % parts).astype(np.int32)), pa.array(ids[at]), pa.array([v[i].tobytes() for i in at], pa.binary())],
                    names=["tree", "leaf", "part", "vec_id", "v"],
                )

    def to_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = np.asarray(batch.column(0)), _matrix(batch.column(1), width)
            for i, q in enumerate(v):
                way = forest.search(q, share * n, expected)
                tree, leaf = np.array(way, np.int32).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(tree, parts)), pa.array(np.repeat(leaf, parts)), pa.array(np.tile(np.arange(parts, dtype=np.int32), len(tree))), pa.array(np.full(len(tree) * parts, ids[i])), pa.array([q.tobytes()] * (len(tree) * parts), pa.binary())],
                    names=["tree", "leaf", "part", "query_id", "q"],
                )

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, place = np.unique(np.asarray(left.column("vec_id")), return_inverse=True)
            v = np.frombuffer(b"".join(left.column("v").to_pylist()), np.float32).reshape(-1, width).astype(np.float64)
            seen = set()
            for query, q in zip(right.column("query_id").to_pylist(), right.column("q").to_pylist()):
                if (query, q) in seen:
                    continue
                seen.add((query, q))
                gap = v - np.frombuffer(q, np.float32).astype(np.float64)
                distance = np.full(len(ids), np.inf)
                np.minimum.at(distance, place, np.sqrt((gap * gap).sum(axis=1)))  # an id may stand in several rows
                other = np.flatnonzero(ids != query)
                best = other[np.lexsort((ids[other], distance[other]))[:k]] if len(other) <= 4 * k else _least(distance, ids, other, k)
                out[0].append(np.full(len(best), query)), out[1].append(ids[best]), out[2].append(distance[best])
        cols = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(np.float64))})

    filled = index.mapInArrow(to_leaves, "tree int, leaf int, part int, vec_id long, v binary")
    visits = queries.mapInArrow(to_visits, "tree int, leaf int, part int, query_id long, q binary")
    met = filled.groupBy("tree", "leaf", "part").cogroup(visits.groupBy("tree", "leaf", "part")).applyInArrow(meet, "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _least(distance: np.ndarray, ids: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """The k least by distance, then id, of ``other``."""
    near = distance[other]
    edge = np.partition(near, k - 1)[k - 1]
    close = other[near <= edge]
    return close[np.lexsort((ids[close], distance[close]))[:k]]
