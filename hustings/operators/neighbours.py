"""Similar cycles: exact nearest neighbours of standardised vectors (JN12, ML15, ML16).

No pairs are formed by a join. Equal vectors are first folded into one point that remembers only the few smallest
keys it could ever contribute. The points are dealt to boxes by median cuts of a bounded sample, about as many boxes as
the square root of the points. A point first searches its own box. Then it visits other boxes, nearest first and twice
as many in each round, as long as one is no farther than its (k + 1)-th candidate. Distances never leave a task, only
the best of each visit do. There is one plan for any number of points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import ordered_ranges

VECTOR = ["final_leader_pct", "poll_volatility", "actual_margin", "n_polls"]
#: Points of a sampled box, boxes at the most, points of a box at the least, and asking rows of a box that one task takes.
SAMPLE_PER_BOX = 32
MOST_BOXES = 1 << 15
LEAST_BOX = 4096
ASKING_ROWS = 20_000


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population z-scores; a constant column keeps its zero distances (divisor one)."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    scaled = {
        f"z_{c}": (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns
    }
    return df.withColumns(scaled)


def nearest_neighbours(df: DataFrame, keys: list[str], columns: list[str] = VECTOR, k: int = 3, box_points: int | None = None) -> DataFrame:
    """The ``min(k, n - 1)`` nearest other rows of each row; ties go to the smaller key.

    ``box_points``: points of a box, about the square root of all by default. It changes the work, never the result.
    """
    dims = [f"z_{c}" for c in columns]
    rows = cut_lineage(standardise(df.dropna(subset=columns), columns).select(*keys, *dims))
    newest = Window.partitionBy(*dims).orderBy(*keys)
    copies = rows.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= k + 1)
    folded = copies.groupBy(*dims).agg(F.array_sort(F.collect_list(F.struct(*keys))).alias("members"))
    # Numbers in the order of the smallest keys: among equal distances the smaller number wins. They need no gaps closed.
    ranged = ordered_ranges(cut_lineage(folded), [F.col("members")[0], *map(F.col, dims)])
    points = cut_lineage(ranged.withColumn("pid", F.shiftleft(F.col("_bucket").cast("long"), 33) + F.col("_place")).drop("_bucket", "_place"))
    near = _box_search(points.select("pid", *dims), dims, k + 1, box_points)
    found = near.join(points.select(F.col("pid").alias("_other"), "members"), "_other").select(
        "pid", "distance", F.explode("members").alias("_m")
    )
    # Every row needs at most k + 1 candidates of its own point (its copies, itself included).
    best = Window.partitionBy("pid").orderBy("distance", "_m")
    short = found.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= k + 1)
    lists = short.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("distance", "_m"))).alias("_near"))
    named = points.select("pid", *dims).join(lists, "pid").drop("pid")
    own = F.struct(*keys)
    others = F.slice(F.filter("_near", lambda x: ~x["_m"].eqNullSafe(own)), 1, k)
    return (
        rows.join(named, dims)
        .withColumn("_hit", F.explode(others))
        .select(*keys, *[F.col(f"_hit._m.{c}").alias(f"similar_{c}") for c in keys], F.col("_hit.distance").alias("distance"))
    )


def median_cuts(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A heap of cuts (dimension, value): node i has the children 2i and 2i + 1, what is greater goes to the latter.

    The widest dimension of a node's sample is cut at its median; where all of it is equal nothing is greater.
    """
    dim, value = np.zeros(1 << depth, np.int64), np.full(1 << depth, np.inf)
    parts = {1: sample}
    for node in range(1, 1 << depth):
        own = parts.pop(node)
        if len(own):
            dim[node] = np.ptp(own, axis=0).argmax()
            column = np.sort(own[:, dim[node]])
            if column[0] < column[-1]:
                middle = column[(len(column) - 1) // 2]
                value[node] = middle if middle < column[-1] else column[np.searchsorted(column, middle) - 1]
        high = own[:, dim[node]] > value[node]
        parts[2 * node], parts[2 * node + 1] = own[~high], own[high]
    return dim, value


def _boxed(points: DataFrame, dims: list[str], box_points: int | None) -> DataFrame:
    """(pid, dims, box): every point with the box it lies in."""
    n = max(points.count(), 1)
    wanted = min(max(n / (box_points or max(np.sqrt(n), LEAST_BOX)), 1), MOST_BOXES)
    depth = int(np.ceil(np.log2(wanted)))
    most = SAMPLE_PER_BOX << depth
    sample = points.select(*dims).sample(min(1.0, most / n), 7).limit(2 * most).toPandas().to_numpy(float)  # bounded, it only places the cuts
    dim, value = median_cuts(sample, depth)

    def place(batches):
        for pdf in batches:
            x, node = pdf[dims].to_numpy(float), np.ones(len(pdf), np.int64)
            for _ in range(depth):
                node = 2 * node + (x[np.arange(len(x)), dim[node]] > value[node])
            yield pdf.assign(box=node - (1 << depth))

    return points.mapInPandas(place, f"pid bigint, {', '.join(f'{d} double' for d in dims)}, box bigint")


def _nearest_in_box(dims: list[str], want: int):
    """Of each asking point the ``want`` nearest targets of the box, by distance and then number."""

    def search(asked: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        q, o = asked[dims].to_numpy(float), targets[dims].to_numpy(float)
        pid, other = asked["pid"].to_numpy(), targets["pid"].to_numpy()
        by_number = other.argsort()
        o, other = o[by_number], other[by_number]
        take, step, parts = min(want, len(o)), max(1, 2_000_000 // max(len(o), 1)), []
        for start in range(0, len(q) if take else 0, step):
            block = q[start : start + step]
            square = np.zeros((len(block), len(o)))
            for i in range(len(dims)):
                square += (block[:, i, None] - o[None, :, i]) ** 2
            dist = np.sqrt(square)
            at, to = np.nonzero(dist <= np.partition(dist, take - 1, axis=1)[:, take - 1, None])
            order = np.lexsort((to, dist[at, to], at))  # equal distances: the smaller number first
            at, to = at[order], to[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            at, to = at[rank < take], to[rank < take]
            parts.append(pd.DataFrame({"pid": pid[start + at], "_other": other[to], "distance": dist[at, to]}))
        return pd.concat(parts) if parts else pd.DataFrame({"pid": np.zeros(0, np.int64), "_other": np.zeros(0, np.int64), "distance": np.zeros(0)})

    return search


def _visits(dims: list[str], want: int, boxes: tuple[np.ndarray, np.ndarray, np.ndarray], seen: int, more: int):
    """The next boxes of each point: those with the places ``seen`` to ``seen + more`` by distance that may improve its list."""
    number, low, high = boxes

    def choose(batches):
        for pdf in batches:
            x, own, worst = pdf[dims].to_numpy(float), pdf["box"].to_numpy(), pdf["worst"].to_numpy(float)
            step = max(1, 500_000 // max(len(number), 1))
            for start in range(0, len(x), step):
                block = x[start : start + step]
                square = np.zeros((len(block), len(number)))
                for i in range(len(dims)):
                    square += np.maximum(np.maximum(low[None, :, i] - block[:, i, None], block[:, i, None] - high[None, :, i]), 0.0) ** 2
                bound = np.sqrt(square) * (1 - 1e-9)  # rounding never hides a box
                bound[own[start : start + step, None] == number[None, :]] = np.inf
                order = np.argsort(bound, axis=1, kind="stable")[:, seen : seen + more]
                near = np.take_along_axis(bound, order, axis=1)
                at, nth = np.nonzero((near <= worst[start : start + step, None]) & np.isfinite(near))
                yield pdf.iloc[start + at].drop(columns="worst").assign(visit=number[order[at, nth]])

    kind = ", ".join(f"{d} double" for d in dims)
    return choose, f"pid bigint, {kind}, box bigint, visit bigint"


def _box_search(points: DataFrame, dims: list[str], want: int, box_points: int | None) -> DataFrame:
    """(pid, _other, distance): the ``want`` nearest points of each, itself included."""
    placed = cut_lineage(_boxed(points, dims, box_points))
    edges = placed.groupBy("box").agg(*[F.min(d).alias(f"low_{d}") for d in dims], *[F.max(d).alias(f"high_{d}") for d in dims]).toPandas()
    boxes = edges["box"].to_numpy(), edges[[f"low_{d}" for d in dims]].to_numpy(float), edges[[f"high_{d}" for d in dims]].to_numpy(float)
    visits, best, seen, more = placed.withColumn("visit", F.col("box")), None, 0, 1
    lists = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, want)
    while True:
        parts = visits.groupBy("visit").agg(F.ceil(F.count("*") / ASKING_ROWS).cast("int").alias("parts"))
        asked = visits.join(parts, "visit").withColumn("part", F.pmod(F.xxhash64("pid"), F.col("parts")).cast("int"))
        targets = placed.toDF("pid", *dims, "visit").join(parts.toDF(*parts.columns), "visit").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = asked.groupBy("visit", "part").cogroup(targets.groupBy("visit", "part")).applyInPandas(
            _nearest_in_box(dims, want), "pid bigint, _other bigint, distance double"
        )
        got = met.groupBy("pid").agg(F.collect_list(F.struct("distance", "_other")).alias("near"))
        got = got if best is None else best.unionByName(got)
        best = cut_lineage(got.groupBy("pid").agg(lists.alias("near")))
        if seen >= len(boxes[0]) - 1:
            break
        worst = F.when(F.size("near") >= want, F.col("near")[want - 1]["distance"]).otherwise(float("inf"))
        choose, kind = _visits(dims, want, boxes, seen, more)
        # a point whose last visits were fewer than offered has no nearer box left, so it is not asked for again
        open_points = placed if seen == 0 else placed.join(visits.groupBy("pid").count().where(F.col("count") == more // 2).select("pid"), "pid", "left_semi")
        visits = cut_lineage(open_points.join(best.select("pid", worst.alias("worst")), "pid").select("pid", *dims, "box", "worst").mapInPandas(choose, kind))
        if visits.isEmpty():
            break
        seen, more = seen + more, 2 * more
    return best.select("pid", F.explode("near").alias("n")).select("pid", F.col("n._other").alias("_other"), F.col("n.distance").alias("distance"))


def election_vectors(features: DataFrame, truth: DataFrame, order: list[str]) -> DataFrame:
    """ML16: leader's last average, its sample deviation (NULL -> 0), true margin and observation count."""
    from .ordering import top_two_margin
    from ..schemas import ENTITY_CYCLE

    margins = top_two_margin(truth, ENTITY_CYCLE, "actual_pct", "party", "actual_margin").where(
        F.col("actual_margin").isNotNull()
    )
    leaders = margins.select(*ENTITY_CYCLE, F.col("leader").alias("party"), "actual_margin")
    rows = features.join(leaders, [*ENTITY_CYCLE, "party"])
    return rows.groupBy(*ENTITY_CYCLE, F.col("party").alias("leader_party"), "actual_margin").agg(
        F.max_by("rolling_avg", F.struct(*order)).alias("final_leader_pct"),
        F.coalesce(F.stddev_samp("pct"), F.lit(0.0)).alias("poll_volatility"),
        F.count("*").alias("n_polls"),
    ).select(*ENTITY_CYCLE, "leader_party", "final_leader_pct", "poll_volatility", "actual_margin", "n_polls")
