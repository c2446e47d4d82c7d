"""Exact top-k by integer inner product: a Voronoi kNN join.

Pivots from a bounded sample split the vectors into Voronoi groups. A group's summary is its
size, its radius and the k + 1 vectors nearest to its pivot. For a query, the k-th best
score among all summary vectors is a lower bound (floor) of its k-th best score; no vector
of a group scores more than q.p + |q| radius. Queries go only to groups whose bound reaches
the floor, and inside a group only vectors whose own distance to the pivot allows the floor
are compared. All comparisons that could matter are made, so results are exact.

Components are floor(scale * x) in double precision; scores must fit in a long.

Defined results: vectors that are null, hold null or non-finite components, have a null id
or another than the most frequent length take no part, zero vectors do; equal scores are
ordered by the smaller id; repeated ids are separate candidates, except the query's own id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.ann import nearest
from plumbline.llm.vectors import assigned, common_length, matrix, meet, packed, sampled

SCALE, MAX_PIVOTS = 1024, 512
#: Doubles hold integers exactly below this.
_EXACT = 2.0**53


def products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact integer inner products of matrices of whole numbers held as doubles."""
    most = np.abs(queries).max(initial=0) * np.abs(points).max(initial=0) * max(1, points.shape[1])
    if most < _EXACT:
        return (queries @ points.T).astype(np.int64)
    return queries.astype(np.int64) @ points.astype(np.int64).T


def search(df: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, id, score)`` for the rows of ``df`` that ``queries`` (on ``id``) selects."""
    dtype = "<i8"
    dim = common_length(df, vec_col)
    vectors = packed(df, id_col, vec_col, lambda x: (np.floor(scale * np.where(np.isfinite(x), x, 0)), np.ones(len(x), bool)), dtype)
    total = vectors.count()
    pivots = sampled(vectors, total, dim, dtype, int(min(MAX_PIVOTS, max(1, round(total**0.5 / 2)))))[1]
    pivots = np.unique(pivots, axis=0) if len(pivots) else np.zeros((1, dim))
    data = assigned(vectors, lambda x: nearest(x, pivots), dim, dtype)
    summary = data.groupBy("list").agg(F.count("*").alias("size"), F.max("gap").alias("radius")).collect()  # at most MAX_PIVOTS rows
    sizes = {r["list"]: r["size"] for r in summary}
    radius = np.full(len(pivots), -np.inf)
    for r in summary:
        radius[r["list"]] = r["radius"]
    close = data.withColumn("n", F.row_number().over(W.partitionBy("list").orderBy("gap", "id"))).where(F.col("n") <= k + 1).select("id", "vec").collect()
    known_ids, known = np.array([r["id"] for r in close], np.int64), matrix([bytes(r["vec"]) for r in close], dim, dtype)

    def route(query_ids, queries):
        scores = products(queries, known).astype(np.float64)
        scores[query_ids[:, None] == known_ids] = -np.inf
        floors = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(queries), -np.inf)
        norms = np.sqrt((queries * queries).sum(axis=1))
        bound = queries @ pivots.T + norms[:, None] * radius
        return floors, bound + 1e-9 * (np.abs(bound) + 1) >= floors[:, None]

    def solve(number, query_ids, queries, floors, ids, points):
        pivot = pivots[number]
        gap = np.sqrt(((points - pivot) ** 2).sum(axis=1))
        far = gap.max(initial=0)
        norms = np.sqrt((queries * queries).sum(axis=1))
        order = np.argsort(-gap, kind="stable")
        found = []
        step = max(1, (1 << 21) // max(1, len(points)))
        for a in range(0, len(queries), step):
            q = queries[a : a + step]
            with np.errstate(divide="ignore", invalid="ignore"):
                least = (floors[a : a + step] - q @ pivot) / norms[a : a + step]
            least = np.where(norms[a : a + step] > 0, least, -np.inf) - 1e-6 * (1 + far)
            # vectors by descending distance to the pivot: a prefix can reach the floor
            prefix = order[: int((gap >= least.min()).sum())]
            scores = products(q, points[prefix])
            at_q, at_x = np.nonzero((scores >= floors[a : a + step, None]) & (query_ids[a : a + step, None] != ids[prefix]))
            found.append((a + at_q, prefix[at_x], scores[at_q, at_x]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    return meet(data, sizes, len(pivots), vectors.where(queries), route, solve, dim, dtype, k)
