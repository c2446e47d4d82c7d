"""Approximate nearest neighbours by inner product: adaptive dimension scan.

Vectors get one more component that makes their norms equal, so the largest inner product
is the smallest distance, and are put into inverted lists by k-means centroids fitted on a
bounded sample. Queries visit the nearest lists until these hold ``probe`` of all vectors
(and always more than k).

In a list, vectors and query are rotated to the principal axes of the sample, those of the
largest variance first, and scanned in blocks of columns. After each block a hypothesis test
takes the partial inner product and the lengths of what is left of both vectors: it abandons
a candidate that reaches the query's floor only if the rest of it were closer to the query's
than it is for all but ``ALPHA`` of the true neighbours of the sample. The floor is the score
of the 2k-th best vector of the sample in the visited lists, raised as lists are scanned to
the k-th best score found so far. What is left is scored exactly on the original vectors.

``probe`` 0.65 suits vectors without any cluster structure, whose lists tell little;
clustered vectors allow far less. Every row is indexed.

Defined results: vectors that are null, zero, hold null or non-finite components, have a
null id or another than the most frequent length take no part; equal scores are ordered by
the smaller id; repeated ids are separate candidates, except the query's own id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.vectors import assigned, common_length, meet, packed, sampled

PROBE = 0.65
MAX_LISTS = 1024
#: Columns after which candidates are tested, and the share of true neighbours that one test may abandon.
BLOCK, ALPHA = 8, 0.004


def kmeans(points: np.ndarray, lists: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    centers = points[np.random.default_rng(seed).choice(len(points), lists, replace=False)].copy()
    for _ in range(rounds):
        number = nearest(points, centers)[0]
        counts = np.bincount(number, minlength=lists)
        sums = np.zeros_like(centers)
        np.add.at(sums, number, points)
        centers[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centers


def nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = (centers * centers).sum(axis=1) / 2
    number = np.concatenate([(half - part @ centers.T).argmin(axis=1) for part in np.array_split(points, max(1, len(points) // 4096))])
    return number, np.sqrt(((points - centers[number]) ** 2).sum(axis=1))


def lifted(x: np.ndarray, norm2: float) -> np.ndarray:
    """``x`` with a component that brings every squared norm to ``norm2``."""
    return np.column_stack((x, np.sqrt(np.maximum(norm2 - (x * x).sum(axis=1), 0))))


def rotation(sample: np.ndarray) -> np.ndarray:
    """The principal axes of the sample as columns, those of the largest variance first."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1]


def left_after(x: np.ndarray, block: int) -> np.ndarray:
    """For each row the length of what is left of it after each block of columns but the last."""
    cuts = np.arange(block, x.shape[1], block)
    squares = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(squares[:, cuts])


def calibrated(sample: np.ndarray, k: int, block: int = BLOCK, alpha: float = ALPHA, queries: int = 256) -> np.ndarray:
    """For each block but the last, how near the rest of a candidate may have to come.

    Rows are rotated. For pairs of true neighbours in the sample, what lacks to the floor after
    a block is taken over the lengths of the rests; all but ``alpha`` of the pairs need less. A
    value of 1 abandons only what can't reach the floor at all.
    """
    cuts = np.arange(block, sample.shape[1], block)
    if len(sample) <= 2 * k:
        return np.ones(len(cuts))
    asked = sample[:queries]
    scores = asked @ sample.T
    np.fill_diagonal(scores, -np.inf)
    order = np.argsort(-scores, axis=1)[:, : 2 * k]
    floors = np.take_along_axis(scores, order[:, -1:], axis=1).ravel()
    at_q, at_x = np.repeat(np.arange(len(asked)), k), order[:, :k].ravel()
    rest = left_after(sample, block)
    out = []
    for i, cut_ in enumerate(cuts.tolist()):
        partial = np.einsum("ij,ij->i", asked[at_q, :cut_], sample[at_x, :cut_])
        lengths = rest[at_q, i] * rest[at_x, i]
        needed = np.divide(floors[at_q] - partial, lengths, out=np.zeros(len(at_q)), where=lengths > 0)
        out.append(np.quantile(needed, 1 - alpha))
    return np.clip(out, 0, 1)


def adaptive_scan(queries: np.ndarray, points: np.ndarray, floors: np.ndarray, near: np.ndarray, block: int = BLOCK, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, point) that no test abandons and whose inner product may reach the floor.

    Rows are rotated alike; ``near`` is that of ``calibrated``. The first block is one matrix
    product; later blocks see only the pairs that are left. ``trace`` gets their numbers.
    """
    dim = points.shape[1]
    rest_q, rest_x = left_after(queries, block), left_after(points, block)
    partial = queries[:, :block] @ points[:, :block].T
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(floors), floors, 0)))  # rounding
    least = floors - slack
    hopeful = partial + near[0] * rest_q[:, :1] * rest_x[:, 0] >= least[:, None] if len(near) else partial >= least[:, None]
    at_q, at_x = np.nonzero(hopeful)
    held = partial[at_q, at_x]
    for i, a in enumerate(range(block, dim, block), 1):
        if trace is not None:
            trace.append(len(at_q))
        b = min(a + block, dim)
        held = held + np.einsum("ij,ij->i", queries[at_q, a:b], points[at_x, a:b])
        reach = held + near[i] * rest_q[at_q, i] * rest_x[at_x, i] if i < len(near) else held
        alive = reach >= least[at_q]
        at_q, at_x, held = at_q[alive], at_x[alive], held[alive]
    if trace is not None:
        trace.append(len(at_q))
    return at_q, at_x


def search(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", probe: float = PROBE) -> DataFrame:
    """``(query_id, rank, id, score)`` for the rows of ``df`` that ``queries`` (on ``id``) selects."""
    dtype = "<f8"
    dim = common_length(df, vec_col)
    vectors = packed(df, id_col, vec_col, lambda x: (x, (x != 0).any(axis=1)), dtype)
    total, norm2 = vectors.agg(F.count("*"), F.max("norm2")).first()
    norm2 = float(norm2 or 0)
    ids, sample = sampled(vectors, total, dim, dtype)
    lists = int(min(MAX_LISTS, max(1, round(3 * total**0.5)), max(1, len(sample) // 4)))
    raised = lifted(sample, norm2) if len(sample) else np.zeros((1, dim + 1))
    centers = kmeans(raised, lists)
    sample_list = nearest(raised, centers)[0]
    spin = rotation(sample) if len(sample) else np.eye(dim)
    near = calibrated(sample @ spin, k) if len(sample) else np.ones(len(range(BLOCK, dim, BLOCK)))
    data = assigned(vectors, lambda x: nearest(lifted(x, norm2), centers), dim, dtype)
    sizes = {r["list"]: r["count"] for r in data.groupBy("list").count().collect()}  # at most MAX_LISTS rows
    counts = np.array([sizes.get(n, 0) for n in range(lists)])
    wanted = max(probe * total, k + 1)

    def route(query_ids, queries):
        half = (centers * centers).sum(axis=1) / 2
        order = np.argsort(half - np.column_stack((queries, np.zeros(len(queries)))) @ centers.T, axis=1, kind="stable")
        before = np.cumsum(counts[order], axis=1) - counts[order]
        visits = (before < wanted) & (counts[order] > 0)
        # the floor counts sample vectors of visited lists only, and twice k of them, so that
        # k vectors above it are found even if a test errs
        visited = np.zeros((len(queries), lists), bool)
        np.put_along_axis(visited, order, visits, axis=1)
        scores = queries @ sample.T
        scores[(query_ids[:, None] == ids) | ~visited[:, sample_list[: len(ids)]]] = -np.inf
        floors = np.full(len(queries), -np.inf)
        if scores.shape[1] >= 2 * k:
            floors = np.partition(scores, -2 * k, axis=1)[:, -2 * k]
        return floors, visited

    def solve(number, query_ids, queries, floors, ids, points):
        q, x = adaptive_scan(queries @ spin, points @ spin, floors, near)
        other = query_ids[q] != ids[x]
        q, x = q[other], x[other]
        return q, x, (queries[q] * points[x]).sum(axis=1)

    return meet(data, sizes, lists, vectors.where(queries), route, solve, dim, dtype, k)
