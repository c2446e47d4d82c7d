"""What the two vector searches share: packing, routing to parts, and the last merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import cut

#: Vectors of a part at most, nearly: small lists share a part, a larger one is dealt over several.
PART_ROWS = 4096
#: Bytes of vectors that go to the driver as a sample.
SAMPLE_BYTES = 8 << 20
_QUERY_CHUNK = 512


def common_length(df: DataFrame, vec_col: str) -> int:
    """The most frequent vector length; of equally frequent ones the larger."""
    sizes = df.select(F.size(f"`{vec_col}`").alias("n")).where("n > 0").groupBy("n").count()
    best = sizes.orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return best[0]["n"] if best else 0


def packed(df: DataFrame, id_col: str, vec_col: str, keep: Callable, dtype: str) -> DataFrame:
    """``(id, vec, norm2)`` of the usable rows, in the shared folder.

    ``keep(matrix)`` maps a matrix of doubles to (values, usable rows). Null ids, null
    vectors, null components and vectors of another than the most frequent length are unusable.
    """
    dim = common_length(df, vec_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            if not batch.num_rows:
                continue
            values, usable = keep(flat)
            at = np.flatnonzero(usable & np.isfinite(flat).all(axis=1))
            values = np.ascontiguousarray(values[at].astype(dtype))
            rows = [v.tobytes() for v in values]
            wide = values.astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(rows, pa.binary()), pa.array((wide * wide).sum(axis=1))], ["id", "vec", "norm2"])

    vec = F.col(f"`{vec_col}`")
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.cast("array<double>").alias("vec"))
    source = source.where(F.col("id").isNotNull() & (F.size("vec") == max(dim, 1)) & ~F.exists("vec", lambda x: x.isNull()))
    return cut(source.mapInArrow(work, "id long, vec binary, norm2 double"))


def sampled(vectors: DataFrame, total: int, dim: int, dtype: str, most: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of a bounded sample of the ``total`` rows: those of the smallest hashes.

    Only about twice as many rows are sorted, so that tasks together send the driver no more
    as the table grows.
    """
    most = max(1, min(most, SAMPLE_BYTES // (8 * max(dim, 1))))
    below = -(1 << 63) + int(min(1.0, 2 * most / max(total, 1)) * ((1 << 64) - 1))
    ordered = lambda rows: rows.orderBy(F.xxhash64("id"), "id").limit(most).select("id", "vec").collect()
    rows = ordered(vectors.where(F.xxhash64("id") <= F.lit(min(below, (1 << 63) - 1))))
    if len(rows) < min(most, total):  # ids that are alike share a hash
        rows = ordered(vectors)
    return np.array([r["id"] for r in rows], np.int64), matrix([bytes(r["vec"]) for r in rows], dim, dtype)


def matrix(blobs, dim: int, dtype: str) -> np.ndarray:
    values = np.frombuffer(b"".join(blobs), dtype).astype(np.float64)
    return values.reshape(-1, dim) if dim else values.reshape(0, 0)


def assigned(vectors: DataFrame, nearest: Callable, dim: int, dtype: str) -> DataFrame:
    """``(id, vec, list, gap)``: ``nearest(matrix)`` gives a list and a distance for each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, gap = nearest(matrix(batch.column(1).to_pylist(), dim, dtype))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(number.astype(np.int32)), pa.array(gap)], ["id", "vec", "list", "gap"])

    return cut(vectors.select("id", "vec").mapInArrow(work, "id long, vec binary, list int, gap double"))


def parts_of(sizes: dict[int, int], lists: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """(first part of each list, its number of parts, the lists of each part)."""
    first, spread, members = np.zeros(lists, np.int64), np.ones(lists, np.int64), []
    held = PART_ROWS
    for n in sorted(sizes):
        pieces = -(-sizes[n] // PART_ROWS)
        if pieces > 1 or held + sizes[n] > PART_ROWS:
            first[n], spread[n] = len(members), pieces
            members += [[n] for _ in range(pieces)]
            held = sizes[n] if pieces == 1 else PART_ROWS
        else:
            first[n] = len(members) - 1
            members[-1].append(n)
            held += sizes[n]
    return first, spread, members


def meet(data: DataFrame, sizes: dict[int, int], lists: int, queries: DataFrame, route: Callable, solve: Callable, dim: int, dtype: str, k: int) -> DataFrame:
    """``(query_id, rank, id, score)``: the k best of the lists that each query visits.

    ``route(ids, matrix)`` gives the floors of a chunk of queries and a matrix that says which
    lists each visits; ``solve(list, query ids, queries, floors, ids, vectors)`` gives (query
    numbers, vector numbers, scores) of what may be among the best of a list. A query goes
    to a part once, however many of its lists it visits. The k-th best score found in a part
    so far raises the floor for the lists that follow in it.
    """
    first, spread, members = parts_of(sizes, lists)
    score = "long" if dtype == "<i8" else "double"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(2).to_numpy().astype(np.int64)
            mixed = batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            part = first[number] + (mixed % spread[number].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), *(batch.column(i) for i in range(3))], ["part", "id", "vec", "list"])

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), _QUERY_CHUNK):
                some = frame.iloc[at : at + _QUERY_CHUNK]
                ids, blobs = some["id"].to_numpy(), some["vec"].to_numpy()
                floors, visits = route(ids, matrix(blobs, dim, dtype))
                rows = []
                for part, here in enumerate(members):
                    which = np.flatnonzero(visits[:, here].any(axis=1))
                    if len(which):
                        seen = np.packbits(visits[np.ix_(which, here)], axis=None).tobytes()
                        rows.append({"part": part, "ids": ids[which].tobytes(), "vecs": b"".join(blobs[which]), "floors": floors[which].tobytes(), "visits": seen})
                if rows:
                    yield pd.DataFrame(rows)

    def local(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "id": [], "score": []}
        if len(left):
            left = left.sort_values("list", kind="stable")
            ids, vectors, number = left["id"].to_numpy(), matrix(left["vec"], dim, dtype), left["list"].to_numpy()
            runs = [(n, *np.searchsorted(number, (n, n + 1))) for n in np.unique(number).tolist()]
            for row in right.itertuples():
                here = members[row.part]
                query_ids, floors = np.frombuffer(row.ids, np.int64), np.frombuffer(row.floors, np.float64).copy()
                asked, some = matrix([row.vecs], dim, dtype), np.zeros((len(query_ids), 0))
                visits = np.unpackbits(np.frombuffer(row.visits, np.uint8), count=len(query_ids) * len(here)).reshape(-1, len(here)).astype(bool)
                found = []
                for n, a, b in runs:
                    which = np.flatnonzero(visits[:, here.index(n)])
                    if not len(which):
                        continue
                    q, x, scores = solve(n, query_ids[which], asked[which], floors[which], ids[a:b], vectors[a:b])
                    q = which[q]
                    found.append((q, a + x, scores))
                    some = _best_so_far(some, q, scores, k)
                    if some.shape[1] == k:  # the slack is for whole numbers beyond a double's digits
                        floors = np.maximum(floors, some.min(axis=1) - 4e-16 * np.abs(some).max(axis=1, initial=0, where=np.isfinite(some)))
                if found:
                    q, x, scores = (np.concatenate(c) for c in zip(*found, strict=True))
                    order = np.lexsort((ids[x], -scores, q))
                    q, x, scores = q[order], x[order], scores[order]
                    best = np.arange(len(q)) - np.searchsorted(q, q) < k
                    out["query_id"].append(query_ids[q[best]])
                    out["id"].append(ids[x[best]])
                    out["score"].append(scores[best])
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()})

    placed = data.select("id", "vec", "list").mapInArrow(deal, "part long, id long, vec binary, list int")
    sent = queries.select("id", "vec").mapInPandas(send, "part long, ids binary, vecs binary, floors binary, visits binary")
    found = placed.groupBy("part").cogroup(sent.groupBy("part")).applyInPandas(local, f"query_id long, id long, score {score}")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _best_so_far(some: np.ndarray, q: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The k best scores of each query among the columns of ``some`` and the new ones."""
    order = np.lexsort((-scores, q))
    place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
    kept = order[place < k]
    new = np.full((len(some), min(k, int(place.max(initial=-1)) + 1)), -np.inf)
    new[q[kept], place[place < k]] = scores[kept]
    both = np.concatenate((some, new), axis=1)
    return np.partition(both, both.shape[1] - k, axis=1)[:, -k:] if both.shape[1] > k else both
