"""SimHash near-dedup with BK-trees.

Fingerprints: bit majority of the XXH64 hashes of a text's word shingles. Two documents are
linked if their fingerprints differ in at most ``radius`` bits; classes are the connected
components of the links.

Search: equal fingerprints first become one node. Every fingerprint goes to ``radius + 1``
shards, one for each block of its bits: two fingerprints within the radius agree on at
least one block. A shard's distinct fingerprints form a BK-tree (children keyed by their
Hamming distance to the parent), and a search follows only edges whose key is within the
radius of the distance to the query. A shard with more than ``tree_limit`` fingerprints is
split again by blocks of the bits that are still free; after two such splits at most
2**19 different fingerprints can share a shard, so a tree has a proven bound at any corpus
size. A tree stays with the task that owns its shard, because the trees together grow with the corpus. Each shard returns only the edges of
a spanning forest of its links, never all pairs.

Defined results: a null or empty text has no words and fingerprint zero; fewer words than a
shingle form one shingle; repeated rows are linked; a null id sorts before all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import as_bytes, cut, join_unique, shuffle_partitions
from plumbline.llm.components import connected_components
from plumbline.llm.repeats import mixed

SEED = 42
TREE_LIMIT = 4096
_CHUNK = 1 << 20


def shingle_hashes(text: bytes | None, shingle: int = 3, seed: int = SEED) -> np.ndarray:
    """XXH64 of every word shingle of a UTF-8 text, repeats included; A-Z count as a-z."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)


def fingerprint(text: bytes | None, shingle: int = 3, words: int = 1) -> np.ndarray:
    """The fingerprint of ``64 * words`` bits; further words use remixed shingle hashes."""
    return majority(shingle_hashes(text, shingle), words)


def majority(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """The bits that over half of the hashes have set, in ``words`` words."""
    out = np.zeros(words, np.uint64)
    for w in range(words):
        set_in = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 14):
            part = hashes[at : at + (1 << 14)]
            part = (mixed(part + np.uint64(w)) if w else part).astype("<u8")
            set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(set_in * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, words: int = 1) -> DataFrame:
    """``(id, print)`` for each row; ``print`` is a long with the bits, or binary for several words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle, words) for t in as_bytes(batch.column(1))]
            kept = pa.array([p.astype(">u8").tobytes() for p in prints], pa.binary()) if words > 1 else pa.array(np.array(prints, np.uint64).view(np.int64).ravel(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), kept], ["id", "print"])

    source = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(work, "id long, print binary" if words > 1 else "id long, print long")


class BKForest:
    """BK-trees over many shards at once, built and searched a level at a time."""

    def __init__(self, prints: np.ndarray, shard: np.ndarray):
        """``prints`` (rows of 64-bit words) are distinct within each run of equal ``shard`` values."""
        n = len(prints)
        self.prints = prints
        self.keys = 64 * prints.shape[1] + 1
        self.root = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if n else np.zeros(0, np.int64)
        self.tree = np.cumsum(np.concatenate(([0], (shard[1:] != shard[:-1]).astype(np.int64)))) if n else np.zeros(0, np.int64)
        parent, key = np.full(n, -1), np.zeros(n, np.int64)
        waiting = np.setdiff1d(np.arange(n), self.root, assume_unique=True)
        under = self.root[self.tree[waiting]]
        while len(waiting):
            distance = self._distance(waiting, under)
            order = np.lexsort((waiting, distance, under))
            waiting, under, distance = waiting[order], under[order], distance[order]
            new = np.concatenate(([True], (under[1:] != under[:-1]) | (distance[1:] != distance[:-1])))
            parent[waiting[new]], key[waiting[new]] = under[new], distance[new]
            child = waiting[new][np.cumsum(new) - 1]
            waiting, under = waiting[~new], child[~new]
        self.order = np.lexsort((key, parent))
        self.edge = parent[self.order] * self.keys + key[self.order]

    def _distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.prints[a] ^ self.prints[b]).sum(axis=1, dtype=np.int64)

    def near(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) of one tree within the radius, a bounded chunk at a time."""
        stack = []
        for at in range(0, len(self.prints), _CHUNK):
            query = np.arange(at, min(at + _CHUNK, len(self.prints)))
            stack.append((query, self.root[self.tree[query]]))
        while stack:
            query, node = stack.pop()
            if len(query) > _CHUNK:
                half = len(query) // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            distance = self._distance(query, node)
            hit = (distance <= radius) & (query > node)
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.edge, node * self.keys + np.maximum(distance - radius, 0))
            count = np.searchsorted(self.edge, node * self.keys + np.minimum(distance + radius, self.keys - 1), "right") - low
            if count.any():
                # a frontier grows at most to the children within the radius: expand in parts
                total = np.cumsum(count)
                for part in np.split(np.arange(len(query)), np.searchsorted(total, np.arange(4 * _CHUNK, total[-1], 4 * _CHUNK))):
                    c = count[part]
                    child = self.order[np.repeat(low[part] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
                    if len(child):
                        stack.append((np.repeat(query[part], c), child))


    def _batches(self, queries: np.ndarray) -> Iterator[np.ndarray]:
        """Runs of queries whose trees have a bounded number of nodes in all."""
        total = np.cumsum(np.bincount(self.tree)[self.tree[queries]])
        for part in np.split(queries, np.searchsorted(total, np.arange(4 * _CHUNK, total[-1], 4 * _CHUNK)) if len(queries) else []):
            if len(part):
                yield part

    def _under(self, query: np.ndarray, node: np.ndarray, distance: np.ndarray, radius: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Each query with the children of its node whose keys are within the radius of the distance."""
        low = np.searchsorted(self.edge, node * self.keys + np.maximum(distance - radius, 0))
        count = np.searchsorted(self.edge, node * self.keys + np.minimum(distance + radius, self.keys - 1), "right") - low
        child = self.order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        return np.repeat(query, count), child

    def around(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, other node of its tree) within the radius; all of a query come together."""
        for query in self._batches(queries):
            hits, node = [], self.root[self.tree[query]]
            while len(query):
                distance = self._distance(query, node)
                hit = (distance <= radius) & (query != node)
                hits.append((query[hit], node[hit]))
                query, node = self._under(query, node, distance, radius)
            yield np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])

    def nearest(self, radius: int) -> np.ndarray:
        """The nearest earlier node of each node's tree within the radius, the first of several, or -1.
        The search narrows to the least distance found."""
        n = len(self.prints)
        best = np.full(n, (radius + 1) * n)  # distance * n + node
        for query in self._batches(np.arange(n)):
            node = self.root[self.tree[query]]
            while len(query):
                earlier = node < query  # a child comes after its parent
                query, node = query[earlier], node[earlier]
                distance = self._distance(query, node)
                np.minimum.at(best, query, distance * n + node)
                query, node = self._under(query, node, distance, np.minimum(best[query] // max(n, 1), radius))
        return np.where(best < (radius + 1) * n, best % max(n, 1), -1)


def _forest_roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest member of each member's set after joining all pairs."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
    return root


def _blocks(free: list[int], parts: int) -> list[list[int]]:
    """``free`` bit numbers in ``parts`` runs of nearly equal size."""
    return [list(b) for b in np.array_split(np.array(free), parts)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(prints: DataFrame, radius: int = 2, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints whose components are those of all
    pairs within ``radius`` bits. ``prints`` has the distinct fingerprints in ``print``."""
    parts = radius + 1
    spark = prints.sparkSession
    # a shard is named by a level, the mask of its fixed bits and their values
    level: list[tuple[int, list[int]]] = [(_mask(b), [x for x in range(64) if x not in b]) for b in _blocks(list(range(64)), parts)]
    rows = prints.select("print", F.explode(F.array(*[F.lit(_signed(m)) for m, _ in level])).alias("mask"))
    out = None
    for depth in range(3):
        rows = rows.withColumn("value", F.col("print").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "value").agg(F.count("*").alias("size")).where("size > 1")
        if depth < 2:
            small, large = sizes.where(F.col("size") <= tree_limit), sizes.where(F.col("size") > tree_limit)
        else:
            small, large = sizes, None
        found = _solve(rows.join(small.select("mask", "value"), ["mask", "value"]), radius, shuffle_partitions(spark))
        out = found if out is None else out.union(found)
        if large is None:
            break
        large = cut(large.select("mask", "value"))
        if large.isEmpty():
            break
        level_next, options = [], F.create_map()
        pairs = []
        for mask, free in level:
            wider = [(mask | _mask(b), [x for x in free if x not in b]) for b in _blocks(free, parts)]
            pairs += [F.lit(_signed(mask)), F.array(*[F.lit(_signed(m)) for m, _ in wider])]
            level_next += wider
        options = F.create_map(*pairs)
        rows = rows.join(large, ["mask", "value"]).select("print", F.explode(options[F.col("mask")]).alias("mask"))
        level = level_next
    return out


def _solve(rows: DataFrame, radius: int, partitions: int) -> DataFrame:
    """Spanning links of the distinct fingerprints that share ``mask`` and ``value``."""
    wide = rows.schema["print"].dataType.typeName() == "binary"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            same = (held["mask"] == held["mask"].iloc[-1]) & (held["value"] == held["value"].iloc[-1])
            done, held = held[~same], held[same]
            if len(done):
                yield solved(done)
        if held is not None and len(held):
            yield solved(held)

    def solved(frame: pd.DataFrame) -> pd.DataFrame:
        column, mask, value = (frame[c].to_numpy() for c in ("print", "mask", "value"))
        prints = np.frombuffer(b"".join(column), ">u8").astype(np.uint64).reshape(len(column), -1) if wide else column.view(np.uint64).reshape(-1, 1)
        change = (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])
        forest = BKForest(prints, np.concatenate(([0], np.cumsum(change))))
        root = _forest_roots(len(prints), forest.near(radius))
        linked = root != np.arange(len(root))
        return pd.DataFrame({"a": column[linked], "b": column[root[linked]]})

    kind = "binary" if wide else "long"
    return rows.select("mask", "value", "print").repartition(partitions, "mask", "value").sortWithinPartitions("mask", "value", "print").mapInPandas(work, f"a {kind}, b {kind}")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``(id_col, print, component)`` for each row; the component is its smallest id."""
    return _classes(fingerprints(df, id_col, text_col, shingle), lambda prints: links(prints, radius), id_col)


def _classes(prints: DataFrame, search, id_col: str) -> DataFrame:
    prints = cut(prints)
    nodes = cut(prints.groupBy("print").agg(F.min(F.struct(F.col("id").isNotNull(), "id")).alias("low")))
    joined = connected_components(search(nodes.select("print"))).withColumnRenamed("node", "print")
    linked = cut(joined.join(nodes, "print"))
    smallest = linked.groupBy("component").agg(F.min("low").alias("least"))
    # a class and a fingerprint may each have a third of all rows
    of_linked = cut(join_unique(linked.select("print", "component"), smallest, "component").select("print", "least"))
    classes = nodes.join(of_linked, "print", "left").select("print", F.coalesce("least", "low")["id"].alias("component"))
    return join_unique(prints, classes, "print").select(F.col("id").alias(id_col), "print", "component")


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, piece: int | None = None) -> DataFrame:
    """``df`` with one row of each class of similar texts; see ``plumbline.llm.similar``."""
    from plumbline.llm import similar

    return similar.drop_similar(df, id_col, text_col, shingle, similarity, piece)
