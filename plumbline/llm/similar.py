"""Near-dedup by SimHash and BK-trees, exact at a stated Jaccard similarity of word shingles.

Texts of equal words (A-Z count as a-z) first become one node. Each node has a SimHash
fingerprint of its set of shingles (256 bits). Shards: a prefix filter brings every pair that may
be similar together; with the shingles of all sets in one order, two sets of similarity s or more
share one of the first ``n - ceil(s * n) + 1`` shingles of each. The order is by hash, with
the shingles that are common in a bounded sample of the nodes last (the order decides the
cost only, never the result). The fingerprints of a shard form BK-trees, and only pairs that a
tree finds within the radius are candidates. A candidate is linked only if the shingles
themselves, read from both texts, reach the similarity.

The radius (``search_radius``) is such that a pair at the similarity, of whatever sizes, is beyond it
with a probability below ``MISS`` (1e-12): 96 of 256 bits at similarity 0.8, where unrelated
texts differ in 128 on average. That is a bound under random hashes, not a proof for each pair.

A crowd of similar texts is not compared pair by pair: first each node of a shard goes to its
nearest earlier one, in trees of at most ``RUN`` nodes, which joins most of a crowd; then only
the pairs of a shard that are still in different components are searched, all of them. The
components are those of all pairs at the similarity.

A shingle may be in the prefix of a third of all nodes. Shards that a bounded sample shows to be
long are hot: their nodes are first dealt in parts, and what these leave open is searched in pairs
of blocks, each pair of blocks in a task of its own, so that no task holds a whole hot shard. The
sample decides the balance only, never the result.

What is left open and within the radius is compared by parity bitmaps of the shingle sets, whose
differing bits are at most the shingles that only one set has: a pair beyond the threshold's
difference never leaves its task. First a row's few nearest go to the texts, which joins most of
what is similar; only then all that are still in different components and within the bound.

Defined results: a null or empty text has no words, and all such texts are one class; fewer
words than a shingle form one shingle.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import HOT_ROWS, HOT_SHARE, as_bytes, cut_and_release, row_key, shuffle_partitions
from plumbline.llm.components import connected_components
from plumbline.llm.repeats import mixed
from plumbline.llm.simhash import BKForest, majority, shingle_hashes

#: Nodes whose shingles are counted, the count that makes one common, and the most kept.
SAMPLE, COMMON, MOST_COMMON = 1 << 14, 3, 1 << 17
#: Nodes whose prefixes tell which lists are hot, and the most rows in a part of a list.
HEAT_SAMPLE, MOST_ROWS = 1 << 12, 1 << 18
#: 64-bit words of a parity bitmap, and the partners of a row in the first comparison.
BITMAP, NEAREST = 16, 4
#: 64-bit words of a fingerprint, the chance to miss a pair, and the most nodes in a first tree.
PRINT, MISS, RUN = 4, 1e-12, 256
_PAIRS = 1 << 20
_ROW = "h long, handle long, size int, at int, part int"
_OPEN = ("h", "handle", "size", "at", "part", "component", "side")


def shingles(words: bytes, shingle: int) -> set[bytes]:
    """The distinct shingles of words joined by single spaces."""
    parts = words.split(b" ") if words else []
    if len(parts) <= shingle:
        return {words} if parts else set()
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return {words[a:b] for a, b in zip(starts[: len(parts) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)}


@functools.lru_cache
def search_radius(similarity: Fraction) -> int:
    """The least radius that a pair of that similarity exceeds with a probability below ``MISS``."""

    def more(n: int, than: int) -> float:
        """The chance that a sum of ``n`` signs is more than that."""
        return sum(math.comb(n, k) for k in range(max((n + than) // 2 + 1, 0), n + 1)) / 2**n

    def differ(common: int, x: int, y: int) -> float:
        """The chance that a bit differs between sets with so many common and own shingles."""
        out = 0.0
        for k in range(common + 1):
            p, q = more(x, common - 2 * k), more(y, common - 2 * k)
            out += math.comb(common, k) / 2**common * (p * (1 - q) + q * (1 - p))
        return out

    # small sets differ most; large ones come near the angle between two equally large
    chance = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for common in range(1, 33):
        most = (1 - similarity) * common // similarity
        chance = max([chance, *(differ(common, x, own - x) for own in range(1, most + 1) for x in range(own // 2 + 1))])
    bits, beyond = 64 * PRINT, 0.0
    for radius in range(bits, -1, -1):
        beyond += math.comb(bits, radius) * chance**radius * (1 - chance) ** (bits - radius)
        if beyond >= MISS:
            return radius
    return 0


def prefix(hashes: np.ndarray, common: np.ndarray, similarity: Fraction) -> tuple[np.ndarray, int]:
    """(first hashes of a set in the common order, size of the set)."""
    hashes = np.unique(hashes)
    n = len(hashes)
    rank = np.zeros(n, np.int64)
    if len(common):
        # its second row has the ranks of the sorted hashes in the first, rarest first
        at = np.minimum(np.searchsorted(common[0], hashes), common.shape[1] - 1)
        rank = np.where(common[0][at] == hashes, common[1][at].astype(np.int64) + 1, 0)
    least = -(-similarity.numerator * n // similarity.denominator)
    return hashes[np.lexsort((hashes, rank))][: n - least + 1], n


def _nodes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(node, handle, low, packed)``: distinct word sequences; ``low`` has their first row."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            words = [b" ".join((t.as_py() or b"").lower().split()) for t in as_bytes(batch.column(2))]
            node = pa.array([hashlib.blake2b(w, digest_size=16).digest() for w in words], pa.binary())
            packed = pa.array([press.compress(w) for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node, packed], ["id", "key", "node", "packed"])

    source = df.select(F.col(f"`{id_col}`").alias("id"), row_key(id_col, text_col).alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    noted = source.mapInArrow(work, f"id {kind}, key binary, node binary, packed binary")
    low = F.min(F.struct(F.col("id").isNotNull().alias("has"), "id", "key")).alias("low")
    return noted.groupBy("node").agg(low, F.first("packed").alias("packed")).withColumn("handle", F.xxhash64("node"))


def _sample(nodes: DataFrame, total: int, size: int) -> DataFrame:
    """About ``size`` of the nodes, by hash; all of them, if there are no more."""
    below = -(1 << 63) + int(min(1.0, size / max(total, 1)) * ((1 << 64) - 1))
    return nodes.where(F.col("handle") <= F.lit(min(below, (1 << 63) - 1))).select("packed")


def _common(nodes: DataFrame, total: int, shingle: int) -> np.ndarray:
    """Shingle hashes that several nodes of a sample have, sorted, above their ranks by count."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                hashes = np.unique(shingle_hashes(zstandard.decompress(packed.as_py()), shingle))
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["h"])

    some = _sample(nodes, total, SAMPLE).mapInArrow(work, "h long")
    found = some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()
    hashes = np.array([r["h"] for r in reversed(found)], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return np.stack([hashes[order], order.astype(np.uint64)]) if len(found) else np.zeros((0, 0), np.uint64)


def _hot(nodes: DataFrame, total: int, common: np.ndarray, shingle: int, similarity: Fraction, piece: int) -> np.ndarray:
    """Hashes whose lists seem longer than half a piece, sorted, above their numbers of parts."""
    held = nodes.sparkSession.sparkContext.broadcast(common)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                first, _ = prefix(shingle_hashes(zstandard.decompress(packed.as_py()), shingle), held.value, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64))], ["h"])

    each = max(1.0, total / HEAT_SAMPLE)  # nodes that one of the sample stands for
    counted = _sample(nodes, total, HEAT_SAMPLE).mapInArrow(work, "h long").groupBy("h").agg(F.count("*").alias("n"))
    found = counted.where((F.col("n") >= COMMON) & (F.col("n") * each > piece / 2)).orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()
    rows = sorted((r["h"], 1 + int(r["n"] * each // piece)) for r in found)
    return np.array(rows, np.int64).reshape(-1, 2).T


def _part(h: np.ndarray, handle: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The part of its list that a row belongs to; -1 where the list is not hot."""
    if not hot.shape[1]:
        return np.full(len(h), -1, np.int32)
    at = np.minimum(np.searchsorted(hot[0], h), hot.shape[1] - 1)
    # a node is in other company in each of its lists
    dealt = (mixed(handle.view(np.uint64) ^ mixed(h.view(np.uint64))) % hot[1][at].astype(np.uint64)).astype(np.int32)
    return np.where(hot[0][at] == h, dealt, -1).astype(np.int32)


def _lists(nodes: DataFrame, common: np.ndarray, hot: np.ndarray, shingle: int, similarity: Fraction) -> DataFrame:
    """``(h, handle, size, at, part)``: prefix shingles that several nodes have."""
    held = nodes.sparkSession.sparkContext.broadcast((common, hot))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, counts, sizes = [np.zeros(0, np.uint64)], [], []
            for packed in batch.column(1):
                f, n = prefix(shingle_hashes(zstandard.decompress(packed.as_py()), shingle), held.value[0], similarity)
                first.append(f)
                counts.append(len(f))
                sizes.append(n)
            counts = np.array(counts, np.int64)
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            h, handle = np.concatenate(first).view(np.int64), np.repeat(batch.column(0).to_numpy(), counts)
            columns = [h, handle, np.repeat(np.array(sizes, np.int32), counts), at.astype(np.int32), _part(h, handle, held.value[1])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "handle", "size", "at", "part"])

    return _several(_dealt(nodes.select("handle", "packed").mapInArrow(work, _ROW)))


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` with every part of a list together and sorted."""
    return rows.repartition(shuffle_partitions(rows.sparkSession), "h", "part").sortWithinPartitions("h", "part", "handle")


def _changes(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Whether each row but the first begins a part of a list."""
    h, part = table.column("h").to_numpy(), table.column("part").to_numpy()
    return (h[1:] != h[:-1]) | (part[1:] != part[:-1])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of whole parts of lists, as tables, from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and _changes(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]))[0]:
            yield pa.Table.from_batches(held)
            held = []
        starts = np.flatnonzero(_changes(batch))
        if len(starts):
            yield pa.Table.from_batches([*held, batch.slice(0, int(starts[-1]) + 1)])
            held = []
        held.append(batch.slice(int(starts[-1]) + 1 if len(starts) else 0))
    if held:
        yield pa.Table.from_batches(held)


def _several(rows: DataFrame) -> DataFrame:
    """The rows of sorted ``rows`` that share their list, and all of hot lists."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            same = ~_changes(table)
            shared = np.concatenate(([False], same)) | np.concatenate((same, [False])) | (table.column("part").to_numpy() >= 0)
            yield from table.filter(pa.array(shared)).to_batches()

    return rows.mapInArrow(work, _ROW)


def _may_reach(size_a, at_a, size_b, at_b, similarity: Fraction):
    """Whether sets whose first common shingle has these places can be so similar. A pair
    that is, is so at its first common shingle, which both prefixes have."""
    p, q = similarity.numerator, similarity.denominator
    rest = np.minimum(size_a - at_a, size_b - at_b).astype(np.int64)
    return rest * (p + q) >= p * (size_a.astype(np.int64) + size_b)


def _marks(texts: DataFrame, shingle: int) -> DataFrame:
    """``(handle, print, bits)``: the fingerprint of a set of shingles, and a bitmap with a bit for
    the parity of the shingles that it stands for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, bits = [], []
            for packed in batch.column(1):
                hashes = np.unique(shingle_hashes(zstandard.decompress(packed.as_py()), shingle))
                prints.append(majority(hashes, PRINT).tobytes())
                odd = np.bincount((mixed(hashes) % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) % 2
                bits.append(np.packbits(odd.astype(bool)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array(bits, pa.binary())], ["handle", "print", "bits"])

    return texts.select("handle", "packed").mapInArrow(work, "handle long, print binary, bits binary")


def _words(column: pa.ChunkedArray, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)


def _unsettled(rows: DataFrame) -> DataFrame:
    """The rows of sorted ``rows`` whose part has several components."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            starts = np.concatenate(([True], _changes(table)))
            c = table.column("component").to_numpy()
            first = c[np.maximum.accumulate(np.where(starts, np.arange(len(c)), 0))]
            group = np.cumsum(starts) - 1
            several = np.bincount(group, weights=c != first) > 0
            yield from table.filter(pa.array(several[group])).to_batches()

    return rows.select(*_OPEN).mapInArrow(work, _ROW + ", component long, side int")


def _pairs(lists: DataFrame, similarity: Fraction, nearest: int | None = None) -> DataFrame:
    """Distinct candidates ``(a, b)`` of handles, from sorted lists with a ``print``: each row with
    its nearest earlier one of its part or, if lists have a ``component``, those within the radius
    and the bound of ``bits`` that have different ones and, unless it is -1, different ``side``:
    all, or only the ``nearest`` of a row."""
    p, q = similarity.numerator, similarity.denominator
    radius = search_radius(similarity)

    def first(table: pa.Table) -> Iterator[np.ndarray]:
        h, handle, size, at, part = (table.column(c).to_numpy() for c in ("h", "handle", "size", "at", "part"))
        # neighbours in size; four orders among equal sizes, so that crowds mix
        mix = (handle ^ (h & 3)) * np.int64(-7046029254386353131)
        order = np.lexsort((mix, size, part, h))
        h, handle, size, at, part = (c[order] for c in (h, handle, size, at, part))
        starts = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (part[1:] != part[:-1]))))
        counts = np.diff(np.append(starts, len(h)))
        place = np.arange(len(h)) - np.repeat(starts, counts)
        tree = np.cumsum(place % RUN == 0)
        near = BKForest(_words(table.column("print"), PRINT)[order], tree).nearest(radius)
        i = np.flatnonzero(near >= 0)
        j = near[i]
        ok = _may_reach(size[i], at[i], size[j], at[j], similarity)
        yield np.stack([handle[i[ok]], handle[j[ok]]])

    def apart(table: pa.Table) -> Iterator[np.ndarray]:
        d, s, a, c, side = (table.column(x).to_numpy() for x in ("handle", "size", "at", "component", "side"))
        bits = _words(table.column("bits"), BITMAP)
        group = np.cumsum(np.concatenate(([0], _changes(table))))
        # of a pair in different components, one is outside the largest
        order = np.lexsort((c, group))
        new = np.concatenate(([True], (c[order][1:] != c[order][:-1]) | (group[order][1:] != group[order][:-1])))
        sizes = np.bincount(np.cumsum(new) - 1)
        of = group[order][new]
        best = np.lexsort((-sizes, of))
        top = best[np.concatenate(([True], of[best][1:] != of[best][:-1]))]
        largest = np.empty(len(c), bool)
        largest[order] = np.isin(np.cumsum(new) - 1, top)
        for i, j in BKForest(_words(table.column("print"), PRINT), group).around(np.flatnonzero(~largest), radius):
            ok = (c[i] != c[j]) & (largest[j] | (j > i)) & ((side[i] < 0) | (side[i] != side[j]))
            ok &= _may_reach(s[i], a[i], s[j], a[j], similarity)
            i, j = i[ok], j[ok]
            close, differ = [np.zeros(0, bool)], [np.zeros(0, np.int64)]
            for low in range(0, len(i), 1 << 16):
                x, y = i[low : low + (1 << 16)], j[low : low + (1 << 16)]
                differ.append(np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64))
                both = s[x].astype(np.int64) + s[y]
                close.append((both - differ[-1]) * (p + q) >= 2 * p * both)
            close, differ = np.concatenate(close), np.concatenate(differ)
            i, j, differ = i[close], j[close], differ[close]
            if nearest is not None and len(i):
                order = np.lexsort((j, differ, i))
                i, j = i[order], j[order]
                starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
                few = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i)))) < nearest
                i, j = i[few], j[few]
            yield np.stack([d[i], d[j]])

    find = apart if "component" in lists.columns else first

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            both = np.concatenate(held, axis=1)
            both = np.unique(np.sort(both, axis=0), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        for table in _groups(batches):
            for pairs in find(table):
                held.append(pairs)
                size += pairs.shape[1]
                if size > _PAIRS:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return lists.mapInArrow(work, "a long, b long").where("a <> b").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: Fraction) -> DataFrame:
    """Links ``(a, b)`` of the nodes of those pairs whose shingles reach the similarity."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, set[bytes]] = {}

        def of(node: bytes, packed: bytes) -> set[bytes]:
            if node not in known:
                if len(known) >= 256:
                    known.clear()
                known[node] = shingles(zstandard.decompress(packed), shingle)
            return known[node]

        for batch in batches:
            linked = []
            for a, x, b, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = of(a, x), of(b, y)
                both = len(one & two)
                if both * similarity.denominator >= similarity.numerator * (len(one) + len(two) - both):
                    linked.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in linked], pa.binary()) for i in (0, 1)], ["a", "b"])

    one = texts.select(F.col("handle").alias("a"), F.col("node").alias("na"), F.col("packed").alias("ta"))
    two = texts.select(F.col("handle").alias("b"), F.col("node").alias("nb"), F.col("packed").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("na", "ta", "nb", "tb").mapInArrow(work, "a binary, b binary")


def _open(lists: DataFrame, place: DataFrame, piece: int) -> DataFrame:
    """The rows of lists that may have pairs left, sorted, with ``component`` and ``side``: a part
    is a list, or two blocks of a hot one, whose sides are then compared with one another."""
    cold, hot = lists.where("part < 0"), lists.where("part >= 0")
    longer = cold.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").select("h")
    cold = cold.join(longer, "h", "left_semi").join(place, "handle").withColumn("side", F.lit(-1))
    hot = hot.join(place, "handle")
    # at most MOST_COMMON lists are hot
    left = hot.groupBy("h").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    left = left.select("h", F.ceil(F.col("n") / piece).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("h", "handle"), F.col("blocks")).cast("int")
    pairs = hot.join(F.broadcast(left), "h").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumn("part", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    pairs = pairs.withColumn("side", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")))
    return _dealt(cold.unionByName(pairs.select(*cold.columns)))


def _keepers(df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: Fraction, piece: int | None) -> DataFrame:
    """``(node, root, low)``: the component of every node."""
    nodes = cut_and_release(_nodes(df, id_col, text_col))
    total = nodes.count()
    piece = piece or min(max(total // HOT_SHARE, HOT_ROWS), MOST_ROWS)
    common = _common(nodes, total, shingle)
    lists = cut_and_release(_lists(nodes, common, _hot(nodes, total, common, shingle, similarity, piece), shingle, similarity))
    texts = cut_and_release(nodes.select("handle", "node", "packed").join(lists.select("handle").distinct(), "handle", "left_semi"))
    marks = cut_and_release(_marks(texts, shingle))
    tried = cut_and_release(_pairs(_dealt(lists.join(marks.select("handle", "print"), "handle")), similarity))
    found = cut_and_release(_verified(tried, texts, shingle, similarity))
    joined = cut_and_release(connected_components(found))
    # what the first trees left apart: the nearest, then all
    for nearest in (NEAREST, None):
        place = texts.join(joined, "node", "left").groupBy("handle").agg(F.min(F.xxhash64(F.coalesce("component", "node"))).alias("component"))
        opened = cut_and_release(_unsettled(_open(lists, place, piece)))
        near = cut_and_release(_pairs(_dealt(opened.join(marks, "handle")), similarity, nearest))
        if near.isEmpty():
            break
        left = cut_and_release(near.join(tried, ["a", "b"], "left_anti"))
        more = cut_and_release(_verified(left, texts, shingle, similarity))
        if not more.isEmpty():
            tried, found = tried.union(left), found.union(more)
            joined = cut_and_release(connected_components(found))
    return nodes.select("node", "low").join(joined, "node", "left").select("node", "low", F.coalesce("component", "node").alias("root"))


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, piece: int | None = None) -> DataFrame:
    """``df`` with one row of each class of similar texts, that of the smallest id (a null
    id first); of rows that repeat an id and a text, one stays. Rows are told apart by both.
    ``piece`` is the most rows of a hot list that meet in a task; it changes no result."""
    classes = _keepers(df, id_col, text_col, shingle, Fraction(str(similarity)), piece)
    keep = cut_and_release(classes.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.key").alias("_key")))
    return df.withColumn("_key", row_key(id_col, text_col)).join(keep, "_key", "left_semi").dropDuplicates(["_key"]).drop("_key")
