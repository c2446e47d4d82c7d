"""Distributed search for passages that repeat across documents.

Shared frame of the two substring operators. A *window* is a run of a fixed number of
symbols (bytes or words) of one document; a window is repeated if the same symbols also
start in a document with a smaller id. Four passes, none of which gathers more than a
bounded unit or one shard in a task:

1. ``units``: documents are packed, as they are scanned, into compressed units of about
   2 MB and written to the shared folder. A unit is the fixed piece of work of all later
   passes, so a lost executor only means that a unit is worked on again.
2. ``routing``: every window contains a *minimizer*, the gram with the smallest hash among
   its grams. Equal windows have equal minimizers, so only segments (runs of windows) whose
   minimizer occurs in two documents can hold repeats. A unit ships each distinct minimizer
   hash once, with its first document and place there; a shard answers, for those that two
   documents have, with a *route*: the first document of all and the block of its text.
3. ``matching``: neighbouring segments of one route are one *piece*, so that a copied passage
   travels whole. The pieces of a route are the reference of an index; a unit's pieces are
   streamed through it, and the index says of every window under which document it comes first.
   That answer goes back as two bits: whether the first document is smaller than the smallest
   of the unit that has the piece, and whether it is at most that one.
4. ``marking``: a unit applies the bits to all its documents.

All windows of a minimizer have one route, and a route is indexed as a whole, so every two
equal windows meet. What repeats is decided by the index on the symbols themselves; hashes
only route. Equal pieces are one text of the reference, with their smallest document. A
piece that one document alone has, in a route without others, is not indexed.

A minimizer with more than ``CROWDED`` different segments would fill one shard. The shards
of pass 2 see this from counts that the units send, and units then ship such segments
window by window, routed by the hash of the whole window: equal windows still meet. A
passage that very many units hold counts once for each of them and may take this way too, at
more bytes shipped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import as_bytes, cut, ensure_checkpoint_dir, release, shuffle_partitions

UNIT_BYTES = 2 << 20
UNIT_ROWS = 4096
#: Bytes of text for each shard of the minimizers and of the segments.
SHARD_BYTES = 16 << 20
#: Different segments of one minimizer (summed over units) that one shard takes in.
CROWDED = 1 << 14
#: Symbols that are hashed at a time, so that the arrays stay in a core's cache.
BLOCK = 1 << 14
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HASH_MASK = np.uint64((1 << 48) - 1)
#: The most windows of a piece, and the windows of a block of the first document.
PIECE = 512
#: The route of a crowded minimizer: its windows have routes of their own.
_OWN = np.uint64(0)


@dataclass(frozen=True)
class Windows:
    """What a window is: ``length`` symbols, routed by grams of ``gram`` symbols."""

    length: int
    gram: int
    #: (text bytes of a unit, document offsets) -> Symbols
    read: Callable
    #: (distinct pieces, owners) -> for each piece the first owners of its windows
    first_owners: Callable
    #: different segments of one minimizer beyond which its windows are routed one by one
    crowded: int = CROWDED

    @property
    def span(self) -> int:
        """Grams in a window; also the most windows of a segment."""
        return self.length - self.gram + 1


@dataclass
class Symbols:
    """Symbols of the documents of a unit: a hash for each gram start, and offsets."""

    grams: np.ndarray
    offsets: np.ndarray
    #: content(document, first symbol, symbol after the last) -> bytes
    content: Callable


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(32)
    x *= _MIX2
    x ^= x >> np.uint64(29)
    return x


def _lows(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each run of ``span`` values."""
    out = np.empty(max(len(values) - span + 1, 0), values.dtype)
    for at in range(0, len(out), BLOCK):
        to = min(at + BLOCK, len(out))
        out[at:to] = _block_lows(values[at : to + span - 1], span)
    return out


def _block_lows(values: np.ndarray, span: int) -> np.ndarray:
    done = 1
    while done * 2 <= span:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (span - done)], values[span - done :]) if done < span else values


def segments(symbols: Symbols, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer hash, document, first window, windows) of every segment, in order."""
    sizes = np.diff(symbols.offsets)
    if not len(symbols.grams) or sizes.max(initial=0) < windows.length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    low = _lows(symbols.grams, windows.span)
    counts = np.maximum(sizes - windows.length + 1, 0)
    document = np.repeat(np.arange(len(sizes)), counts)
    local = np.arange(len(document)) - np.repeat(np.cumsum(counts) - counts, counts)
    value = low[symbols.offsets[document] + local]
    new = np.empty(len(value), bool)
    new[0] = True
    np.not_equal(value[1:], value[:-1], out=new[1:])
    new |= local == 0
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(value)))
    if size.max(initial=0) > windows.span:  # one minimizer again and again: cut the run
        parts = -(-size // windows.span)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, size = np.repeat(first, parts) + nth * windows.span, np.repeat(size, parts) - nth * windows.span
        size = np.minimum(size, windows.span)
    return mixed(value[first]), document[first], local[first], size


def first_places(hashes: np.ndarray, ids: np.ndarray, blocks: np.ndarray):
    """Distinct hashes in ascending order, whether two ids have each, the smallest of them
    and its first block, and the number of each of ``hashes`` in that order."""
    order = np.lexsort((blocks, ids, hashes))
    h, d = hashes[order], ids[order]
    new = np.empty(len(h), bool)
    new[:1] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    start = np.flatnonzero(new)
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    last = np.append(start[1:], len(h)) - 1 if len(h) else start
    return h[start], d[start] != d[last], d[start], blocks[order][start], number


def distinct_contents(hashes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Number of different ``sums`` of each distinct hash, in ascending order of the hashes."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    order = np.lexsort((sums, hashes))
    h, s = hashes[order], sums[order]
    other = np.concatenate(([True], h[1:] != h[:-1]))
    start = np.flatnonzero(other)
    other[1:] |= s[1:] != s[:-1]
    return np.add.reduceat(other.astype(np.int64), start)


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches(max_chunksize=1 << 40)[0]


class Unit:
    """The documents of a unit."""

    def __init__(self, blob: bytes, windows: Windows, id_col: str, text_col: str):
        self.batch = _unpack(blob)
        named = {name: i for i, name in enumerate(self.batch.schema.names)}
        ids = self.batch.column(named[id_col])
        self.ids = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        texts = as_bytes(self.batch.column(named[text_col])).to_pylist()
        self.texts = [t or b"" for t in texts]
        self.symbols = windows.read(self.texts)
        self.hashes, self.document, self.start, self.count = segments(self.symbols, windows)
        self.windows = windows

    def sums(self) -> np.ndarray:
        """For each segment the sum of its gram hashes, which tells contents apart."""
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.symbols.grams)))
        at = self.symbols.offsets[self.document] + self.start
        return total[at + self.count + self.windows.span - 1] - total[at]

    def places(self):
        """As ``first_places``, of the minimizers of all segments."""
        return first_places(self.hashes, self.ids[self.document], self.start // PIECE)

    def contents(self, pieces: Pieces):
        """Distinct contents of ``pieces``: (bytes, route, smallest id, windows, whether two
        documents have it), and for each piece the number of its content."""
        seen: dict[bytes, int] = {}
        content, ids = self.symbols.content, self.ids
        numbers = np.empty(len(pieces.document), np.int64)
        length = self.windows.length - 1
        for i, (d, s, n) in enumerate(zip(pieces.document.tolist(), pieces.start.tolist(), pieces.count.tolist(), strict=True)):
            numbers[i] = seen.setdefault(content(d, s, s + n + length), len(seen))
        owner, last = np.full(len(seen), np.iinfo(np.int64).max), np.full(len(seen), np.iinfo(np.int64).min)
        np.minimum.at(owner, numbers, ids[pieces.document])
        np.maximum.at(last, numbers, ids[pieces.document])
        first = np.zeros(len(seen), np.int64)
        first[numbers[::-1]] = np.arange(len(numbers))[::-1]
        return list(seen), pieces.route[first], owner, pieces.count[first], owner != last, numbers

    def pieces(self, answers: Answers | None) -> Pieces:
        """The pieces of the segments whose minimizer the shards found in two documents, in
        order; those of crowded minimizers window by window."""
        none = np.zeros(0, np.int64)
        if not len(self.hashes) or answers is None:
            return Pieces(none, none, none, none.astype(np.uint64))
        known, _, _, _, number = self.places()
        shards = _shard(known, answers.shards)
        shared, route = np.zeros(len(known), bool), np.zeros(len(known), np.uint64)
        for shard, blob in answers.parts.items():
            at = slice(*np.searchsorted(shards, (shard, shard + 1)))  # shards ascend with the hashes
            answer = zstandard.decompress(blob)
            size = -(-(at.stop - at.start) // 8)
            shared[at] = np.unpackbits(np.frombuffer(answer, np.uint8, size), count=at.stop - at.start)
            route[at][shared[at]] = _wide(np.frombuffer(answer, np.uint8, offset=size)) << np.uint64(16)
        at = np.flatnonzero(shared[number])
        routes = route[number[at]]
        parts = np.where(routes == _OWN, self.count[at], 1)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at, routes = np.repeat(at, parts), np.repeat(routes, parts)
        document, start = self.document[at], self.start[at] + step
        alone = routes == _OWN
        routes[alone] = self._window_hashes(self.symbols.offsets[document[alone]] + start[alone])
        count = np.where(alone, 1, self.count[at])
        if not len(at):
            return Pieces(document, start, count, routes)
        new = np.concatenate(([True], (routes[1:] != routes[:-1]) | (document[1:] != document[:-1]) | (start[1:] != start[:-1] + count[:-1])))
        first = np.flatnonzero(new)
        size = np.add.reduceat(count, first)
        parts = -(-size // PIECE)
        step = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * PIECE
        first, size = np.repeat(first, parts), np.repeat(size, parts)
        return Pieces(document[first], start[first] + step, np.minimum(size - step, PIECE), routes[first])

    def _window_hashes(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows at symbols ``at``, of grams that cover every symbol."""
        span, gram = self.windows.span, self.windows.gram
        out = np.zeros(len(at), np.uint64)
        for k in [*range(0, span - 1, gram), span - 1]:
            out = mixed(out ^ self.symbols.grams[at + k])
        return out


@dataclass
class Pieces:
    """Runs of windows of a unit: where they are and what routes them."""

    document: np.ndarray
    start: np.ndarray
    count: np.ndarray
    route: np.ndarray


@dataclass
class Answers:
    shards: int
    parts: dict


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((hashes >> np.uint64(48)) * np.uint64(shards)) >> np.uint64(16)).astype(np.int64)


def _narrow(values: np.ndarray) -> np.ndarray:
    """The six low bytes of each value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _wide(low: np.ndarray) -> np.ndarray:
    out = np.zeros((len(low) // 6, 8), np.uint8)
    out[:, :6] = low.reshape(-1, 6)
    return out.view("<u8").ravel()


def _answers(packed, shards: int) -> Answers | None:
    return None if packed is None or packed is pd.NA else Answers(shards, {r["shard"]: r["answer"] for r in packed})


def write_units(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The units of ``df`` in the shared folder, and their bytes of text."""
    columns = [F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")]
    columns += [F.col(f"`{c}`").alias(f"x{k}") for k, c in enumerate(df.columns) if c not in (id_col, text_col)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, rows = [], 0, 0

        def unit():
            batch = pa.Table.from_batches(waiting).combine_chunks().to_batches(max_chunksize=1 << 40)[0]
            return pa.RecordBatch.from_pydict({"unit": [uuid.uuid4().hex], "blob": pa.array([_pack(batch)], pa.binary()), "size": [size]})

        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            total = np.cumsum(lengths)
            at = 0
            while at < batch.num_rows:
                base = total[at - 1] if at else 0
                to = max(at + 1, min(int(np.searchsorted(total, base + UNIT_BYTES - size, "right")), at + UNIT_ROWS - rows))
                part = batch.slice(at, to - at)
                waiting.append(part)
                size, rows, at = size + int(total[to - 1] - base), rows + part.num_rows, to
                if size >= UNIT_BYTES or rows >= UNIT_ROWS or at < batch.num_rows:
                    yield unit()
                    waiting, size, rows = [], 0, 0
        if waiting:
            yield unit()

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/units-{uuid.uuid4().hex}"
    df.select(*columns).mapInArrow(pack, "unit string, blob binary, size long").write.option("compression", "none").parquet(path)
    units = spark.read.schema("unit string, blob binary, size long").parquet(path)
    return units, int(units.agg(F.sum("size")).first()[0] or 0)


def _by_shard(frame: DataFrame, shards: int, work, schema: str) -> DataFrame:
    return frame.repartition(shards, "shard").groupBy("shard").applyInPandas(work, schema)


def _gathered(answers: DataFrame) -> DataFrame:
    """The answers for each unit; a unit has at most one for each shard."""
    return answers.groupBy("unit").agg(F.collect_list(F.struct("shard", "answer")).alias("answers"))


def find_repeats(df: DataFrame, windows: Windows, id_col: str, text_col: str, finish: Callable, schema: str) -> DataFrame:
    """Rows of ``finish(unit, covered)`` for every unit of ``df``.

    ``covered`` has, for each document of the unit, the (start, end) symbol spans, ascending
    and disjoint, that repeated windows cover. Null ids count as the smallest id; a null
    text is empty.
    """
    spark = df.sparkSession
    units, size = write_units(df, id_col, text_col)
    shards = max(shuffle_partitions(spark), -(-size // SHARD_BYTES))

    def ship_minimizers(frames):
        for frame in frames:
            for name, blob in zip(frame["unit"], frame["blob"], strict=True):
                unit = Unit(blob, windows, "i", "t")
                known, several, owner, block, _ = unit.places()
                kinds = np.minimum(distinct_contents(unit.hashes, unit.sums()), 0xFFFF).astype("<u2")
                for s, at in _runs(_shard(known, shards)):
                    # an id tells apart the documents of different units
                    places = zstandard.compress(owner[at].tobytes() + block[at].astype("<u4").tobytes(), 1)
                    yield pd.DataFrame({"shard": [s], "unit": [name], "hashes": [_narrow(known[at] & _HASH_MASK).tobytes()], "several": [np.packbits(several[at]).tobytes()], "kinds": [zstandard.compress(kinds[at].tobytes(), 1)], "places": [places]})

    def answer_minimizers(frame):
        values = [_wide(np.frombuffer(b, np.uint8)) for b in frame["hashes"]]
        sizes = [len(v) for v in values]
        several = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(frame["several"], sizes, strict=True)])
        places = [zstandard.decompress(b) for b in frame["places"]]
        ids = np.concatenate([np.frombuffer(b, np.int64, n) for b, n in zip(places, sizes, strict=True)])
        blocks = np.concatenate([np.frombuffer(b, "<u4", n, 8 * n) for b, n in zip(places, sizes, strict=True)])
        kinds = np.concatenate([np.frombuffer(zstandard.decompress(b), "<u2") for b in frame["kinds"]])
        _, differ, owner, block, number = first_places(np.concatenate(values), ids, blocks)
        shared = differ | (np.bincount(number, several, len(differ)) > 0)
        route = np.maximum(mixed(owner.view(np.uint64) ^ mixed(block.astype(np.uint64) + np.uint64(1))) >> np.uint64(16), np.uint64(1))
        route[np.bincount(number, kinds, len(differ)) > windows.crowded] = _OWN
        shared, route = shared[number], route[number]
        stops = np.cumsum(sizes)[:-1]
        found = [zstandard.compress(np.packbits(f).tobytes() + _narrow(r[f]).tobytes(), 1) if f.any() else None for f, r in zip(np.split(shared, stops), np.split(route, stops), strict=True)]
        rows = pd.DataFrame({"unit": frame["unit"], "shard": frame["shard"], "answer": found})
        return rows[rows["answer"].notna()]

    shipped = units.select("unit", "blob").mapInPandas(ship_minimizers, "shard int, unit string, hashes binary, several binary, kinds binary, places binary")
    flags = cut(_by_shard(shipped, shards, answer_minimizers, "unit string, shard int, answer binary"))
    release(spark)

    def ship_pieces(frames):
        for frame in frames:
            for name, blob, packed in zip(frame["unit"], frame["blob"], frame["answers"], strict=True):
                unit = Unit(blob, windows, "i", "t")
                texts, routes, owner, count, several, _ = unit.contents(unit.pieces(_answers(packed, shards)))
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                for s, mine in _by_number(_shard(routes, shards)):
                    head = np.stack((routes[mine].view(np.int64), owner[mine], sizes[mine], count[mine], several[mine]))
                    yield pd.DataFrame({"shard": [s], "unit": [name], "heads": [zstandard.compress(head.tobytes(), 1)], "texts": [zstandard.compress(b"".join([texts[i] for i in mine]), 3)]})

    def answer_pieces(frame):
        return pd.DataFrame({"unit": frame["unit"], "shard": frame["shard"], "answer": _match(frame, windows)})

    flagged = units.join(_gathered(flags).hint("shuffle_hash"), "unit")
    shipped = flagged.select("unit", "blob", "answers").mapInPandas(ship_pieces, "shard int, unit string, heads binary, texts binary")
    masks = cut(_by_shard(shipped, shards, answer_pieces, "unit string, shard int, answer binary"))
    release(spark)

    def mark(frames):
        for frame in frames:
            for blob, packed, found in zip(frame["blob"], frame["answers"], frame["masks"], strict=True):
                unit = Unit(blob, windows, "i", "t")
                yield from finish(unit, _covered(unit, _answers(packed, shards), found, shards))

    both = units.join(_gathered(flags).hint("shuffle_hash"), "unit", "left").join(_gathered(masks).withColumnRenamed("answers", "masks").hint("shuffle_hash"), "unit", "left")
    return both.select("blob", "answers", "masks").mapInPandas(mark, schema)


def _runs(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions) of an ascending array."""
    if len(shard):
        start = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(shard)], strict=True):
            yield int(shard[a]), np.arange(a, b)


def _by_number(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions) of any array, positions in order."""
    order = np.argsort(shard, kind="stable")
    for s, at in _runs(shard[order]):
        yield s, order[at]


def _spread(base: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers base, base + 1, ... of each run of ``count``."""
    return np.repeat(base - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _match(frame: pd.DataFrame, windows: Windows) -> list[bytes]:
    """For each row of ``frame`` the bits of the windows of its pieces: first those that come
    first under a smaller owner than the piece has there, then those under one at most as large."""
    groups: dict[int, dict[bytes, int]] = {}  # by route: pieces and their numbers
    owners: list[int] = []
    counts: list[int] = []
    shared: list[bool] = []
    asked: list[tuple[np.ndarray, np.ndarray]] = []
    for heads, texts in zip(frame["heads"], frame["texts"], strict=True):
        head = np.frombuffer(zstandard.decompress(heads), np.int64).reshape(5, -1)
        text, at, numbers = zstandard.decompress(texts), 0, []
        for route, owner, size, count, several in zip(*head.tolist(), strict=True):
            group = groups.setdefault(route, {})
            content, at = text[at : at + size], at + size
            number = group.setdefault(content, len(owners))
            if number == len(owners):
                owners.append(owner)
                counts.append(count)
                shared.append(bool(several))
            elif owner != owners[number]:
                owners[number], shared[number] = min(owner, owners[number]), True
            numbers.append(number)
        asked.append((np.array(numbers, np.int64), head[1]))
    owner_of, count_of = np.array(owners, np.int64), np.array(counts, np.int64)
    base = np.cumsum(count_of) - count_of
    first = np.full(int(count_of.sum()), np.iinfo(np.int64).max)
    batch: list[bytes] = []
    numbers: list[int] = []
    held = 0

    def settle():
        nonlocal batch, numbers, held
        if batch:
            at = np.array(numbers)
            first[_spread(base[at], count_of[at])] = np.concatenate(windows.first_owners(batch, owner_of[at]))
            batch, numbers, held = [], [], 0

    for group in groups.values():
        if len(group) == 1 and not shared[next(iter(group.values()))]:
            continue  # one piece of one document: nothing else could match it
        size = sum(map(len, group)) + len(group)
        if held and held + size > INDEX_BYTES:
            settle()
        batch += group
        numbers += group.values()
        held += size
    settle()
    out = []
    for mine, owner in asked:
        found, limit = first[_spread(base[mine], count_of[mine])], np.repeat(owner, count_of[mine])
        out.append(zstandard.compress(np.packbits(np.stack((found < limit, found <= limit)), axis=1).tobytes(), 1))
    return out


#: Bytes that one index takes in, unless one route alone has more.
INDEX_BYTES = 1 << 20


def _covered(unit: Unit, answers: Answers | None, found, shards: int) -> list[np.ndarray]:
    """Disjoint symbol spans of each document that repeated windows cover."""
    none = np.zeros((0, 2), np.int64)
    out = [none] * len(unit.texts)
    pieces = unit.pieces(answers)
    if not len(pieces.document) or found is None:
        return out
    texts, routes, owner, count, _, numbers = unit.contents(pieces)
    base = np.cumsum(count) - count
    bits = np.zeros((2, int(count.sum())), bool)
    got = {r["shard"]: r["answer"] for r in found}
    for s, mine in _by_number(_shard(routes, shards)):
        size = int(count[mine].sum())
        both = np.frombuffer(zstandard.decompress(got[s]), np.uint8).reshape(2, -1)
        bits[:, _spread(base[mine], count[mine])] = np.unpackbits(both, axis=1, count=size)
    # the smallest document that has the piece in this unit asks for smaller ones, others for that one too
    later = (unit.ids[pieces.document] != owner[numbers]).astype(np.int64)
    hit = bits[np.repeat(later, pieces.count), _spread(base[numbers], pieces.count)]
    document = np.repeat(pieces.document, pieces.count)[hit]
    start = _spread(pieces.start, pieces.count)[hit]
    if not len(start):
        return out
    length = unit.windows.length
    new = np.concatenate(([True], (document[1:] != document[:-1]) | (start[1:] > start[:-1] + length)))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(start)) - 1
    spans = np.column_stack((start[begin], start[end] + length))
    owner_doc = document[begin]
    for d in np.unique(owner_doc):
        out[d] = spans[np.searchsorted(owner_doc, d) : np.searchsorted(owner_doc, d, "right")]
    return out
