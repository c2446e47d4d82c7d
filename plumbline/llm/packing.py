"""Best-fit packing by linear grouping.

Documents become pieces of at most ``capacity`` tokens. The plan is made from the counts of
the piece lengths alone, so it has the same size for any corpus:

1. lengths above ``small`` are grouped, in descending order, into groups of equal
   cardinality; each counts as the largest length of its group;
2. for these few sizes, configurations (multisets that fill a sequence best) are chosen,
   the largest remaining size first, and used as often as the counts allow;
3. actual lengths take the places of their groups, which leaves some room;
4. small lengths go, the largest first, where they fit best; what is left opens sequences.

A plan is a list of runs of alike sequences. A piece finds its place by its rank among the
pieces of its length; ranks come from counts by (length, hash bucket) and a window inside. A
length has as many buckets as a bucket has pieces, so that both grow with the root of their
number only. Full pieces fill a sequence each and need no rank.

Defined results: a null text is empty and is one piece, the end token; repeated rows are
packed as often as they occur; no rows give no pieces. Texts with a run of 2,000 characters
without white space, or with a special token of the tokenizer, go to the tokenizer itself
and all others to a faster library with the same vocabulary; both give the same ids.
"""

from __future__ import annotations

import base64
import json
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import cut

CAPACITY, END = 1024, 2
GROUPS = 400
#: Longest run without white space that the fast encoder gets.
_LONG_WORD = re.compile(r"\S{2000}")


@lru_cache(maxsize=2)
def encoder(path: str, ranks_path: str | None):
    """A function from a list of texts to lists of ids, as the tokenizer file at ``path`` gives.

    ``ranks_path`` names the same vocabulary as merge ranks for the faster library. It takes
    the texts in which the tokenizer file has no special token and no very long word.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    if ranks_path is None:
        return lambda texts: [slow.encode(t, add_special_tokens=False).ids for t in texts]
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    with open(path, encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file)["added_tokens"]]

    def encode(texts: list[str]) -> list[list[int]]:
        return [slow.encode(t, add_special_tokens=False).ids if any(s in t for s in special) or (len(t) >= 2000 and _LONG_WORD.search(t)) else fast.encode_ordinary(t) for t in texts]

    return encode


def pieces(df: DataFrame, path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: a document's tokens and ``end``, cut so that
    only its first piece is shorter than ``capacity``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks_path)
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.array([*encode([text.as_py() or ""])[0], end], "<u4")
                first = (len(tokens) - 1) % capacity + 1
                for k, (a, b) in enumerate(zip([0, *range(first, len(tokens), capacity)], range(first, len(tokens) + 1, capacity), strict=True)):
                    ids.append(doc)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(tokens[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["id", "piece", "start", "length", "ids_crc32"])

    source = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(work, "id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Places for pieces of each length; made from ``counts[length]``."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None):
        self.capacity = capacity
        small = capacity // 8 if small is None else small
        self.sequences = 0
        #: runs of alike sequences: [first sequence, sequences, lengths]
        self.runs: list[list] = []
        counts = np.array(counts, np.int64)
        if counts[capacity]:
            self._open(int(counts[capacity]), [capacity])
        large = {n: int(counts[n]) for n in range(capacity - 1, small, -1) if counts[n]}
        for sizes, times, members in self._configurations(large, groups):
            self._substitute(times, [members[s] for s in sizes])
        self._fill({n: int(counts[n]) for n in range(small, 0, -1) if counts[n]})

    def _open(self, times: int, lengths: list[int]) -> list:
        run = [self.sequences, times, lengths]
        self.runs.append(run)
        self.sequences += times
        return run

    def _configurations(self, large: dict[int, int], groups: int):
        """(sizes, times, members) of each configuration; members: what a size stands for."""
        total = sum(large.values())
        most = max(1, -(-total // groups))
        left: dict[int, int] = {}
        members: dict[int, list[list[int]]] = {}
        size, room = 0, 0
        for n, c in large.items():
            while c:
                if not room:
                    size, room = n, most
                    members.setdefault(size, [])
                part = min(c, room)
                left[size] = left.get(size, 0) + part
                if members[size] and members[size][-1][0] == n:
                    members[size][-1][1] += part
                else:
                    members[size].append([n, part])
                c, room = c - part, room - part
        while left:
            top = max(left)
            sizes = [top, *self._best(left, top)]
            times = min(left[s] // sizes.count(s) for s in set(sizes))
            for s in sizes:
                left[s] -= times
            left = {s: c for s, c in left.items() if c}
            yield sizes, times, members

    def _best(self, left: dict[int, int], top: int) -> list[int]:
        """Sizes that fill what ``top`` leaves best, the fewest first, within their counts."""
        free = self.capacity - top
        have = dict(left)
        have[top] -= 1
        usable = np.zeros(free + 1, np.int64)
        for s, c in have.items():
            if s <= free and c:
                usable[s] = 1
        if not usable.any():
            return []
        least = int(usable.argmax())
        layers = [np.zeros(free + 1, bool)]
        layers[0][0] = True
        while len(layers) <= free // least and not layers[-1][free]:
            layers.append(np.convolve(layers[-1], usable)[: free + 1] > 0)
        reach = np.array([x.nonzero()[0].max(initial=-1) for x in layers])
        layer = int(reach.argmax())
        at, out = int(reach[layer]), []
        for j in range(layer, 0, -1):
            fits = [s for s in have if have[s] and s <= at and layers[j - 1][at - s]]
            if not fits:
                break
            s = max(fits)
            have[s] -= 1
            out.append(s)
            at -= s
        at = free - sum(out)
        while fits := [s for s in have if have[s] and s <= at]:  # counts stood in the way
            s = max(fits)
            have[s] -= 1
            out.append(s)
            at -= s
        return out

    def _substitute(self, times: int, slots: list[list[list[int]]]) -> None:
        """Take ``times`` actual lengths for each slot; alike sequences form a run."""
        taken = []
        for members in slots:
            parts, want = [], times
            while want:
                n, c = members[0]
                part = min(c, want)
                parts.append((n, part))
                want -= part
                members[0][1] -= part
                if not members[0][1]:
                    members.pop(0)
            taken.append(parts)
        bounds = sorted({int(x) for parts in taken for x in np.cumsum([c for _, c in parts])})
        at = 0
        for bound in bounds:
            lengths = [parts[int(np.searchsorted(np.cumsum([c for _, c in parts]), at, "right"))][0] for parts in taken]
            self._open(bound - at, lengths)
            at = bound

    def _fill(self, small: dict[int, int]) -> None:
        by_room: dict[int, list[list]] = defaultdict(list)
        for run in self.runs:
            by_room[self.capacity - sum(run[2])].append(run)
        for n, c in small.items():
            while c:
                room = min((r for r, runs in by_room.items() if r >= n and runs), default=None)
                if room is None:
                    run = self._open(-(-c // (self.capacity // n)), [])
                    room = self.capacity
                else:
                    run = by_room[room].pop()
                if run[1] > c:
                    rest = [run[0] + c, run[1] - c, list(run[2])]
                    run[1] = c
                    self.runs.append(rest)
                    by_room[room].append(rest)
                run[2].append(n)
                c -= run[1]
                by_room[room - n].append(run)

    def slots(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: first ranks of its slots, their first sequences and offsets."""
        used: dict[int, int] = defaultdict(int)
        out: dict[int, list] = defaultdict(list)
        for first, times, lengths in self.runs:
            at = 0
            for n in lengths:
                out[n].append((used[n], first, at))
                used[n] += times
                at += n
        return {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in out.items()}


def pack(cutted: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    found = cut(cutted)
    counts = np.zeros(capacity + 1, np.int64)
    for r in found.groupBy("length").count().collect():  # at most capacity rows
        counts[r["length"]] = r["count"]
    plan = Plan(counts, capacity, groups)
    slots = plan.slots()
    buckets = F.element_at(F.array(*(F.lit(max(1, math.isqrt(int(c)))) for c in counts[:capacity])), (F.col("length") + 1).cast("int"))
    short = found.where(F.col("length") < capacity).withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), buckets).cast("int"))
    sums = short.groupBy("length", "bucket").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    bases = sums.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("base"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length, rank = frame["length"].to_numpy(), frame["rank"].to_numpy()
            sequence, offset = np.empty(len(frame), np.int64), np.empty(len(frame), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, start, where = slots[int(n)]
                slot = np.searchsorted(first, rank[at], "right") - 1
                sequence[at] = start[slot] + rank[at] - first[slot]
                offset[at] = where[slot]
            yield frame.drop(columns=["rank"]).assign(sequence_id=sequence, offset=offset)

    inside = W.partitionBy("length", "bucket").orderBy("id", "piece", "start", "ids_crc32")
    ranked = short.withColumn("within", F.row_number().over(inside).cast("long")).join(bases, ["length", "bucket"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cutted.schema.fields)
    shorter = ranked.select(*cutted.columns, (F.col("base") + F.col("within") - 1).alias("rank")).mapInPandas(place, f"{kinds}, sequence_id long, offset long")
    # any number that no other sequence has; the rows are those of written files, in their order
    full = found.where(F.col("length") == capacity).select(*cutted.columns, (F.monotonically_increasing_id() + F.lit(plan.sequences)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shorter.unionByName(full)
