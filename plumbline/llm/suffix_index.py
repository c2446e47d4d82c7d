"""A run-length index: the run-compressed Burrows-Wheeler transform of a set of texts.

Only run heads and run ends are kept of the suffix array (as in the r-index); matching
statistics of many patterns are streamed at once, one character of each pattern a step.
"""

from __future__ import annotations

import numpy as np

_ROW_BITS = 21
_ROW_MASK = np.uint64((1 << _ROW_BITS) - 1)
#: The most symbols, terminators included, that one index holds.
MAX_SYMBOLS = 1 << _ROW_BITS
#: The owner of a window that an index does not hold.
NOBODY = np.iinfo(np.int64).max


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of texts that are each ended by symbol 0 (at the positions ``ends``).

    Suffixes compare up to their own terminator; equal ones follow the order of the texts.
    Prefix doubling: a group of suffixes with a common prefix is ranked by its first place,
    and each round sorts only the groups that still have several members.
    """
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    width = (64 - _ROW_BITS) // bits
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
    padded = np.concatenate((text, np.zeros(width, text.dtype)))
    keys = np.zeros(n, np.uint64)
    for k in range(width):
        symbol = padded[k : k + n].astype(np.uint64)
        symbol[left < k] = 0
        keys = (keys << np.uint64(bits)) | symbol
    keys = np.sort((keys << np.uint64(_ROW_BITS)) | np.arange(n, dtype=np.uint64))
    order = np.empty(n, np.int64)
    rank = np.empty(n, np.int64)
    slots = np.arange(n)
    while True:
        rows = (keys & _ROW_MASK).astype(np.int64)
        keys >>= np.uint64(_ROW_BITS)
        order[slots] = rows
        new = np.empty(len(rows) + 1, bool)
        new[0] = new[-1] = True
        np.not_equal(keys[1:], keys[:-1], out=new[1:-1])
        # a suffix that has ended is told apart by its row, as are those behind it
        new[:-1] |= left[rows] < width
        heads = np.flatnonzero(new[:-1])
        rank[rows] = np.repeat(slots[heads], np.diff(heads, append=len(rows)))
        open_ = np.flatnonzero(~(new[:-1] & new[1:]))
        if not len(open_):
            return order
        slots, rows = slots[open_], rows[open_]
        beyond = rows + width
        keys = np.sort((rank[rows].astype(np.uint64) << np.uint64(2 * _ROW_BITS)) | (rank[np.minimum(beyond, n - 1)].astype(np.uint64) << np.uint64(_ROW_BITS)) | rows.astype(np.uint64))
        width *= 2


def _ones_before(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words of a bit vector, number of ones before each)."""
    words = np.zeros(-(-len(bits) // 64) * 8, np.uint8)
    packed = np.packbits(bits, bitorder="little")
    words[: len(packed)] = packed
    words = words.view("<u8")
    return words, np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)


class RunLengthIndex:
    """Index over byte strings, each with an owner; equal owners may repeat.

    ``depth`` is the match length of interest: for every group of suffixes that share
    their first ``depth`` symbols the index knows the smallest owner.
    """

    def __init__(self, texts: list[bytes], owners: np.ndarray, depth: int):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        self.ends = np.cumsum(lengths + 1) - 1
        stops = np.zeros(len(raw), bool)
        stops[self.ends] = True
        used = np.flatnonzero(np.bincount(raw[~stops], minlength=256))
        if len(used) > 254:
            raise ValueError("an index holds at most 254 different symbols")
        self.code = np.zeros(256, np.uint8)
        self.code[used] = np.arange(1, len(used) + 1)
        text = self.code[raw]
        text[stops] = 0
        n = len(text)
        order = suffix_order(text, self.ends)
        before = text[order - 1]
        before[order == 0] = 0
        is_head = np.concatenate(([True], before[1:] != before[:-1]))
        heads = np.flatnonzero(is_head)
        tails = np.append(heads[1:], n)
        self.head_bits, self.heads_before = _ones_before(is_head)
        self.run_start, self.run_symbol, self.run_size = heads, before[heads].astype(np.int64), tails - heads
        # rows that precede a run with its own symbol, and rows with smaller symbols
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        sizes = self.run_size[by_symbol]
        self.run_lf = np.empty(len(heads), np.int64)
        self.run_lf[by_symbol] = np.cumsum(sizes) - sizes
        self.head_at, self.tail_at, self.origin = order[heads], order[tails - 1], int(order[0])
        self.runs_of = self.run_symbol[by_symbol] * len(heads) + by_symbol
        self.rows, self.depth = n, depth
        padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
        #: the eight symbols from each position on, as one number
        self.words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (n + depth + 8, 8), (1, 1))).view("<u8").ravel()
        self._group(order, owners, depth)

    def _group(self, order: np.ndarray, owners: np.ndarray, depth: int) -> None:
        """The smallest owner among the rows that share ``depth`` symbols with each row."""
        sizes = np.diff(self.ends, prepend=-1)
        text_of = np.repeat(np.arange(len(self.ends)), sizes)[order]
        long = self.ends[text_of] - order >= depth
        same = np.zeros(len(order), bool)
        near = np.flatnonzero(long[1:] & long[:-1]) + 1
        for k in range(0, depth, 8):
            a, b = self.words[order[near] + k], self.words[order[near - 1] + k]
            differ = a ^ b
            if depth - k < 8:
                differ &= np.uint64((1 << 8 * (depth - k)) - 1)
            near = near[differ == 0]
        same[near] = True
        start = np.flatnonzero(~same)
        owner = np.minimum.reduceat(owners[text_of], start) if len(start) else owners[text_of]
        self.row_owner = np.repeat(owner, np.diff(start, append=len(order)))

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and b, at most ``most``."""
        out = np.zeros(len(a), np.int64)
        alive = np.flatnonzero((most > 0) & (a >= 0) & (b >= 0))
        while len(alive):
            done = out[alive]
            x = self.words[a[alive] + done] ^ self.words[b[alive] + done]
            done += np.where(x, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> np.uint8(3), 8)
            out[alive] = done
            alive = alive[(x == 0) & (done < most[alive])]
        return np.minimum(out, most)

    def stream(self, patterns: list[bytes]):
        """Matching statistics of all patterns, from their last symbol to their first.

        Yields, a step at a time, (numbers of patterns, start positions, match lengths,
        rows): the longest prefix of the pattern from that position that occurs in the
        index, and an index row whose suffix begins with it. Of a match that is longer
        than ``depth``, at least ``depth`` symbols are reported.
        """
        lengths = np.fromiter(map(len, patterns), np.int64, len(patterns))
        by_length = np.argsort(-lengths, kind="stable")
        flat = self.code[np.frombuffer(b"".join(patterns) or b"\0", np.uint8)].astype(np.int64)
        stop = np.cumsum(lengths)[by_length]
        size = lengths[by_length]
        row = np.zeros(len(patterns), np.int64)
        at = np.full(len(patterns), self.origin, np.int64)
        length = np.zeros(len(patterns), np.int64)
        runs = len(self.run_start)
        for step in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-size, -step, "left"))
            symbol = flat[stop[:live] - 1 - step]
            here = row[:live]
            word = here >> 6
            below = (np.uint64(2) << (here & 63).astype(np.uint64)) - np.uint64(1)
            run = self.heads_before[word] + np.bitwise_count(self.head_bits[word] & below) - 1
            offset = here - self.run_start[run]
            off = np.flatnonzero((self.run_symbol[run] != symbol) | (symbol == 0))
            unknown = off
            if len(off):
                key = symbol[off] * runs + run[off]
                slot = np.searchsorted(self.runs_of, key)
                after = self.runs_of[np.minimum(slot, runs - 1)]
                ahead = np.where((slot < runs) & (after // runs == symbol[off]), after % runs, -1)
                earlier = self.runs_of[np.maximum(slot - 1, 0)]
                behind = np.where((slot > 0) & (earlier // runs == symbol[off]), earlier % runs, -1)
                # whether a match reaches the depth is all that counts: what is longer need not be compared
                place, most = at[off], np.minimum(length[off], self.depth)
                down = np.where(ahead >= 0, self.head_at[ahead], -1)
                up = np.where(behind >= 0, self.tail_at[behind], -1)
                common_down, common_up = self._common(place, down, most), self._common(place, up, most)
                go_up = (behind >= 0) & ((common_up > common_down) | (ahead < 0))
                chosen = np.where(go_up, behind, ahead)
                known = (chosen >= 0) & (symbol[off] > 0)
                run[off] = np.where(known, chosen, 0)
                offset[off] = np.where(known & go_up, self.run_size[run[off]] - 1, 0)
                at[off] = np.where(known, np.where(go_up, up, down), -1)
                length[off] = np.where(known, np.where(go_up, common_up, common_down), -1)
                unknown = off[~known]
            row[:live] = self.run_lf[run] + offset
            at[:live] -= 1
            length[:live] += 1
            if len(unknown):
                row[unknown], at[unknown], length[unknown] = 0, self.origin, 0
            yield by_length[:live], size[:live] - 1 - step, length[:live], row[:live]


def first_owners(texts: list[bytes], owners: np.ndarray, depth: int, patterns: list[bytes] | None = None) -> list[np.ndarray]:
    """For each pattern (or text), the smallest owner of a text that has each of its windows.

    A window is ``depth`` symbols; one that the index does not hold has ``NOBODY``.
    """
    patterns = texts if patterns is None else patterns
    index = RunLengthIndex(texts, owners, depth)
    counts = np.maximum(np.fromiter(map(len, patterns), np.int64, len(patterns)) - depth + 1, 0)
    base = np.cumsum(counts) - counts
    out = np.full(int(counts.sum()), NOBODY)
    for which, start, length, row in index.stream(patterns):
        far = np.flatnonzero(length >= depth)
        if len(far):
            out[base[which[far]] + start[far]] = index.row_owner[row[far]]
    return np.split(out, base[1:]) if len(patterns) else []
