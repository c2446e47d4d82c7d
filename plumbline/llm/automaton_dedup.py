"""Substring dedup by words: words of passages that an earlier document already has.

Method: suffix automata of reference shards. A reference is the pieces of text that
documents may share (see ``repeats``) in ascending order of their first document; pieces
stream through the automaton of their route for their matching statistics, and maximal runs
of matches of the wanted length whose first owner is an earlier document are removed. Every
word that goes was marked by an automaton. An automaton stays with the task that owns its
shard: their number grows with the corpus, so sending each to every executor would have no
bound.

Defined results: a null text has no words; equal ids are one document; a null id counts as
the smallest; texts of fewer words than a window keep all words; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from plumbline.llm.repeats import CROWDED, Symbols, Unit, Windows, find_repeats, mixed
from plumbline.llm.suffix_automaton import SuffixAutomaton
from plumbline.llm.suffix_index import NOBODY

GRAM = 5
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def read_words(texts: list[bytes], gram: int) -> Symbols:
    """Hashes of all grams of ``gram`` words."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACES[raw]
    before = np.concatenate(([True], space[:-1]))
    first = np.flatnonzero(~space & before)
    stop = np.flatnonzero(space & ~before)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_CODES[raw] * _powers(_BASE, len(raw))[: len(raw)])))
    words = mixed((sums[stop] - sums[first]) * _powers(_INVERSE, len(raw))[first])
    ends = np.cumsum([len(t) + 1 for t in texts])
    offsets = np.concatenate(([0], np.searchsorted(first, ends))).astype(np.int64)
    padded = np.concatenate((words, np.zeros(2 * gram, np.uint64)))
    grams = np.zeros(len(words), np.uint64)
    for k in range(gram):
        grams = mixed(grams ^ padded[k : k + len(words)])
    split: dict[int, list[bytes]] = {}

    def content(document: int, a: int, b: int) -> bytes:
        if document not in split:
            split.clear()  # segments come document by document
            split[document] = texts[document].split()
        return b" ".join(split[document][a:b])

    return Symbols(np.append(grams, np.zeros(gram, np.uint64)), offsets, content)


def first_owners(texts: list[bytes], owners: np.ndarray, depth: int, patterns: list[bytes] | None = None) -> list[np.ndarray]:
    """As ``suffix_index.first_owners``, for word sequences joined by single spaces."""
    known: dict[bytes, int] = {}
    numbered = [[known.setdefault(w, len(known)) for w in t.split(b" ")] for t in texts]
    automaton = SuffixAutomaton()
    for i in np.argsort(owners, kind="stable").tolist():
        automaton.add(numbered[i], int(owners[i]))
    out = []
    for words in numbered if patterns is None else ([known.get(w, -1) for w in p.split(b" ")] for p in patterns):
        found = np.full(max(len(words) - depth + 1, 0), NOBODY)
        for end, first in automaton.stream(words, depth):
            found[end - depth + 1] = first
        out.append(found)
    return out


def windows(length: int, gram: int = GRAM, crowded: int = CROWDED) -> Windows:
    if not 1 <= gram <= length:
        raise ValueError("a gram has at least one word, and at most a window")
    return Windows(length, gram, lambda texts: read_words(texts, gram), lambda texts, owners: first_owners(texts, owners, length), crowded)


def mark_repeated_words(df: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """One row for each row of ``df``: its id, ``n_words``, the removed ``spans`` of words
    and ``kept``, the UTF-8 bytes of the words that stay, joined by single spaces."""

    def finish(unit: Unit, covered: list[np.ndarray]):
        import pandas as pd

        counts, kept = np.diff(unit.symbols.offsets), []
        for text, spans in zip(unit.texts, covered, strict=True):
            words = text.split()
            for a, b in reversed(spans.tolist()):
                del words[a:b]
            kept.append(b" ".join(words))
        yield pd.DataFrame({
            id_col: pd.array(unit.batch.column(0).to_pylist(), dtype="Int64"),
            "n_words": counts,
            "spans": [[{"start": a, "stop": b} for a, b in s.tolist()] for s in covered],
            "kept": kept,
        })

    schema = f"`{id_col}` long, n_words long, spans array<struct<start:long,stop:long>>, kept binary"
    return find_repeats(df.select(id_col, text_col), windows(length, crowded=crowded), id_col, text_col, finish, schema)
