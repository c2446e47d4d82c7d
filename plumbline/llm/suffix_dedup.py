"""Suffix-array dedup: bytes of passages that an earlier document already has.

Method: a run-length index. The pieces of text that documents may share (see ``repeats``)
become run-compressed Burrows-Wheeler transforms with sampled run heads and ends; every
piece is streamed through the one of its route for its matching statistics, and windows
whose match is long enough and whose first owner is an earlier document are marked. Every
byte that goes was marked by an index.

Defined results: a null text is empty; equal ids are one document (neither removes from the
other); a null id counts as the smallest; texts shorter than the window keep all bytes; no
rows give no rows. Columns other than the id and the text take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.repeats import BLOCK, CROWDED, Symbols, Unit, Windows, find_repeats, mixed
from plumbline.llm.suffix_index import MAX_SYMBOLS, first_owners

GRAM = 20


def read_bytes(texts: list[bytes], gram: int) -> Symbols:
    """Hashes of all byte grams of ``gram`` bytes (8 or more)."""
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    n = int(offsets[-1])
    raw = np.frombuffer(b"".join(texts) + bytes(gram + 8), np.uint8)
    words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(raw, (n + gram, 8), (1, 1))).view("<u8").ravel()
    grams = np.empty(n, np.uint64)
    for at in range(0, n, BLOCK):
        to = min(at + BLOCK, n)
        part = mixed(words[at:to])
        for k in [*range(8, gram - 8, 8), gram - 8]:
            part = mixed(part ^ words[at + k : to + k])
        grams[at:to] = part
    # grams past the last document only pad the last windows
    return Symbols(np.append(grams, np.zeros(gram, np.uint64)), offsets, lambda d, a, b: texts[d][a:b])


def _first_owners(texts: list[bytes], owners: np.ndarray, depth: int) -> list[np.ndarray]:
    if sum(map(len, texts)) + len(texts) <= MAX_SYMBOLS:
        return first_owners(texts, owners, depth)
    # Pieces of one route that exceed an index: each pair of halves meets in one index.
    third = -(-len(texts) // 3)
    out: list = [None] * len(texts)
    parts = [np.arange(k * third, min((k + 1) * third, len(texts))) for k in range(3)]
    for a, b in ((0, 1), (0, 2), (1, 2)):
        at = np.concatenate((parts[a], parts[b]))
        for i, found in zip(at.tolist(), _first_owners([texts[i] for i in at], owners[at], depth), strict=True):
            out[i] = found if out[i] is None else np.minimum(out[i], found)
    return out


def windows(length: int, gram: int = GRAM, crowded: int = CROWDED) -> Windows:
    if not 8 <= gram < length:
        raise ValueError("grams have at least 8 bytes and fewer than a window")
    return Windows(length, gram, lambda texts: read_bytes(texts, gram), lambda texts, owners: _first_owners(texts, owners, length), crowded)


def cut_spans(text: bytes, spans: np.ndarray) -> bytes:
    at, kept = 0, []
    for a, b in spans.tolist():
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def mark_repeated_bytes(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """One row for each row of ``df``: its id, ``n_bytes``, the removed ``spans`` and ``kept`` bytes."""

    def finish(unit: Unit, covered: list[np.ndarray]):
        import pandas as pd

        yield pd.DataFrame({
            id_col: pd.array(unit.batch.column(0).to_pylist(), dtype="Int64"),
            "n_bytes": [len(t) for t in unit.texts],
            "spans": [[{"start": a, "stop": b} for a, b in s.tolist()] for s in covered],
            "kept": [cut_spans(t, s) for t, s in zip(unit.texts, covered, strict=True)],
        })

    schema = f"`{id_col}` long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"
    return find_repeats(df.select(id_col, text_col), windows(length, crowded=crowded), id_col, text_col, finish, schema)


def remove_repeated_bytes(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the repeated bytes of its texts; all columns stay as they are.

    A character of which a removed passage takes some bytes goes with it. A null text and
    a text that loses nothing stay as they are.
    """
    names = [c for c in df.columns if c not in (id_col, text_col)]
    fields = {f.name: f for f in df.schema.fields}
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("t", T.StringType()), *(T.StructField(f"x{k}", fields[c].dataType) for k, c in enumerate(df.columns) if c in names)])

    def finish(unit: Unit, covered: list[np.ndarray]):
        frame = pa.Table.from_batches([unit.batch]).to_pandas(integer_object_nulls=True)
        for i, spans in enumerate(covered):
            if len(spans):
                frame.iat[i, 1] = cut_spans(unit.texts[i], spans).decode("utf-8", "ignore")
        yield frame

    out = find_repeats(df, windows(length), id_col, text_col, finish, schema)
    back = {"i": id_col, "t": text_col} | {f"x{k}": c for k, c in enumerate(df.columns) if c in names}
    renamed = out.select(*(F.col(k).alias(v) for k, v in back.items()))
    return renamed.select(*(F.col(f"`{c}`") for c in df.columns))
