"""Chat formatting in budgeted windows.

The turns of a conversation become windows of at most ``budget`` tokens: prefix sums of the
turn tokens choose where a window ends, always between turns. Later windows begin with the
system turn, the first one of the conversation wherever it stands, and up to ``history`` turns
of the window before; repeated turns are outside the loss mask, so every assistant text is a
target once. A turn counts its tokens and one for its mark.

The budget goes to the next new turn first, then to the system turn, then to history, the
latest turn first. So a new turn that fits, but not beside the system turn, stands without it.
Only a turn that alone exceeds the budget makes a window above it: whole, with no other turn
but the system turn, if that one is within the budget.

Template: a turn is ``### <role>:`` and a line feed, its text, and ``</turn>`` and a line
feed. In texts a backslash becomes two, ``### `` becomes ``#\\## `` and ``</turn>`` becomes
``<\\/turn>``, so the control strings occur only as marks; undoing it drops each backslash
and keeps what follows it.

A conversation is read as a stream sorted by turn. Its windows follow from one another, so one
task streams it, however long, and holds an open window and a batch of turns.

Defined results: null texts and roles are empty; a null conversation id is a conversation;
equal turns are ordered by role, then text; a null turn comes first. No rows give no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import shuffle_partitions

BUDGET, HISTORY = 1024, 2
_HEAD, _TAIL = "### ", "</turn>\n"
_WORD = re.compile("[^\x20\x09-\x0d]+")


def count_tokens(text: str) -> int:
    """Words; any other count may be given instead."""
    return len(_WORD.findall(text))


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("### ", "#\\## ").replace("</turn>", "<\\/turn>")


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:").replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def unescape_role(role: str) -> str:
    return re.sub(r"(?s)\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def _window(conversation, number: int, repeated: list, turns: list) -> dict:
    """A row for turns (role, text, tokens), the ``repeated`` ones first."""
    parts, at, spans = [], 0, []
    for i, (role, text, _) in enumerate([*repeated, *turns]):
        head, body = f"{_HEAD}{escape_role(role)}:\n", escape(text)
        if i >= len(repeated) and role == "assistant":
            spans.append({"start": at + len(head), "stop": at + len(head) + len(body)})
        parts += [head, body, _TAIL]
        at += len(head) + len(body) + len(_TAIL)
    return {"conv": conversation, "window": number, "text": "".join(parts), "n_repeated": len(repeated), "n_tokens": sum(t[2] for t in [*repeated, *turns]), "loss": spans}


class Conversation:
    """The windows of one conversation, whose turns (role, text, tokens) come in order."""

    def __init__(self, conversation, budget: int, history: int):
        self.conversation, self.budget, self.history = conversation, budget, history
        self.number, self.system = 0, None
        self.before: list = []  # turns of the last window that may be repeated
        self.waiting: list = []  # turns in no closed window yet

    def _repeated(self, first: tuple) -> list:
        """What a window that begins with ``first`` repeats: the system turn and the latest turns that fit."""
        room = self.budget - first[2] if first[2] <= self.budget else self.budget
        lead = [self.system] if self.system is not None and self.system[2] <= room else []
        if first[2] > self.budget:
            return lead
        room -= sum(t[2] for t in lead)
        kept: list = []
        for turn in self.before[::-1]:
            if turn[2] > room:
                break
            kept.insert(0, turn)
            room -= turn[2]
        return lead + kept

    def add(self, turns: list) -> Iterator[dict]:
        """The windows that ``turns`` close."""
        self.waiting += turns
        before = np.concatenate(([0], np.cumsum([t[2] for t in self.waiting])))
        at = 0
        while at < len(self.waiting):
            repeated = self._repeated(self.waiting[at])
            room = self.budget - sum(t[2] for t in repeated)
            stop = max(at + 1, int(np.searchsorted(before, before[at] + room, "right")) - 1)
            if stop >= len(self.waiting):
                break
            yield self._close(repeated, self.waiting[at:stop])
            at = stop
        self.waiting = self.waiting[at:]

    def _close(self, repeated: list, turns: list) -> dict:
        row = _window(self.conversation, self.number, repeated, turns)
        if self.system is None:
            self.system = next((t for t in turns if t[0] == "system"), None)
        self.before = [t for t in turns if t is not self.system][-self.history :] if self.history else []
        self.number += 1
        return row

    def end(self) -> dict:
        return self._close(self._repeated(self.waiting[0]), self.waiting)


def _windows(rows: Iterator[list[tuple]], budget: int, history: int, count) -> Iterator[dict]:
    """Windows of batches of rows (conversation, role, text) that come conversation by conversation."""
    open_ = None
    for batch in rows:
        for conversation, turns in groupby(batch, key=lambda r: r[0]):
            if open_ is None or conversation != open_.conversation:
                if open_ is not None:
                    yield open_.end()
                open_ = Conversation(conversation, budget, history)
            yield from open_.add([(role, text, 1 + count(text)) for _, role, text in turns])
    if open_ is not None:
        yield open_.end()


def _frame(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows)
    frame["conv"] = pd.array([r["conv"] for r in rows], dtype="Int64")
    return frame


WINDOW_SCHEMA = "conv long, window long, text string, n_repeated long, n_tokens long, loss array<struct<start:long,stop:long>>"


def format_chats(df: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", count=count_tokens) -> DataFrame:
    """Windows ``(conv, window, text, n_repeated, n_tokens, loss)``; ``loss`` has code point spans."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = ([(None if c is None else int(c), r, t) for c, r, t in zip(frame["conv"].tolist(), frame["role"].tolist(), frame["text"].tolist(), strict=True)] for frame in frames)
        held, size = [], 0
        for row in _windows(batches, budget, history, count):
            held.append(row)
            size += len(row["text"])
            if size > 1 << 22:
                yield _frame(held)
                held, size = [], 0
        if held:
            yield _frame(held)

    turns = df.select(F.col(f"`{conv_col}`").cast("long").cast("string").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((role_col, "role"), (text_col, "text"))))
    return turns.repartition(shuffle_partitions(df.sparkSession), "conv").sortWithinPartitions("conv", "turn", "role", "text").mapInPandas(work, WINDOW_SCHEMA)


_TURN = re.compile(r"(?s)### ((?:\\.|[^:\\])*):\n(.*?)</turn>\n")


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation say: its turns once, and its loss texts.

    ``(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows)``.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, state = [], None

        def closed():
            conv, turns, digest, chars, loss, formatted, n = state
            return {"conv": conv, "n_turns": turns, "turns_sha256": digest.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted, "n_windows": n}

        for frame in frames:
            for conv, text, repeated, spans in zip(frame["conv"].tolist(), frame["text"], frame["n_repeated"].tolist(), frame["loss"], strict=True):
                conv = None if conv is None else int(conv)
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(closed())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for i, m in enumerate(_TURN.finditer(text)):
                    if i >= repeated:
                        state[1] += 1
                        state[2].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                for span in spans:
                    target = unescape(text[span["start"] : span["stop"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
                state[6] += 1
            if len(done) > 10_000:
                yield _frame(done)
                done = []
        if state is not None:
            done.append(closed())
        if done:
            yield _frame(done)

    schema = "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    spread = windows.withColumn("conv", F.col("conv").cast("string")).repartition(shuffle_partitions(windows.sparkSession), "conv").sortWithinPartitions("conv", "window")
    return spread.mapInPandas(work, schema)
