"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation
estimates, from the counts of the vote patterns of all documents, how often each labeller
is right where it votes. Posterior labels of a bounded sample
(``SAMPLE`` documents of the smallest hash, a documented parameter) train a linear scorer
on hashed features, which scores every document.

The driver sees the pattern counts (at most 3 ** labellers rows) and the sample's features.

Defined results: a null or empty text gets no votes and scores by the model's features for
it; equal texts score alike; no rows give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import as_bytes, cut, row_key

SAMPLE = 8192
#: Words among which distinct ones are counted.
RUN = 1000
WIDTH = 1 << 11
GOOD, BAD, NONE = 0, 1, 2
_SHAPE = bytes(ord("X") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else ord("x") if 97 <= b <= 122 or b >= 128 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
_SYMBOLS = b"#$%&*+<=>@^_`{|}~\\"


def distinct_share(words: list[bytes]) -> float:
    """Distinct words over words, as the mean over runs of ``RUN`` words: it does not fall with length."""
    runs = [words[i : i + RUN] for i in range(0, len(words), RUN)]
    return sum(len(set(r)) for r in runs) / max(1, len(words))


def measures(text: bytes) -> dict[str, float]:
    """Shares and rates that the labellers and the features use."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    shape = text.translate(_SHAPE)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return {
        "words": float(len(words)),
        "symbols": (size - len(text.translate(None, _SYMBOLS))) / size if text else 0.0,
        "capitals": shape.count(b"X") / size,
        "bars": text.count(b"|") / n,
        "shouts": text.count(b"!") / n,
        "distinct": distinct_share(words),
        "stops": (text.count(b".") + text.count(b"?")) / n,
        "line_repeats": 1 - len(set(lines)) / max(1, len(lines)),
        "word_bytes": size / n,
        "digits": shape.count(b"0") / size,
    }


#: Labellers that vote bad where a measure is at least, or (negative) at most, so much.
BAD_SIGNS = (("symbols", 0.02), ("capitals", 0.3), ("bars", 0.1), ("shouts", 0.3), ("distinct", -0.42), ("stops", -0.005), ("line_repeats", 0.3), ("word_bytes", 9.0))
#: Labellers that vote good where every measure is inside its range.
GOOD_SIGNS = (
    {"symbols": (0, 0.01), "bars": (0, 0.01), "shouts": (0, 0.05), "capitals": (0, 0.15), "distinct": (0.48, 1), "line_repeats": (0, 0.15)},
    {"symbols": (0, 0.005), "bars": (0, 0.01), "shouts": (0, 0.05), "capitals": (0, 0.1), "distinct": (0.5, 1), "stops": (0.02, 0.3)},
    {"symbols": (0, 0.01), "bars": (0, 0.01), "shouts": (0, 0.1), "capitals": (0, 0.2), "distinct": (0.45, 1), "word_bytes": (3, 8)},
)
LABELLERS = len(BAD_SIGNS) + len(GOOD_SIGNS)
_LEAST_WORDS = 1


def votes(m: dict[str, float]) -> list[int]:
    if m["words"] < _LEAST_WORDS:
        return [NONE] * LABELLERS
    bad = [BAD if (m[name] >= x if x > 0 else m[name] <= -x) else NONE for name, x in BAD_SIGNS]
    return bad + [GOOD if all(a <= m[name] <= b for name, (a, b) in ranges.items()) else NONE for ranges in GOOD_SIGNS]


def features(text: bytes, m: dict[str, float], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: binned measures, and the shares of the shapes of words."""
    weight: Counter = Counter()
    for name, value in m.items():
        step = np.log2(1 + value) if name in ("words", "word_bytes") else value * 20
        weight[zlib.crc32(f"{name}:{int(min(step, 40))}".encode()) % width] += 1.0
    shapes = Counter(_RUNS.sub(rb"\1", text.translate(_SHAPE)).split())
    total = max(1, sum(shapes.values()))
    for shape, count in shapes.items():
        weight[zlib.crc32(b"shape:" + shape) % width] += 4 * count / total
    at = np.fromiter(weight.keys(), np.uint16, len(weight))
    return at, np.fromiter(weight.values(), np.float32, len(weight))


@dataclass(frozen=True)
class LabelModel:
    """Prior of the good class, and how often each labeller is right where it votes."""

    prior: float
    accuracy: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that documents of these votes are good."""
        weight = np.log(self.accuracy) - np.log1p(-self.accuracy)
        score = np.log(self.prior) - np.log1p(-self.prior) + (patterns == GOOD) @ weight - (patterns == BAD) @ weight
        return 1 / (1 + np.exp(-np.clip(score, -500, 500)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, strength: float = 20.0) -> LabelModel:
    """EM over distinct vote patterns.

    Whether a labeller votes says nothing of the class, only how it votes does. The classes
    are held equal beforehand: most documents are good, and a learned prior would outvote
    signs that only one labeller sees. All labellers start at an accuracy of 0.9, where
    ``strength`` pseudo-votes hold them.
    """
    model = LabelModel(0.5, np.full(patterns.shape[1], 0.9))
    for _ in range(rounds):
        good = model.posterior(patterns)
        right = (good * counts) @ (patterns == GOOD) + ((1 - good) * counts) @ (patterns == BAD)
        cast = counts @ (patterns != NONE)
        accuracy = np.clip((right + 0.9 * strength) / (cast + strength), 0.5, 0.999)
        settled = np.abs(accuracy - model.accuracy).max(initial=0) < 1e-9
        model = LabelModel(0.5, accuracy)
        if settled:
            break
    return model


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, width: int = WIDTH, rounds: int = 400, ridge: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer of soft labels; both classes weigh alike."""
    x = np.zeros((len(rows), width + 1), np.float32)
    x[:, width] = 1
    for i, (at, value) in enumerate(rows):
        x[i, at] = value
    balance = np.where(good > 0.5, 0.5 / max(good.mean(), 1e-3), 0.5 / max(1 - good.mean(), 1e-3)).astype(np.float32) if len(good) else good
    balance = np.minimum(balance, 50)
    weights, mean, square = (np.zeros(width + 1, np.float32) for _ in range(3))
    for t in range(1, rounds + 1 if len(rows) else 1):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ ((p - good).astype(np.float32) * balance) / len(rows) + ridge * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        weights = weights - 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-6)
    return weights


def annotate(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, key, pattern, at, value)``: votes as a number in base 3, and packed features."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pattern, at, value = [], [], []
            for item in as_bytes(batch.column(2)):
                text = item.as_py() or b""
                m = measures(text)
                pattern.append(sum(v * 3**j for j, v in enumerate(votes(m))))
                a, b = features(text, m)
                at.append(a.tobytes())
                value.append(b.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pattern, pa.int64()), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["id", "key", "pattern", "at", "value"])

    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(f"`{id_col}`").alias("id"), row_key(id_col, text_col).alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(work, f"id {kind}, key binary, pattern long, at binary, value binary")


def _votes_of(pattern: np.ndarray) -> np.ndarray:
    return np.stack([pattern // 3**j % 3 for j in range(LABELLERS)], axis=1)


def _features_of(at: bytes, value: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(at, np.uint16), np.frombuffer(value, np.float16).astype(np.float32)


def _smallest_hashes(noted: DataFrame, total: int, sample: int) -> list:
    """The ``sample`` rows of the smallest hashes of the id. Only about four times as many
    are sorted, so that tasks together send the driver no more as the corpus grows."""
    ordered = lambda rows: rows.orderBy(F.xxhash64("id"), "pattern", "at", "value").limit(sample).select("pattern", "at", "value").collect()
    below = -(1 << 63) + int(min(1.0, 4 * sample / max(total, 1)) * ((1 << 64) - 1))
    near = ordered(noted.where(F.xxhash64("id") <= F.lit(min(below, (1 << 63) - 1))))
    return near if len(near) >= min(sample, total) else ordered(noted)


def score_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``(id_col, posterior, score, good)`` for each row of ``df``."""
    return _scored(df, id_col, text_col, sample).drop("key").withColumnRenamed("id", id_col)


def _scored(df: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE) -> DataFrame:
    """As ``score_quality``, with the id in ``id`` and the row's digest in ``key``."""
    noted = cut(annotate(df, id_col, text_col))
    found = noted.groupBy("pattern").count().collect()  # at most 3 ** labellers rows
    patterns = _votes_of(np.array([r["pattern"] for r in found], np.int64))
    model = fit_labels(patterns, np.array([r["count"] for r in found], float))
    chosen = _smallest_hashes(noted, sum(r["count"] for r in found), sample)
    labels = model.posterior(_votes_of(np.array([r["pattern"] for r in chosen], np.int64)))
    weights = fit_scorer([_features_of(r["at"], r["value"]) for r in chosen], labels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pattern = batch.column(2).to_numpy()
            pairs = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            margin = np.array([float(weights[a] @ v + weights[-1]) for a, v in (_features_of(*p) for p in pairs)], float)
            score = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            posterior = model.posterior(_votes_of(pattern)) if len(pattern) else score
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(posterior), pa.array(score), pa.array(score >= 0.5)], ["id", "key", "posterior", "score", "good"])

    kind = df.schema[id_col].dataType.simpleString()
    return noted.mapInArrow(work, f"id {kind}, key binary, posterior double, score double, good boolean")


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows that are rejected, told apart by id and text; its columns stay."""
    rejected = _scored(df, id_col, text_col).where("not good").select(F.col("key").alias("_key")).distinct()
    return df.withColumn("_key", row_key(id_col, text_col)).join(rejected, "_key", "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))
