"""Suffix stripping in the manner of Paice and Husk: rules tried by ending, longest match first.

Stems are computed on the distinct words of a batch, and a worker keeps those it met.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values: (ending, replacement, goes on). A rule applies if the stem that is left is
# acceptable: a vowel and two letters if it begins with one, else three letters with a vowel or y.
RULES = (
    ("ational", "ate", True), ("isation", "ise", True), ("ization", "ize", True), ("fulness", "ful", True), ("ousness", "ous", True), ("iveness", "ive", True),
    ("ically", "ic", True), ("ingly", "", True), ("ation", "at", True), ("ments", "", True), ("ities", "", True), ("ables", "", True), ("ibles", "", True),
    ("ment", "", True), ("ness", "", True), ("able", "", True), ("ible", "", True), ("ance", "", True), ("ence", "", True), ("tion", "t", True), ("sion", "s", True),
    ("ings", "", True), ("edly", "", True), ("ally", "al", True), ("ism", "", True), ("ist", "", True), ("ity", "", True), ("ive", "", True), ("ize", "", True), ("ise", "", True),
    ("ful", "", True), ("ous", "", True), ("ing", "", True), ("ies", "y", True), ("ied", "y", True), ("ant", "", True), ("ent", "", True), ("ate", "", True),
    ("ed", "", True), ("er", "", True), ("or", "", True), ("al", "", True), ("ic", "", True), ("ly", "", True), ("es", "", True), ("ss", "ss", False), ("s", "", True), ("e", "", False), ("y", "i", False),
)
_VOWELS = frozenset("aeiou")
_BY_LENGTH = sorted({len(r[0]) for r in RULES}, reverse=True)
_LOOKUP = {r[0]: r for r in RULES}


def _acceptable(stem: str) -> bool:
    if stem[:1] in _VOWELS:
        return len(stem) >= 2
    return len(stem) >= 3 and any(c in _VOWELS or c == "y" for c in stem)


def stem(word: str) -> str:
    """The stem of a lower-cased word; words that are not plain a-z stay."""
    if not (word.isascii() and word.isalpha()):
        return word
    while True:
        for n in _BY_LENGTH:
            rule = _LOOKUP.get(word[-n:]) if n <= len(word) else None
            if rule is None:
                continue
            ending, put, goes_on = rule
            left = word[: len(word) - n] + put
            if left == word:
                return word
            if _acceptable(left):
                if not goes_on:
                    return left
                word = left
                break
        else:
            return word


@lru_cache(1 << 18)
def _stem(word: str) -> str:
    return stem(word)


@F.arrow_udf(ArrayType(StringType()))
def stem_lists(words: pa.Array) -> pa.Array:
    """Lists of words as lists of stems."""
    flat = words.flatten().cast(pa.string()).dictionary_encode()
    stemmed = pa.array([_stem(w) for w in flat.dictionary.to_pylist()], pa.string()).take(flat.indices)
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(words), 0).cast(pa.int32()))
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), stemmed)


@F.pandas_udf(StringType())
def stem_column(words: pd.Series) -> pd.Series:
    return words.map(stem)


def stems(words: DataFrame, column: str = "term") -> DataFrame:
    """``(column, stem)`` for the distinct values of ``column``."""
    return words.select(column).where(F.col(column).isNotNull()).distinct().select(column, stem_column(column).alias("stem"))
