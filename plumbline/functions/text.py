"""Text projections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits at anything but letters, digits and the underscore, in all scripts.
NON_WORD = r"[^\p{L}\p{N}_]+"
#: White space as Unicode text handling knows it, written out for engines without the flag.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: The code point ranges that claim normalisation blanks, wide and narrow.
SYMBOLS = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{24C2}-\x{1F251}]+"
SYMBOLS_NARROW = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]+"
DENSE_CHARACTERS = 2048


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def authors_text(authors: Column) -> Column:
    """Trimmed non-blank names, joined by commas."""
    return F.array_join(F.filter(F.transform(authors, lambda a: F.trim(a)), lambda a: a != ""), ", ")


def fielded_text(title: Column, abstract: Column, venue: Column, authors: Column | None = None) -> Column:
    """A document as labelled fields; venue and authors only where they say something."""
    out = F.concat(F.lit("Title: "), F.trim(text_or_empty(title)), F.lit(" | Abstract: "), F.trim(text_or_empty(abstract)))
    parts = [("Venue", F.trim(text_or_empty(venue)))]
    if authors is not None:
        parts.append(("Authors", F.coalesce(authors_text(authors), F.lit(""))))
    for name, value in parts:
        out = F.concat(out, F.when(value != "", F.concat(F.lit(f" | {name}: "), value)).otherwise(""))
    return out


def boosted_text(title: Column, abstract: Column, venue: Column) -> Column:
    """Title three times, venue twice, abstract once: field weights by repetition."""
    t, v, a = text_or_empty(title), text_or_empty(venue), text_or_empty(abstract)
    return F.trim(F.concat_ws(" ", t, t, t, v, v, a))


def article_text(title: Column, abstract: Column) -> Column:
    return F.concat(title, F.lit("\n"), abstract)


def dense_text(text: Column, characters: int = DENSE_CHARACTERS) -> Column:
    """What an encoder reads of a text."""
    return F.substring(text, 1, characters)


def unigrams(text: Column, stop_words: list[str] = ()) -> Column:
    """Lower-cased words of two characters or more that are no stop words."""
    words = F.filter(F.split(F.lower(text_or_empty(text)), NON_WORD), lambda t: F.char_length(t) > 1)
    return F.filter(words, lambda t: ~t.isin(*stop_words)) if stop_words else words


def with_bigrams(words: Column) -> Column:
    """All unigrams, then the pairs of neighbours."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit("_"), b))
    return F.when(F.size(words) >= 2, F.concat(words, pairs)).otherwise(words)


def whitespace_terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text_or_empty(text)), SPACE), lambda t: t != "")


def stripped_claim(text: Column, narrow: bool = False) -> Column:
    """A claim without URLs, mentions, emoji and hash signs."""
    out = F.regexp_replace(text, r"https?://[^\s]+|www\.[^\s]+", "")
    out = F.regexp_replace(out, r"@[\p{L}\p{N}_]+", "")
    out = F.regexp_replace(out, SYMBOLS_NARROW if narrow else SYMBOLS, " ")
    return F.trim(F.regexp_replace(F.replace(out, F.lit("#"), F.lit(" ")), SPACE, " "))


def normalized_claim(text: Column, narrow: bool = False) -> Column:
    """``stripped_claim``, or the claim itself if nothing is left."""
    out = stripped_claim(text, narrow)
    return F.when(out == "", text).otherwise(out)


def distinctive_terms(text: Column, stop_words: list[str] = (), least: int = 6) -> Column:
    """Distinct long alphabetic words in order, joined by spaces."""
    words = F.filter(F.split(F.lower(text_or_empty(text)), NON_WORD), lambda t: (F.char_length(t) >= least) & t.rlike(r"^\p{L}+$"))
    if stop_words:
        words = F.filter(words, lambda t: ~t.isin(*stop_words))
    return F.array_join(F.array_distinct(words), " ")


def truncated(text: Column, limit: int = 100) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def html_escaped(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def default_stop_words(spark) -> list[str]:
    """English, German and French stop words."""
    from pyspark.ml.feature import StopWordsRemover

    del spark  # the lists come from the session's JVM
    return sorted({w.lower() for lang in ("english", "german", "french") for w in StopWordsRemover.loadDefaultStopWords(lang)})
