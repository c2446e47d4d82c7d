"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time: values at evenly spaced times with
straight lines between them. Integrated over the run, the schedules share out all words: that
gives each source its target. The integral up to a time, scaled to the target, is the source's
cumulative token demand; inverted, it gives the training positions between which a document's
words are due, once in each pass over its source. A document's words are taken as far as its
positions lie within the run, and a range sort by position is the training order. A source
whose target exceeds its size is repeated, in the same document order each time.

Documents of a source come in the order of the MD5 of their id. Prefix sums run over hash
buckets: a source with a third of all rows is spread over 4096 of them, and only one row
per source and bucket is summed across buckets. Targets are solved on one row a source, in
one task.

Defined results: a null text has no words; a null source is a source of its own, ordered
last; documents without words are never taken and have no position; no rows give no rows;
equal ids are ordered by size, and rows equal in both are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, cut

WEIGHTS = (5, 2, 1)
#: For each weight: it falls, or it rises, by half of its mean from the first to the last step.
SCHEDULES = ((1.5, 0.5), (0.5, 1.5), (0.5, 1.5))
LIMIT = 3
#: Hash buckets of a source: 3 hexadecimal digits of the MD5.
BUCKET_DIGITS = 3


def integrated(schedule: tuple[float, ...]) -> list[float]:
    """The integral of a schedule from time 0 to each of its times; the last is at time 1."""
    if len(schedule) < 2 or min(schedule) < 0 or max(schedule) <= 0:
        raise ValueError("a schedule has two values or more, none negative and not all zero")
    out = [0.0]
    for a, b in zip(schedule, schedule[1:], strict=False):
        out.append(out[-1] + (a + b) / 2 / (len(schedule) - 1))
    return out


def moment(share: Column, schedule: tuple[float, ...]) -> Column:
    """The time in [0, 1] at which a share of the schedule's integral is reached: its inverse."""
    done, step = integrated(schedule), 1 / (len(schedule) - 1)
    reached = share * done[-1]
    out = F.lit(0.0)
    for i, (a, b) in enumerate(zip(schedule, schedule[1:], strict=False)):
        # on a straight piece the integral is a x + (b - a) / (2 step) x ** 2
        left = F.greatest(F.lit(0.0), reached - done[i])
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + F.lit(2 * (b - a) / step) * left))
        x = F.least(F.lit(step), F.coalesce(F.try_divide(2 * left, F.lit(a) + root), F.lit(0.0)))
        out = F.when(reached >= done[i], F.lit(i * step) + x).otherwise(out)
    return out


def sizes(df: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """``(id, source, size, hash)`` and ``more``: size counts words."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).alias("hash"),
        *more,
    )


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, schedules: tuple = SCHEDULES) -> DataFrame:
    """``(source, source_size, schedule, target)``, one row a source; ``schedule`` is a number.

    Weights and schedules go to the sources by code point, null last, and repeat. A source's
    claim is its weight times the integral of its schedule. A target stops at ``limit``
    times its source's size and the excess is shared again by claim: all targets are
    min(limit * size, level * claim) for the one level that shares out everything. The
    windows here see one row a source.
    """
    per = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    nth = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    per = per.withColumn("rank", rank).withColumn("schedule", (F.col("rank") % len(schedules)).cast("int"))
    claim = nth([float(w) for w in weights], F.col("rank") % len(weights)) * nth([integrated(s)[-1] for s in schedules], F.col("schedule"))
    per = per.withColumn("weight", claim).withColumn("cap", F.col("source_size") * limit)
    by_fill = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(everything))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    per = per.withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    # sources before the first that fits are at their limit
    per = per.withColumn("level", F.min_by("level", F.when(F.col("fits"), F.col("cap") / F.col("weight"))).over(everything))
    return per.select("source", "source_size", "schedule", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``start``, the words of its source before each document."""
    bucketed = docs.withColumn("bucket", F.substring("hash", 1, BUCKET_DIGITS))
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    base = F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(base, F.lit(0)).alias("base"))
    inside = W.partitionBy("source", "bucket").orderBy("hash", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    ranked = bucketed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = ranked.join(sums, ranked["source"].eqNullSafe(sums["s"]) & (ranked["bucket"] == sums["b"]))
    return joined.withColumn("start", F.col("base") + F.col("within")).drop("s", "b", "base", "within", "bucket")


def scheduled(docs: DataFrame, weights: tuple[int, ...], limit: int, schedules: tuple) -> DataFrame:
    """``docs`` with ``source_size``, ``target``, ``start`` and ``turns``.

    ``turns`` has, for each pass that takes words of the document, the number of the pass,
    the words, and the training positions of the first of them and of what follows the last.
    """
    goals = targets(docs, weights, limit, schedules).withColumnRenamed("source", "g")
    joined = placed(docs)
    joined = joined.join(goals, joined["source"].eqNullSafe(goals["g"])).drop("g")
    demand = F.floor("target")  # what the integrated schedule asks for by the end of the run

    def time(offset: Column) -> Column:
        share = F.coalesce(F.try_divide(offset.cast("double"), F.col("target")), F.lit(0.0))
        out = moment(share, schedules[0])
        for n, schedule in enumerate(schedules[1:], 1):
            out = F.when(F.col("schedule") == n, moment(share, schedule)).otherwise(out)
        return F.least(F.lit(1.0), out)

    def turn(nth: Column) -> Column:
        offset = nth * F.col("source_size") + F.col("start")
        words = F.greatest(F.lit(0), F.least(F.col("size"), demand - offset)).cast("long")
        return F.struct(nth.alias("nth"), words.alias("words"), time(offset).alias("from"), time(offset + words).alias("to"))

    turns = F.filter(F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), turn), lambda t: t["words"] > 0)
    return joined.withColumn("turns", turns).drop("schedule")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, schedules: tuple = SCHEDULES) -> DataFrame:
    """``(id, source, size, hash, source_size, target, start, turns, taken, position)`` for every
    row of ``df``, in training order; what is never taken comes last."""
    docs = cut(sizes(df, id_col, text_col, source_col))
    found = scheduled(docs, weights, limit, schedules)
    found = found.withColumn("taken", F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["words"]))
    found = found.withColumn("position", F.when(F.size("turns") > 0, F.col("turns")[0]["from"]))
    return found.orderBy(F.col("position").asc_nulls_last(), "hash", "id")


def curriculum(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, schedules: tuple = SCHEDULES) -> DataFrame:
    """The rows of ``df`` in training order, repeated as the mix repeats them.

    A pass that takes at least half of a document's words has the document, whole. Columns
    stay as they are, whatever their names; a row appears up to ``limit`` times. Rows are told
    apart by all their columns, and rows equal in all of them each have their passes.
    """
    whole = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)))
    key = F.unhex(F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256)).alias("key")
    docs = cut(sizes(df, id_col, text_col, source_col, key).where("size > 0"))
    rows = scheduled(docs, weights, limit, schedules).select("key", "hash", "size", F.explode("turns").alias("turn"))
    due = rows.where(F.col("turn.words") * 2 >= F.col("size")).select("key", "hash", F.col("turn.nth").alias("nth"), F.col("turn.from").alias("due"))
    texts = df.select(key, whole.alias("row")).dropDuplicates(["key"])
    ordered = texts.join(due, "key").orderBy("due", "hash", "nth", "key")
    return ordered.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)))
