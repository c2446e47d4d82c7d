"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than a thousandth of all rows, and this many at least, is hot.
HOT_SHARE, HOT_ROWS = 1000, 1000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``; only on one machine, where that is unset
    (tests), a temporary folder takes its place.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and not context.master.startswith(("local[", "local")):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="plumbline-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; its lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut_and_release(df: DataFrame) -> DataFrame:
    """``cut``, for the steps of a loop or a long chain: what ``df`` shuffled can go at once."""
    spark = df.sparkSession
    done = cut(df)
    del df
    release(spark)
    return done


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_unique(rows: DataFrame, unique: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined to ``unique``, which has one row for each value of ``key``.

    Rows of a hot key never meet in one task: fewer than ``HOT_SHARE`` keys can have more than
    their share of all rows, so their rows of ``unique`` are broadcast, and the others are
    dealt out by key.
    """
    total = rows.count()
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > max(total // HOT_SHARE, HOT_ROWS)).select(key)
    values = [r[0] for r in hot.collect()]  # fewer than HOT_SHARE
    if not values:
        return rows.join(unique, key, "left")
    is_hot = F.coalesce(F.col(key).isin(values), F.lit(False))
    return rows.where(is_hot).join(F.broadcast(unique.where(is_hot)), key, "left").unionByName(rows.where(~is_hot).join(unique.where(~is_hot), key, "left"))


def row_key(id_col: str, text_col: str) -> Column:
    """A digest of a row's id and text, equal only where both are; a null text counts as empty."""
    id_ = F.col(f"`{id_col}`").cast("string")
    named = F.coalesce(F.concat(F.length(id_).cast("string"), F.lit(":"), id_), F.lit("-"))
    return F.unhex(F.sha2(F.concat(named, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), 256))


def as_bytes(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A string column as binary, without decoding."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_large_string(flat.type) or pa.types.is_large_binary(flat.type):
        return flat.cast(pa.large_binary())
    return flat.cast(pa.binary())
