"""Readers for collections, claims, papers, triplets and the tables derived from them."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLLECTION = T.StructType([T.StructField("doc_idx", T.LongType()), T.StructField("pubkey", T.StringType()), T.StructField("title", T.StringType()), T.StructField("abstract", T.StringType()), T.StructField("venue", T.StringType()), T.StructField("authors", T.ArrayType(T.StringType()))])
CLAIMS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("split", T.StringType()), T.StructField("query_idx", T.LongType()), T.StructField("index", T.LongType()), T.StructField("text", T.StringType()), T.StructField("pubkey", T.StringType())])
TRIPLETS = T.StructType([T.StructField(c, T.StringType()) for c in ("anchor", "positive", "negative")])
SPLITS = ("train", "dev", "test")
CUSTOM_START = 11_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COLLECTION).parquet(path)


def read_claims(spark: SparkSession, path: str, lang: str | None = None, split: str | None = None) -> DataFrame:
    """Claims, pruned to a language and split where the folder is partitioned by them."""
    out = spark.read.schema(CLAIMS).parquet(path)
    if split is not None:
        out = out.where(F.col("split") == checked_split(split))
    return out if lang is None else out.where(F.col("lang") == lang)


def checked_split(split: str) -> str:
    name = split.strip().lower()
    if name not in SPLITS:
        raise ValueError(f"unknown split {split!r}; known: {', '.join(SPLITS)}")
    return name


def read_papers(spark: SparkSession, path: str, start_id: int = CUSTOM_START) -> DataFrame:
    """Papers of a CSV file with the columns Title, Authors, Venue and Abstract.

    Keys count up from ``start_id`` in file order: a multi-line file is one partition.
    """
    if PurePosixPath(path).suffix.lower() != ".csv":
        raise ValueError(f"not a CSV file: {path}")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(path)
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    field = lambda name: F.trim(F.coalesce(F.col(name), F.lit("")))
    return rows.select((F.monotonically_increasing_id() + start_id).cast("string").alias("pubkey"), field("Title").alias("title"), field("Abstract").alias("abstract"), field("Venue").alias("venue"), field("Authors").alias("authors"))


def append_papers(collection: DataFrame, papers: DataFrame) -> DataFrame:
    """``collection`` followed by ``papers``, whatever keys they have; numbering goes on after the last."""
    last = collection.agg(F.coalesce(F.max("doc_idx"), F.lit(-1)).alias("last"))
    order = W.orderBy(F.col("pubkey").cast("long"), "pubkey")
    names = F.filter(F.transform(F.split("authors", ","), lambda a: F.trim(a)), lambda a: a != "")
    fields = {"authors": names} if dict(papers.dtypes).get("authors") == "string" else {}
    numbered = papers.withColumns(fields).withColumn("nth", F.row_number().over(order)).join(F.broadcast(last)).withColumn("doc_idx", F.col("last") + F.col("nth"))
    return collection.unionByName(numbered.drop("nth", "last"), allowMissingColumns=True)


def parse_languages(value: str) -> list[str]:
    """The names of a comma-separated list, trimmed; blanks are dropped."""
    return [name for part in value.split(",") if (name := part.strip())]


def metrics_split(split: str) -> str:
    """A split that has labels to measure by: any but the test split."""
    name = checked_split(split)
    if name == "test":
        raise ValueError("the test split has no labels, so there are no metrics of it")
    return name


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRIPLETS).json(path)


def as_collection(documents: DataFrame) -> DataFrame:
    """A document table as a collection: the first line is the title, the source the venue."""
    text = F.coalesce("text", F.lit(""))
    at = F.instr(text, "\n")
    title = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    abstract = F.when(at > 0, F.substring(text, at + 1, F.char_length(text))).otherwise("")
    return documents.select(F.col("doc_id").alias("doc_idx"), F.col("doc_id").cast("string").alias("pubkey"), title.alias("title"), abstract.alias("abstract"), F.col("source").alias("venue"), "lang", "text")


def as_claims(benchmark: DataFrame, documents: DataFrame) -> DataFrame:
    """Benchmark passages as claims: the label is the first document that has the passage."""
    labels = containing(benchmark, documents).groupBy("item_id").agg(F.min(F.struct("doc_id", "lang")).alias("hit"))
    joined = benchmark.join(labels, "item_id", "left")
    return joined.select(F.coalesce("hit.lang", F.lit("auto")).alias("lang"), F.col("item_id").alias("query_idx"), "text", F.col("hit.doc_id").cast("string").alias("pubkey"))


def containing(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """``(item_id, doc_id, lang)``: the documents whose text has the text of a passage.

    A passage's parts between spaces, but for the first and last, are parts of any text that
    has it. So passages of five parts or more meet only documents with the same three
    inner parts, and then the texts decide, in the task that reads them: the texts are not
    shuffled. Shorter passages are compared with every text.
    """
    parts = F.split("text", " ")
    three = lambda p, i: F.xxhash64(p[i], p[i + 1], p[i + 2])
    items = passages.select("item_id", F.col("text").alias("passage"), parts.alias("parts"))
    long = items.where(F.size("parts") >= 5).select("item_id", "passage", three(F.col("parts"), 1).alias("gram")).collect()
    texts = documents.select("doc_id", "lang", "text")
    met = texts.withColumn("parts", parts).where(F.size("parts") >= 5)
    met = met.select("doc_id", "lang", "text", F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("parts") - 3), lambda i: three(F.col("parts"), i))).alias("grams"))
    met = met.mapInArrow(_having([(r["gram"], r["item_id"], r["passage"]) for r in long]), documents.select(F.lit(0).cast("long").alias("item_id"), "doc_id", "lang").schema)
    short = items.where(F.size("parts") < 5).select("item_id", "passage")
    few = texts.join(F.broadcast(short), F.contains("text", F.col("passage")))
    return met.unionByName(few.select("item_id", "doc_id", "lang"))


def _having(passages: list[tuple[int, int, str]]):
    """Rows of a batch ``(doc_id, lang, text, grams)`` that have one of ``passages (gram, item_id, text)``."""
    named: dict[int, list[tuple[int, str]]] = {}
    for gram, item, text in passages:
        named.setdefault(gram, []).append((item, text))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.array(list(named), pa.int64())
        for batch in batches:
            ids, langs, texts, grams = batch.columns
            values = grams.flatten()
            hit = np.flatnonzero(pc.is_in(values, held).to_numpy(zero_copy_only=False))
            row = np.searchsorted(np.cumsum(pc.list_value_length(grams).to_numpy(zero_copy_only=False)), hit, side="right")
            items, rows, last, text = [], [], -1, ""
            for r, gram in zip(row.tolist(), values.take(pa.array(hit)).to_pylist(), strict=True):
                if r != last:
                    last, text = r, texts[r].as_py()
                found = [item for item, passage in named[gram] if passage in text]
                items += found
                rows += [r] * len(found)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), ids.take(at), langs.take(at)], ["item_id", "doc_id", "lang"])

    return work


def picked(rows: DataFrame, some: DataFrame, key: str = "doc_idx") -> DataFrame:
    """Those of ``rows`` whose key ``some`` names; ``some`` is a short list, so ``rows`` stay where they are."""
    return rows.join(F.broadcast(some.select(key).distinct()), key, "left_semi")


def merge_collections(base: DataFrame, custom: DataFrame) -> DataFrame:
    """``base`` with rows of ``custom`` put in by key: known keys keep their place, new ones follow.

    Both have ``pos`` (their order), ``pubkey`` and the same further columns.
    """
    names = [c for c in base.columns if c != "pos"]
    both = base.select(F.lit(0).alias("src"), "pos", *names).unionByName(custom.select(F.lit(1).alias("src"), "pos", *names)).withColumn("pubkey", F.col("pubkey").cast("string"))
    newest = F.max_by(F.struct(*names), F.struct("src", "pos")).alias("row")
    return both.groupBy("pubkey").agg(newest, F.min(F.struct("src", "pos")).alias("place")).select("place", "row.*")
