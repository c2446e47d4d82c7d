"""Hard negatives for training: the best wrong document of each claim."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import scan
from plumbline.operators.lexical import LexicalParams, document_frequency, okapi_idf, padded, term_frequency
from plumbline.session import cut
from plumbline.sources.tables import picked

DEPTH, K1, B = 10, 1.5, 0.75


def proxy_texts(claims: DataFrame) -> DataFrame:
    """``search_text``: a claim of another language is searched by the last English claim of its label."""
    english = claims.where("lang = 'en' and pubkey is not null").groupBy("pubkey").agg(F.max_by("text", "query_idx").alias("english"))
    return claims.join(english, "pubkey", "left").withColumn("search_text", F.when(F.col("lang") == "en", F.col("text")).otherwise(F.coalesce("english", "text")))


def hard_negatives(collection: DataFrame, claims: DataFrame) -> DataFrame:
    """``(lang, query_idx, anchor, positive, negative, negative_idx)`` of labelled claims.

    Each distinct (search text, label) is scored once, under a number of its own. Documents
    are ranked by Okapi BM25 to ten places, filled with the first documents; the first that is
    not the label is taken. Articles join only the documents that were picked.
    """
    docs = collection.select("doc_idx", "pubkey", X.article_text(F.col("title"), F.col("abstract")).alias("article"))
    wanted = proxy_texts(claims).join(picked(docs, claims, "pubkey").select("pubkey", F.col("article").alias("positive")), "pubkey")
    keys = cut(wanted.select("search_text", "pubkey").distinct()).withColumn("query_idx", F.monotonically_increasing_id())
    tokenised = docs.select("doc_idx", X.whitespace_terms(F.col("article")).alias("tokens"))
    asked = scan.Asked.of(term_frequency(keys.select("query_idx", X.whitespace_terms(F.col("search_text")).alias("tokens")), "query_idx").withColumnRenamed("tf", "qtf"))
    found = scan.find(tokenised, asked.term)
    terms = okapi_idf(document_frequency(tokenised), F.lit(found.stats[0]))
    held = terms.join(F.broadcast(keys.sparkSession.createDataFrame([(t,) for t in found.terms], "term string")), "term").select("term", "idf").toArrow().to_pandas()
    weights = dict(zip(held["term"], held["idf"], strict=True))
    idf = np.array([weights.get(t, 0.0) for t in found.terms])
    ranked = padded(scan.top(found, asked, LexicalParams(k1=K1, b=B), DEPTH, idf=idf), keys, docs, DEPTH)
    wrong = ranked.join(picked(docs, ranked).select("doc_idx", F.col("pubkey").alias("key")), "doc_idx").join(keys, "query_idx").where(F.col("key") != F.col("pubkey"))
    chosen = wrong.groupBy("search_text", "pubkey").agg(F.min_by("doc_idx", "rank").alias("doc_idx"))
    negatives = chosen.join(picked(docs, chosen).select("doc_idx", F.col("article").alias("negative")), "doc_idx").where("negative <> ''")
    out = wanted.join(negatives.withColumnRenamed("doc_idx", "negative_idx"), ["search_text", "pubkey"])
    return out.select("lang", "query_idx", F.col("text").alias("anchor"), "positive", "negative", "negative_idx")


def missing_positives(collection: DataFrame, claims: DataFrame) -> int:
    """How many labelled claims name a document that the collection does not have."""
    named = claims.where("pubkey is not null and pubkey <> ''")
    return named.join(collection.select("pubkey"), "pubkey", "left_anti").count()
