"""MRR, recall and nDCG by language and as a macro mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGE_METRICS = {"dense": (5, 10, 30, 50), "sparse": (5, 10, 30, 50), "rrf": (30,), "final": (5,)}


def labelled(claims: DataFrame) -> DataFrame:
    return claims.where("pubkey is not null and pubkey <> ''")


def hits(ranked: DataFrame, claims: DataFrame, docs: DataFrame) -> DataFrame:
    """First 0-based position of the labelled document for each labelled claim, or null."""
    right = ranked.join(docs.select("doc_idx", F.col("pubkey").alias("found")), "doc_idx").select("query_idx", "rank", "found")
    joined = labelled(claims).join(right, "query_idx", "left")
    return joined.groupBy("lang", "query_idx").agg(F.min(F.when(F.col("found") == F.col("pubkey"), F.col("rank"))).alias("at"))


def by_language(first: DataFrame, stage: str, recalls: tuple[int, ...] | None = None) -> DataFrame:
    """``(lang, stage, metric, value)``; a claim without the document counts as 0."""
    depths = STAGE_METRICS[stage] if recalls is None else recalls
    values = {"mrr5": F.coalesce(F.when(F.col("at") < 5, F.lit(1.0) / (F.col("at") + 1)), F.lit(0.0))}
    values |= {f"r{k}": F.coalesce((F.col("at") < k).cast("double"), F.lit(0.0)) for k in depths}
    sums = first.groupBy("lang").agg(*(F.avg(v).alias(n) for n, v in values.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in values))
    return sums.select("lang", F.lit(stage).alias("stage"), F.explode(pairs).alias("m")).select("lang", "stage", "m.metric", "m.value")


def macro(summary: DataFrame) -> DataFrame:
    """The unweighted mean over languages."""
    return summary.groupBy("stage", "metric").agg(F.avg("value").alias("value"))


def counts(claims: DataFrame) -> DataFrame:
    """Claims with and without a label, by language and (``*``) over all."""
    has = F.coalesce((F.col("pubkey") != ""), F.lit(False))
    rolled = claims.rollup("lang").agg(F.grouping("lang").alias("all"), F.count("*").alias("total"), F.count_if(has).alias("labeled"))
    return rolled.select(F.when(F.col("all") == 1, "*").otherwise(F.col("lang")).alias("lang"), "total", "labeled", (F.col("total") - F.col("labeled")).alias("unlabeled"))


def ndcg(first: DataFrame, k: int = 10) -> DataFrame:
    """nDCG of one relevant document, by language."""
    gain = F.when(F.col("at") < k, F.lit(1.0) / F.log2(F.col("at").cast("double") + 2)).otherwise(F.lit(0.0))
    return first.groupBy("lang").agg(F.avg(gain).alias("ndcg"))
