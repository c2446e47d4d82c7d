"""Claims as a stream, ranked against a written index; each micro-batch is a plain batch query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import lexical
from plumbline.operators.lexical import LexicalIndex, LexicalParams


def rank_stream(spark: SparkSession, claims: DataFrame, index_path: str, params: LexicalParams, out_path: str, checkpoint: str, k: int = 5) -> StreamingQuery:
    """Append the k best documents of each arriving claim ``(query_idx, text)`` to ``out_path``."""

    def batch(frame: DataFrame, number: int) -> None:
        index = LexicalIndex.read(frame.sparkSession, index_path, params)
        ranked = lexical.best(lexical.bm25_scores(index, lexical.query_terms(frame, params)), k)
        # a repeated batch replaces its own folder
        ranked.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return claims.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
