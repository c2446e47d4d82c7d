"""The registered queries of the training-data operators, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import ann, automaton_dedup, chat, knn_join, mixing, packing, quality, simhash, suffix_dedup, url_filter

RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_adaptive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn_join.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, radius=2)
    # hex() of a negative long has its 16 digits
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


def op5_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.mark_repeated_bytes(_table(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    windows = chat.format_chats(turns.unionByName(extra))
    return chat.read_back(windows).select(F.col("conv").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows")


def op7_url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    judged = url_filter.judge_urls(pages, RULES, url_filter.html_aliases(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents")).select("doc_id", F.round("posterior", 6).alias("posterior"), F.round("score", 6).alias("score"), "good")


def op9_grouped_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    cutted = packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ranks)
    return packing.pack(cutted).withColumnRenamed("id", "doc_id")


def op10_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = automaton_dedup.mark_repeated_words(_table(spark, sf_dir, "documents"), length=13)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_adaptive_ann, op2_voronoi_knn, op3_simhash, op4_curriculum_mix, op5_run_length_dedup, op6_chat_windows, op7_url_redirects, op8_weak_quality, op9_grouped_packing, op10_automaton_dedup)}


_OP2_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as vec
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""

_OP4_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5(coalesce(cast(doc_id as varchar), '')) as hash
  from documents
), p as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (
  select *, [5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as bigint)] as weight, 3 * source_size as cap,
    sum(source_size) over () as total from p
), l as (
  select *, cast(total - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as double)
    / cast(sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as double) as level from w
), t as (
  select source, source_size, weight = 5 as falls, least(cast(cap as double), (select min_by(level, cap / weight) from l where level * weight <= cap) * weight) as target from l
), o as (
  select d.doc_id, d.size, t.source_size, t.target, t.falls, cast(floor(t.target) as bigint) as whole,
    coalesce(sum(d.size) over (partition by d.source order by d.hash, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as start
  from d join t on d.source is not distinct from t.source
)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(case when source_size > 0 then whole // source_size * size + greatest(0, least(size, whole % source_size - start)) else 0 end as bigint) as taken,
  case when size > 0 and start < whole then round(least(1.0, case when falls then 2 * (start / target) / (1.5 + sqrt(2.25 - 2 * (start / target))) else 2 * (start / target) / (0.5 + sqrt(0.25 + 2 * (start / target))) end), 9) end as position
from o
"""

_OP7_SQL = r"""
with u as (
  select page_id,
    case when contains(url, '://') then translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when contains(url, '://') then regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) else '' end as path
  from pages
), r as (
  select page_id, host, path, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
  from u
)
select page_id, host, path, rule, case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict from r
"""


def oracle_sql() -> dict[str, str]:
    """The SQL of op7 has no aliases to follow, as the pages link to none."""
    return {"op2_voronoi_knn": _OP2_SQL, "op4_curriculum_mix": _OP4_SQL, "op7_url_redirects": _OP7_SQL}
