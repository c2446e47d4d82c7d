"""The pipeline as an object: a collection indexed once, named sets of claims, ad-hoc texts.

A retriever ranks whole sets of claims in one plan; looking up one claim is a filter on the
stored ranking of its set.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import dense, fusion, lexical
from plumbline.operators.lexical import LexicalParams
from plumbline.plans.hybrid import sparse_ranking
from plumbline.session import shared_folder
from plumbline.sources import exports

ADHOC = "collection_idx long, query_idx long, lang string, text string, pubkey string"


class Retriever(Protocol):
    """Ranks documents ``(doc_idx, text, ...)`` for named sets of claims ``(query_idx, lang, text)``."""

    def index(self, collection: DataFrame) -> None: ...

    def index_queries(self, claims: DataFrame, cache_name: str = "queries", top_k: int | None = None, force: bool = False) -> None: ...

    def ranked(self, cache_name: str) -> DataFrame:
        """``(query_idx, doc_idx, score, rank)`` of a set."""
        ...


def _stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = f"{shared_folder(spark)}/set-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def fingerprint(df: DataFrame, order: str) -> str:
    """Digest of the texts of ``df`` and their order."""
    rows = exports.text_fingerprints(df.withColumn("whole", F.lit(1)), "whole", order, "text").collect()
    return rows[0]["fingerprint"] if rows else "empty"


class SparseRetriever:
    """BM25 with expansion, over an index that is written once.

    With ``cache_root`` the rankings of a set are kept under a path that names the parameters,
    the collection and the claims, and are read again where it exists.
    """

    def __init__(self, params: LexicalParams | None = None, cache_root: str | None = None):
        self.params, self.cache_root = params or LexicalParams(), cache_root
        self.built: lexical.LexicalIndex | None = None
        self.digest = ""
        self._sets: dict[str, DataFrame] = {}

    def index(self, collection: DataFrame) -> None:
        spark = collection.sparkSession
        self.built = lexical.build_index(collection, F.col("text"), self.params).write(f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
        self.digest = fingerprint(collection, "doc_idx") if self.cache_root else ""
        self._sets = {}

    def _index(self) -> lexical.LexicalIndex:
        if self.built is None:
            raise ValueError("no collection is indexed")
        return self.built

    def index_queries(self, claims: DataFrame, cache_name: str = "queries", top_k: int | None = lexical.DEPTH, force: bool = False) -> None:
        index = self._index()
        if top_k is not None and top_k <= 0:
            raise ValueError(f"top_k must be above 0, not {top_k}")
        spark = claims.sparkSession
        build = lambda: sparse_ranking(index, claims, top_k)
        if self.cache_root is None:
            self._sets[cache_name] = _stored(spark, build())
            return
        settings = exports.config_fingerprint(self.params, self.digest, fingerprint(claims, "query_idx"), claims.agg(F.sum(F.xxhash64("query_idx", "lang").cast("decimal(38,0)"))).first()[0])
        path = exports.cache_path(self.cache_root, "sparse", None, self.params.k1, self.params.b, top_k, settings)
        self._sets[cache_name] = exports.cached(spark, path, build, force)

    def ranked(self, cache_name: str) -> DataFrame:
        if cache_name not in self._sets:
            raise KeyError(f"no set of claims is named {cache_name!r}")
        return self._sets[cache_name]

    def search(self, query: str | int, lang: str = "auto", cache_name: str | None = None) -> DataFrame:
        """``(doc_idx, score, rank)`` of a text, or of the claim of that number in a set."""
        if cache_name is None:
            if not isinstance(query, str):
                raise TypeError("without a set of claims the query is a text")
            claims = self._index().docs.sparkSession.createDataFrame([(0, lang, query)], "query_idx long, lang string, text string")
            return sparse_ranking(self._index(), claims, None).select("doc_idx", "score", "rank")
        if isinstance(query, bool) or not isinstance(query, int):
            raise TypeError("in a set of claims the query is a number")
        rows = self.ranked(cache_name).where(F.col("query_idx") == query)
        if query < 0 or rows.isEmpty():
            raise IndexError(f"no claim {query} in {cache_name!r}")
        return rows.select("doc_idx", "score", "rank")


class DenseRetriever:
    """Exact cosine search over vectors that are given, or made by an encoder in the workers.

    ``make_encoder`` makes a ``dense.Encoder``; ``vectors (doc_idx, vec)`` take its place for the
    collection, and claims may bring their own ``vec``.
    """

    def __init__(self, make_encoder: Callable[[], dense.Encoder] | None = None, vectors: DataFrame | None = None, name: str = "dense"):
        self.make_encoder, self.given, self.name = make_encoder, vectors, name
        self.vectors: DataFrame | None = None
        self._sets: dict[str, tuple[DataFrame, int | None]] = {}
        self.last: str | None = None

    def _encoded(self, df: DataFrame, key: str) -> DataFrame:
        if "vec" in df.columns:
            return df.select(key, "vec")
        if self.make_encoder is None:
            raise RuntimeError(f"{self.name} has neither vectors nor an encoder")
        return dense.encode_texts(df, key, "text", self.make_encoder)

    def index(self, collection: DataFrame) -> None:
        vectors = self.given if self.given is not None else self._encoded(collection, "doc_idx")
        self.vectors = _stored(collection.sparkSession, vectors.select("doc_idx", "vec"))

    def index_queries(self, claims: DataFrame, cache_name: str = "queries", top_k: int | None = None, force: bool = False) -> None:
        if self.vectors is None:
            raise ValueError("no collection is indexed")
        self._sets[cache_name] = (_stored(claims.sparkSession, self._encoded(claims, "query_idx")), top_k)
        self.last = cache_name

    def ranked(self, cache_name: str | None = None) -> DataFrame:
        if cache_name is None:
            if self.last is None:
                raise ValueError("no set of claims is indexed")
            cache_name = self.last
        if cache_name not in self._sets:
            raise KeyError(f"no set of claims is named {cache_name!r}")
        queries, top_k = self._sets[cache_name]
        return dense.cosine_top(self.vectors, queries, top_k)

    def search(self, query: int, cache_name: str | None = None) -> DataFrame:
        if not isinstance(query, int):
            raise TypeError("the query is a number in a set of claims")
        return self.ranked(cache_name).where(F.col("query_idx") == query).select("doc_idx", "score", "rank")


@dataclass(frozen=True)
class Component:
    name: str | None
    enabled: bool = True
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class EngineConfig:
    """What an engine is built of, by registered names."""

    retrievers: tuple[Component, ...]
    reranker: Component = Component(None, False)
    use_fusion: bool = True
    fusion: str = "rrf"
    fusion_top_k: int = 30
    sparse_depth: int = lexical.DEPTH
    final_top_k: int = 5

    def __post_init__(self):
        name = self.fusion.strip().lower()
        if name not in ("rrf", "rf"):
            raise ValueError(f"unknown fusion {self.fusion!r}; known: rrf, rf")
        object.__setattr__(self, "fusion", name)

    def enabled_retrievers(self) -> list[Component]:
        return [r for r in self.retrievers if r.enabled]


def stage_keys(names) -> tuple[str | None, str | None]:
    """The first name that does not begin with ``sparse``, and the first that does."""
    names = list(names)
    return next((n for n in names if not n.startswith("sparse")), None), next((n for n in names if n.startswith("sparse")), None)


class Engine:
    """Retrievers, a fuser and a reranker over one collection."""

    def __init__(self, config: EngineConfig, retrievers: dict[str, Retriever], reranker: Callable | None = None, fuser: fusion.Fuser | None = None):
        if not retrievers:
            raise ValueError("no retriever is enabled")
        self.config, self.retrievers, self.reranker = config, retrievers, reranker
        self.fuser = fuser or (fusion.RandomForestFuser() if config.fusion == "rf" else fusion.RRFFuser())
        self.collection: DataFrame | None = None
        self._claims: dict[str, DataFrame] = {}

    def index_collection(self, collection: DataFrame) -> None:
        self.collection = collection
        for retriever in self.retrievers.values():
            retriever.index(collection)

    def index_claims(self, claims: DataFrame, name: str, force: bool = False) -> None:
        """Rank the claims ``(query_idx, lang, text)`` as the set ``name``."""
        if self.collection is None:
            raise ValueError("no collection is indexed")
        for key, retriever in self.retrievers.items():
            retriever.index_queries(claims, cache_name=name, top_k=self.config.sparse_depth if key.startswith("sparse") else None, force=force)
        self._claims[name] = claims

    def stages(self, name: str) -> dict[str, DataFrame]:
        """Ranked lists ``(query_idx, doc_idx, score, rank)`` of every stage, for a whole set."""
        if name not in self._claims:
            raise KeyError(f"no set of claims is named {name!r}")
        lists = {key: r.ranked(name) for key, r in self.retrievers.items()}
        dense_key, sparse_key = stage_keys(lists)
        found = {stage: lists[key] for stage, key in (("dense", dense_key), ("sparse", sparse_key)) if key is not None}
        if not self.config.use_fusion or len(lists) < 2:
            fused = next(iter(lists.values())).where(F.col("rank") < self.config.fusion_top_k)
        elif self.config.fusion == "rf":
            if dense_key is None or sparse_key is None:
                raise ValueError("fusion by a forest needs a dense and a sparse retriever")
            fused = self.fuser.fuse_lists([lists[dense_key], lists[sparse_key]], self.config.fusion_top_k)
        else:
            fused = self.fuser.fuse_lists(list(lists.values()), self.config.fusion_top_k)
        found["rrf"] = fused
        found["final"] = fused if self.reranker is None else self.reranker(fused, self._claims[name], self.collection.select("doc_idx", "text"))
        return found

    def search_cached(self, query: int, name: str) -> dict:
        """``preds``: the keys of the best documents of one claim; ``stages``: its lists with keys."""
        keys = self.collection.select("doc_idx", "pubkey")
        lists = {stage: ranked.where(F.col("query_idx") == query).join(keys, "doc_idx").select("rank", "pubkey") for stage, ranked in self.stages(name).items()}
        best = lists["final"].where(F.col("rank") < self.config.final_top_k).orderBy("rank").collect()  # a handful
        return {"preds": [r["pubkey"] for r in best], "stages": lists}

    def search_text(self, text: str, lang: str = "en") -> dict:
        """A text that is in no set, through all stages."""
        if self.collection is None:
            raise ValueError("no collection is indexed")
        name = f"{lang}-{uuid.uuid4().hex}"
        self.index_claims(self.collection.sparkSession.createDataFrame([(0, lang, text)], "query_idx long, lang string, text string"), name)
        return self.search_cached(0, name)

    def prepare_forest(self, root: str, claims: DataFrame, force: bool = False) -> bool:
        """Load the forest that fits these settings from ``root``, or train and save it; whether it was loaded.

        ``claims`` are labelled with ``pubkey``.
        """
        if self.config.fusion != "rf":
            return False
        dense_key, sparse_key = stage_keys(self.retrievers)
        if dense_key is None or sparse_key is None:
            raise ValueError("fusion by a forest needs a dense and a sparse retriever")
        sparse = self.retrievers[sparse_key]
        mark = self.fuser.fingerprint(dense_key, getattr(sparse, "params", None), "train")
        path = f"{root}/rf_{mark}"
        spark = claims.sparkSession
        if not force and self.fuser.load_if_present(spark, path, mark):
            return True
        name = f"train-{uuid.uuid4().hex}"
        self.index_claims(claims, name)
        lists = [self.retrievers[k].ranked(name) for k in (dense_key, sparse_key)]
        rows = fusion.features(fusion.candidates(fusion.tagged(*lists), self.fuser.candidate_top_k), *lists)
        wanted = claims.where("pubkey is not null and pubkey <> ''").select("query_idx", F.col("pubkey").alias("wanted"))
        labelled = rows.join(wanted, "query_idx").join(self.collection.select("doc_idx", "pubkey"), "doc_idx", "left")
        self.fuser.train(_stored(spark, labelled.withColumn("label", F.col("pubkey").eqNullSafe(F.col("wanted")).cast("double"))))
        self.fuser.save(path, mark)
        return False
