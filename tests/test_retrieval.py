"""Retrieval operators on small hand-made tables, and every registered query against its SQL."""

import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline import catalog
from plumbline.functions import text as X
from plumbline.functions.stemmer import stem
from plumbline.operators import dense, expansion, fusion, lexical, metrics, mining, rerank
from plumbline.operators.lexical import LexicalIndex, LexicalParams
from plumbline.plans import hybrid
from plumbline.sources import exports, tables
from plumbline.streaming.claims import rank_stream

SF = "/root/testdata/sf0.001"
PLAIN = LexicalParams(k1=2.0, b=0.5, bigrams=False)


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame([(0, "k0", "apple banana apple"), (1, "k1", "banana cherry"), (2, "k2", ""), (3, "k3", None)], "doc_idx long, pubkey string, text string")
    claims = spark.createDataFrame([("en", 0, "Apple apple!", "k0"), ("de", 1, "cherry", "k1"), ("de", 2, "nothing", None)], "lang string, query_idx long, text string, pubkey string")
    return docs, claims, lexical.build_index(docs, F.col("text"), PLAIN)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_bm25_by_hand(spark, small):
    docs, claims, index = small
    rows = {(r.query_idx, r.doc_idx): r.score for r in lexical.bm25_scores(index, lexical.query_terms(claims, PLAIN)).collect()}
    idf = math.log(1 + (4 - 1 + 0.5) / (1 + 0.5))
    want = 2 * idf * 2 * 3 / (2 + 2 * (0.5 + 0.5 * 3 / 1.25))
    assert set(rows) == {(0, 0), (1, 1)} and math.isclose(rows[0, 0], want, rel_tol=1e-12)
    ranked = lexical.padded(lexical.best(lexical.bm25_scores(index, lexical.query_terms(claims, PLAIN)), 3), claims, docs, 3).orderBy("query_idx", "rank").collect()
    assert [(r.query_idx, r.doc_idx, r.rank) for r in ranked] == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 0, 1), (1, 2, 2), (2, 0, 0), (2, 1, 1), (2, 2, 2)]


def test_translator(spark):
    claims = spark.createDataFrame([("en", 0, "Some https://a.b words"), ("de", 1, "Unser @me Apfelbaum, unser #Apfelbaum https://a.b/chartreuse"), ("fr", 2, "@me https://a.b"), ("es", 3, "#fallido"), (None, 4, None)], "lang string, query_idx long, text string")

    def translator(rows):
        return rows.withColumn("translated", F.when(F.col("lang") == "de", F.concat(F.lit("our tree: "), F.lower("text"))))

    asked = LexicalParams(bigrams=False, translator=translator)
    assert {r.query_idx: r.text for r in lexical.translated(claims, asked).collect()} == {
        0: "Some https://a.b words", 1: "our tree: unser apfelbaum, unser apfelbaum apfelbaum", 2: "@me https://a.b", 3: "fallido", 4: None,
    }
    terms = {(r.query_idx, r.term): r.qtf for r in lexical.query_terms(claims, asked).collect()}
    assert terms[1, "tree"] == 1 and terms[1, "apfelbaum"] == 3 and (1, "https") not in terms
    for params in (PLAIN, LexicalParams(bigrams=False, translate=False, translator=translator)):
        terms = {(r.query_idx, r.term): r.qtf for r in lexical.query_terms(claims, params).collect()}
        assert terms[1, "https"] == 1 and (1, "tree") not in terms


def test_index_round_trip_and_stream(spark, small, tmp_path):
    docs, claims, index = small
    index.write(f"{tmp_path}/index")
    again = LexicalIndex.read(spark, f"{tmp_path}/index", PLAIN)
    asked = lexical.query_terms(claims, PLAIN)
    assert lexical.bm25_scores(again, asked).count() == 2
    claims.write.parquet(f"{tmp_path}/claims")
    stream = spark.readStream.schema(claims.schema).parquet(f"{tmp_path}/claims")
    rank_stream(spark, stream, f"{tmp_path}/index", PLAIN, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    assert {(r.query_idx, r.doc_idx) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(0, 0), (1, 1)}


def test_text(spark):
    lit = F.lit
    assert value(spark, X.normalized_claim(lit("See https://a.b/c @me #Topic \U0001f600 now  www.x.org"))) == "See Topic now"
    assert value(spark, X.normalized_claim(lit("@me https://a.b"))) == "@me https://a.b"
    assert value(spark, X.with_bigrams(X.unigrams(lit("One two, x THREE")))) == ["one", "two", "three", "one_two", "two_three"]
    assert value(spark, X.distinctive_terms(lit("Banana banana kiwi oranges 1234567"))) == "banana oranges"
    assert value(spark, X.fielded_text(lit(" t "), lit(None).cast("string"), lit("v"), F.array(lit(" a "), lit(" "), lit("b")))) == "Title: t | Abstract:  | Venue: v | Authors: a, b"
    assert value(spark, X.truncated(lit("abcdef"), 3)) == "abc..."
    assert stem("connections") == stem("connection") and stem("été") == "été"


def test_expansion(spark):
    tokens = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["a", "b"])], "doc_idx long, tokens array<string>")
    graph = expansion.edges(tokens)
    assert {(r.term, r.neighbor): r.cnt for r in graph.collect()} == {("a", "b"): 2, ("b", "a"): 2, ("a", "c"): 1, ("c", "a"): 1, ("b", "c"): 1, ("c", "b"): 1}
    asked = spark.createDataFrame([(0, "a")], "query_idx long, term string")
    one = {r.term: r.weight for r in expansion.diffuse(asked, graph, steps=1).collect()}
    assert one["a"] == 1 and math.isclose(one["b"], 0.65 * 2 / 3, rel_tol=1e-6) and math.isclose(one["c"], 0.65 / 3, rel_tol=1e-6)


def test_dense_and_fusion(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], "doc_idx long, vec array<float>")
    asked = spark.createDataFrame([(0, [3.0, 0.0]), (1, [0.0, 1.0])], "query_idx long, vec array<float>")
    assert [(r.query_idx, r.doc_idx) for r in dense.cosine_top(docs, asked, None).orderBy("query_idx", "rank").collect()] == [(0, 0), (0, 1), (1, 1), (1, 0)]
    make = lambda ids: spark.createDataFrame([(0, d, i, 1.0 - i / 10) for i, d in enumerate(ids)], "query_idx long, doc_idx long, rank long, score double")
    one, two = make([0, 1, 2]), make([2, 1, 0])
    fused = fusion.rrf(fusion.tagged(one, two)).orderBy("rank").collect()
    assert [r.doc_idx for r in fused] == [0, 2, 1]
    rows = fusion.features(fusion.candidates(fusion.tagged(one, make([2]))), one, make([2])).orderBy("pos").collect()
    assert [(r.doc_idx, r.sparse_score, r.sparse_rank) for r in rows] == [(0, 0.0, 1), (1, 0.0, 1), (2, 1.0, 0)]


def test_forest(spark, tmp_path):
    rows = spark.createDataFrame([(q, d, d, 1.0 - d / 20, d, 0.5, d, 1.0 if d == 0 else 0.0) for q in range(10) for d in range(20)], "query_idx long, doc_idx long, pos long, dense_score double, dense_rank long, sparse_score double, sparse_rank long, label double")
    forest = fusion.RandomForestFuser(trees=10)
    with pytest.raises(RuntimeError):
        forest.fuse(rows)
    with pytest.raises(ValueError):
        forest.train(rows.where("label = 0"))
    want = forest.train(rows).fuse(rows, 5).orderBy("query_idx", "rank").collect()
    assert all(r.doc_idx == 0 for r in want if r.rank == 0)
    forest.save(f"{tmp_path}/rf")
    assert fusion.RandomForestFuser().load(f"{tmp_path}/rf").fuse(rows, 5).orderBy("query_idx", "rank").collect() == want


def test_metrics(spark, small):
    docs, claims, index = small
    ranked = lexical.best(lexical.bm25_scores(index, lexical.query_terms(claims, PLAIN)), 5)
    summary = metrics.by_language(metrics.hits(ranked, claims, docs), "final")
    assert {(r.lang, r.metric): r.value for r in summary.collect()} == {("en", "mrr5"): 1.0, ("en", "r5"): 1.0, ("de", "mrr5"): 1.0, ("de", "r5"): 1.0}
    assert {r.lang: (r.total, r.labeled, r.unlabeled) for r in metrics.counts(claims).collect()} == {"en": (1, 1, 0), "de": (2, 1, 1), "*": (3, 2, 1)}
    assert json.loads(exports.metrics_json(summary))["en"]["final"]["mrr5"] == 1.0


def test_sources_and_sinks(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text('Title,Authors,Venue,Abstract\n" A ","x, y",,"line one\nline ""two"""\nB,,V,\n')
    rows = tables.read_papers(spark, str(path)).collect()
    assert [(r.pubkey, r.title, r.venue, r.abstract) for r in rows] == [("11000", "A", "", 'line one\nline "two"'), ("11001", "B", "V", "")]
    with pytest.raises(FileNotFoundError):
        tables.read_papers(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        tables.read_papers(spark, str(tmp_path / "p.txt"))
    with pytest.raises(ValueError):
        tables.checked_split("validation")
    sub = spark.createDataFrame([("en", 42, "['p1', 'p2']"), ("de", 7, "['d1']")], "lang string, index long, preds string")
    paths = exports.write_submission(sub, str(tmp_path / "out"))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["predictions_de.tsv", "predictions_en.tsv"]
    assert open(paths[1], newline="").read() == "index\tpreds\r\n42\t['p1', 'p2']\r\n"
    with pytest.raises(Exception, match="5 keys"):
        spark.createDataFrame([(["a"],)], "k array<string>").select(exports.formatted(F.col("k"))).collect()
    base = spark.createDataFrame([(0, "a", "old"), (1, "b", "b")], "pos long, pubkey string, title string")
    custom = spark.createDataFrame([(0, 7, "new"), (1, 8, "x")], "pos long, pubkey long, title string").withColumn("pubkey", F.when(F.col("pubkey") == 7, "a").otherwise("c"))
    assert [(r.pubkey, r.title) for r in tables.merge_collections(base, custom).orderBy("place").collect()] == [("a", "new"), ("b", "b"), ("c", "x")]
    assert exports.cache_path("r", "m/n", "x", 2.5, 0.85, None, "f") == "r/m--n+x/k1_2.50_b_0.85/topall/f"


def test_mining(spark):
    docs = spark.createDataFrame([(0, "k0", "cats", "purr"), (1, "k1", "cats", "run"), (2, "k2", "dogs", "bark")], "doc_idx long, pubkey string, title string, abstract string")
    claims = spark.createDataFrame([("en", 0, "cats purr", "k0"), ("de", 1, "Katzen", "k0"), ("fr", 2, "rien", "missing")], "lang string, query_idx long, text string, pubkey string")
    got = {r.query_idx: (r.anchor, r.positive, r.negative_idx) for r in mining.hard_negatives(docs, claims).collect()}
    assert set(got) == {0, 1} and got[0][1] == "cats\npurr" and got[0][2] == got[1][2] and got[1][0] == "Katzen"


def test_profiles_and_rerank(spark, small):
    assert hybrid.profile("retrieval-only").fusion == "none" and hybrid.profile("demo", " RRF ").fusion == "rrf"
    for bad in (lambda: hybrid.profile("x"), lambda: hybrid.profile("demo", "x")):
        with pytest.raises(ValueError):
            bad()
    docs, claims, _ = small
    stages = hybrid.run(hybrid.HybridConfig(sparse=PLAIN, dense=False), docs, claims)
    assert [(r.query_idx, r.doc_idx) for r in stages["final"].orderBy("query_idx", "rank").collect()][:1] == [(0, 0)]
    assert math.isclose(value(spark, rerank.yes_probability(F.lit(2.0), F.lit(0.0))), 1 / (1 + math.exp(-2)))


SLOW = {"bm25_expanded_top5", "cooccurrence_edges", "top_neighbors", "diffusion_weights", "pipeline_hybrid", "stemmed_bm25_top5", "rf_fusion", "rf_importance", "fusion_features_rrf"}


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - SLOW))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    df = catalog.queries()[name](spark, SF)
    cursor = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted(repr([r[c] for c in order]) for r in df.collect())
    want = sorted(repr([dict(zip(columns, r, strict=True))[c] for c in order]) for r in cursor.fetchall())
    spark.catalog.clearCache()
    assert got == want


def papers(spark):
    rows = [(0, "p0", "en", "solar wind reaches the outer planets"), (1, "p1", "en", "deep sea coral grows slowly"), (2, "p2", "de", "wind turbines and solar panels"), (3, "p3", "en", "coral and wind"), (4, "p4", "en", "nothing alike")]
    return spark.createDataFrame(rows, "doc_idx long, pubkey string, lang string, text string")


def said(spark):
    return spark.createDataFrame([(0, "en", "solar wind", "p0"), (1, "de", "coral sea", "p1"), (2, "en", "planets", None)], "query_idx long, lang string, text string, pubkey string")


def letters():
    class Letters:
        """An encoder that counts letters."""

        prompt = ""

        def encode(self, texts):
            import numpy as np

            return np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], np.float32)

    return Letters


def longest_first():
    class LongestFirst:
        def rank(self, claim, documents):
            return sorted(((i, float(len(d))) for i, d in enumerate(documents)), key=lambda p: -p[1])

    return LongestFirst


def test_sparse_sets_and_their_errors(spark, tmp_path):
    from plumbline.plans.engine import SparseRetriever

    one = SparseRetriever(PLAIN, cache_root=str(tmp_path))
    with pytest.raises(ValueError):
        one.index_queries(said(spark))
    with pytest.raises(ValueError):
        one.search("wind")
    one.index(papers(spark))
    with pytest.raises(ValueError):
        one.index_queries(said(spark), top_k=0)
    one.index_queries(said(spark), "claims", top_k=3)
    rows = one.ranked("claims").orderBy("query_idx", "rank").collect()
    assert [r["rank"] for r in rows] == [0, 1, 2] * 3 and rows[0].doc_idx == 0  # filled up to three
    assert [r.doc_idx for r in one.search(1, cache_name="claims").orderBy("rank").collect()] == [r.doc_idx for r in rows[3:6]]
    with pytest.raises(TypeError):
        one.search("wind", cache_name="claims")
    with pytest.raises(TypeError):
        one.search(1)
    with pytest.raises(KeyError):
        one.search(1, cache_name="other")
    with pytest.raises(IndexError):
        one.search(3, cache_name="claims")
    with pytest.raises(IndexError):
        one.search(-1, cache_name="claims")
    assert one.search("solar wind", "en").count() == 5

    again = SparseRetriever(PLAIN, cache_root=str(tmp_path))
    again.index(papers(spark))
    kept = list(tmp_path.rglob("_SUCCESS"))
    again.index_queries(said(spark), "claims", top_k=3)
    assert list(tmp_path.rglob("_SUCCESS")) == kept  # read, not made again
    again.index_queries(said(spark).withColumn("text", F.lit("coral")), "claims", top_k=3)
    assert len(list(tmp_path.rglob("_SUCCESS"))) == len(kept) + 1  # other texts, another path


def test_dense_sets_and_their_errors(spark):
    from plumbline.plans.engine import DenseRetriever

    one = DenseRetriever(letters())
    with pytest.raises(ValueError):
        one.index_queries(said(spark))
    one.index(papers(spark))
    with pytest.raises(ValueError):
        one.ranked()
    one.index_queries(said(spark), "claims")
    assert one.search(0, "claims").count() == 5 and one.ranked().count() == 15
    with pytest.raises(KeyError):
        one.ranked("other")
    with pytest.raises(RuntimeError):
        DenseRetriever().index(papers(spark))


def test_engine(spark, tmp_path):
    from plumbline.plans.engine import Component, DenseRetriever, Engine, EngineConfig, SparseRetriever

    config = EngineConfig((Component("letters"), Component("sparse")), fusion_top_k=4, final_top_k=2)
    engine = Engine(config, {"letters": DenseRetriever(letters()), "sparse": SparseRetriever(PLAIN)}, lambda *a: rerank.rerank_listwise(*a, longest_first()))
    with pytest.raises(ValueError):
        engine.search_text("wind")
    engine.index_collection(papers(spark))
    engine.index_claims(said(spark), "claims")
    with pytest.raises(KeyError):
        engine.search_cached(0, "other")
    stages = engine.stages("claims")
    assert set(stages) == {"dense", "sparse", "rrf", "final"} and stages["rrf"].count() == 12
    fused = {r.doc_idx for r in stages["rrf"].where("query_idx = 0").collect()}
    longest = sorted(((len(r.text), r.pubkey) for r in papers(spark).collect() if r.doc_idx in fused), reverse=True)
    assert engine.search_cached(0, "claims")["preds"] == [k for _, k in longest[:2]]
    found = engine.search_text("solar wind", "en")
    assert len(found["preds"]) == 2 and found["stages"]["sparse"].count() == 5

    plain = Engine(config, engine.retrievers)
    plain.index_collection(papers(spark))
    found = plain.search_text("solar wind")
    assert found["stages"]["final"].collect() == found["stages"]["rrf"].collect()

    forest = Engine(EngineConfig(config.retrievers, fusion=" RF ", fusion_top_k=3), engine.retrievers)
    forest.index_collection(papers(spark))
    with pytest.raises(RuntimeError):
        forest.index_claims(said(spark), "claims")
        forest.stages("claims")
    with pytest.raises(ValueError):
        forest.fuser.load_if_present(spark, str(tmp_path), "none") or Engine(EngineConfig((Component("sparse"),), fusion="rf"), {"sparse": engine.retrievers["sparse"]}).prepare_forest(str(tmp_path), said(spark))
    assert forest.prepare_forest(str(tmp_path), said(spark)) is False
    want = forest.stages("claims")["rrf"].orderBy("query_idx", "rank").collect()
    later = Engine(forest.config, engine.retrievers)
    later.index_collection(papers(spark))
    assert later.prepare_forest(str(tmp_path), said(spark)) is True
    later.index_claims(said(spark), "claims")
    assert later.stages("claims")["rrf"].orderBy("query_idx", "rank").collect() == want
    with pytest.raises(ValueError):
        later.fuser.fuse_lists([want], 3)
    with pytest.raises(ValueError):
        fusion.RandomForestFuser().load(next(str(p) for p in tmp_path.iterdir()), "another")


def test_registry():
    from plumbline.plans import registry
    from plumbline.plans.engine import DenseRetriever, SparseRetriever, stage_keys

    assert isinstance(registry.create_retriever("bge-m3", {"adapter": "some/adapter"}), DenseRetriever)
    assert registry.create_retriever("sparse", {"k1": 1.5}).params.k1 == 1.5
    for make in (registry.create_retriever, registry.create_reranker):
        with pytest.raises(ValueError):
            make("no such")
    config = registry.engine_config("demo")
    assert [r.name for r in config.retrievers] == ["harrier-270m", "sparse"] and config.reranker.name == "nemotron" and config.final_top_k == 5
    assert not registry.engine_config("retrieval-only").reranker.enabled
    assert registry.engine_config("evaluation", fusion=" RF").fusion == "rf"
    for bad in (lambda: registry.engine_config("other"), lambda: registry.engine_config("demo", fusion="other"), lambda: registry.build_engine(registry.engine_config("custom", dense_model=None, sparse=None))):
        with pytest.raises(ValueError):
            bad()
    engine = registry.build_engine(registry.engine_config("custom", dense_model="bge-m3", sparse=LexicalParams(k1=2.0), reranker="lexical"))
    assert engine.retrievers["sparse"].params.k1 == 2.0 and engine.reranker is rerank.rerank_lexical
    registry.register_retriever("mine", lambda **p: SparseRetriever(LexicalParams(**p)))
    assert registry.create_retriever("mine", {"b": 0.5}).params.b == 0.5
    assert stage_keys(["sparse_x", "a", "b"]) == ("a", "sparse_x") and stage_keys(["sparse"]) == (None, "sparse")


def test_small_helpers(spark):
    from plumbline.operators import mining
    from plumbline.sources import tables
    from plumbline.timing import StageTimer, get_logger

    assert get_logger("x") is get_logger("x") and len(get_logger("x").handlers) == 1 and StageTimer().elapsed() >= 0
    assert tables.parse_languages(" en, ,de,") == ["en", "de"]
    assert tables.metrics_split(" Dev ") == "dev"
    with pytest.raises(ValueError):
        tables.metrics_split("test")
    more = spark.createDataFrame([("11001", "b", "x, y"), ("11000", "a", "")], "pubkey string, title string, authors string")
    base = spark.createDataFrame([(4, "k", "t", ["z"])], "doc_idx long, pubkey string, title string, authors array<string>")
    assert [(r.doc_idx, r.pubkey, r.authors) for r in tables.append_papers(base, more).orderBy("doc_idx").collect()] == [(4, "k", ["z"]), (5, "11000", []), (6, "11001", ["x", "y"])]
    assert mining.missing_positives(papers(spark), said(spark).withColumn("pubkey", F.when(F.col("query_idx") == 1, "gone").otherwise(F.col("pubkey")))) == 1


def test_containing_against_all_pairs(spark):
    from plumbline.sources.tables import containing

    texts = ["a b c d e f", "xa b c d ey", "a b c", "c", "", None, "a  b c d  e f g", "b c d e f g h\ni j"]
    passages = ["a b c d e", "b c d", "", "c", "  ", "c d e f g h\ni", "zz", "a b c d e f g h", " b c d "]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    want = {(j, i) for i, t in enumerate(texts) if t is not None for j, p in enumerate(passages) if p in t}
    got = [(r.item_id, r.doc_id) for r in containing(items, docs).collect()]
    assert set(got) == want and len(got) == len(want)
