"""Cases that the operators' docstrings promise: long texts, clashing names, hot keys, ties, odd inputs."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ann, chat, common, mixing, packing, quality, queries, simhash, url_filter
from plumbline.llm.common import cut, join_unique
from tests.llm.test_operators import documents, edge_documents, exact_print, table


def test_join_unique_splits_hot_keys(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 97 > 0, F.col("id") % 3000).alias("k"), "id")
    unique = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).where("k <> 11")
    want = rows.join(unique, "k", "left")
    got = join_unique(rows, unique, "k")
    assert "UNION" in got._jdf.queryExecution().toString().upper()
    assert Counter(map(tuple, got.select("k", "id", "v").collect())) == Counter(map(tuple, want.select("k", "id", "v").collect()))


def test_checkpoint_dir_is_needed_off_one_machine():
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    with pytest.raises(ValueError, match="checkpoint"):
        common.ensure_checkpoint_dir(type("Session", (), {"sparkContext": Context()})())


@pytest.mark.parametrize("schedule", [(1.5, 0.5), (0.5, 1.5), (1.0, 1.0), (0.0, 2.0, 0.0), (2.0, 0.0, 1.0, 1.0)])
def test_moment_inverts_the_integral(spark, schedule):
    """The time found for a share gives that share back, by numeric integration of the schedule."""
    shares = [i / 40 for i in range(41)]
    rows = spark.createDataFrame([(s,) for s in shares], "share double").select(mixing.moment(F.col("share"), schedule).alias("t")).collect()
    grid = np.linspace(0, 1, 200_001)
    rate = np.interp(grid, np.linspace(0, 1, len(schedule)), schedule)
    area = np.concatenate(([0], np.cumsum((rate[1:] + rate[:-1]) / 2 * np.diff(grid))))
    assert math.isclose(area[-1], mixing.integrated(schedule)[-1], rel_tol=1e-9)
    assert np.allclose([np.interp(r.t, grid, area) / area[-1] for r in rows], shares, atol=1e-6)


def test_mix_takes_words_by_position(spark):
    """Turns tile the source's demand in order, and nothing is due after the run ends."""
    for df in (table(spark, "documents"), edge_documents(spark)):
        rows = mixing.mix(df).collect()
        placed = [r.position for r in rows]
        known = [p for p in placed if p is not None]
        assert known == sorted(known) and placed[len(known) :] == [None] * (len(rows) - len(known))
        by = defaultdict(list)
        for r in rows:
            assert r.taken == sum(t.words for t in r.turns) and (r.position is None) == (r.taken == 0)
            by[r.source] += [(t["from"], t["to"], t.words, r.target) for t in r.turns]
        for turns in by.values():
            turns.sort()
            assert all(a[1] <= b[0] + 1e-12 for a, b in zip(turns, turns[1:], strict=False))
            assert 0 <= turns[0][0] and turns[-1][1] <= 1
            assert sum(t[2] for t in turns) == math.floor(turns[0][3])


def test_curriculum_names_and_repeated_rows(spark):
    plain = edge_documents(spark)
    odd = plain
    for name in ("nth", "_due", "due", "_hash", "hash", "key", "row", "id", "size", "turn", "start", "bucket"):
        odd = odd.withColumn(name, F.lit(1))
    out = mixing.curriculum(odd)
    assert out.columns == odd.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((r.doc_id, r.text) for r in mixing.curriculum(plain).collect())

    same = documents(spark, [(1, "one text of five words", "a"), (1, "another text of one id", "a"), (1, "one text of five words", "a"), (None, "no id but five words", "a"), (None, "no id and five more", "a")])
    got = Counter((r.doc_id, r.text) for r in mixing.curriculum(same).collect())
    assert set(got) == {(r.doc_id, r.text) for r in same.collect()}
    assert got[(1, "one text of five words")] == 2 and sum(got.values()) == 5
    assert [r.text for r in mixing.curriculum(same).collect()] == [r.text for r in mixing.curriculum(same.repartition(3)).collect()]


def brute_windows(turns, budget):
    """Every turn once, in order, and the texts of the loss."""
    said = "".join(f"{r}\n{x}\n" for r, x in turns)
    loss = "".join(x for r, x in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_windows_stay_within_their_budget(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(60):
        for turn in range(rng.choice((1, 2, 7, 40))):
            role = rng.choice(("system", "user", "assistant")) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn, role, " ".join(["w"] * rng.choice((0, 1, 3, 10, 30, 49, 50, 80)))))
    rows += [(100, 0, "system", "s " * 600), (100, 1, "user", "u " * 500), (100, 2, "assistant", "a " * 900), (100, 3, "user", "v " * 300)]
    rows += [(101, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(20_000)]  # one long conversation
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = defaultdict(list)
    for c, _, r, x in rows:
        by[c].append((r, x))
    for budget in (50, 1024):
        windows = chat.format_chats(df, budget=budget).collect()
        for w in windows:
            own = [m for i, m in enumerate(chat._TURN.finditer(w.text)) if i >= w.n_repeated]
            assert w.n_tokens <= budget or (len(own) == 1 and w.n_repeated <= 1 and chat.count_tokens(own[0][2]) >= budget)
        systems = {c: next((i for i, (r, _) in enumerate(t) if r == "system"), None) for c, t in by.items()}
        seen = Counter()
        for w in sorted(windows, key=lambda w: (w.conv, w.window)):
            turns = [(chat.unescape_role(m[1]), chat.unescape(m[2])) for m in chat._TURN.finditer(w.text)]
            at = systems[w.conv]
            if at is not None and seen[w.conv] > at:  # a later window: led by the system turn if it fits
                lead, first = by[w.conv][at], turns[w.n_repeated]
                long, new = chat.count_tokens(lead[1]) + 1, chat.count_tokens(first[1]) + 1
                fits = long + new <= budget or (new > budget and long <= budget)
                assert (w.n_repeated > 0 and turns[0] == lead) == fits
            seen[w.conv] += len(turns) - w.n_repeated
        got = {r.conv: r for r in chat.read_back(spark.createDataFrame(windows, chat.WINDOW_SCHEMA)).collect()}
        for c, turns in by.items():
            assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == brute_windows(turns, budget)


def test_links_of_pages(spark):
    html = [
        (1, "http://a.org/x/y", "<link href='/z' rel=canonical>"),
        (2, "http://b.org/", "<link rel='stylesheet' href='http://no.org/'><LINK REL='nofollow Canonical' HREF=\"//c.org/?a=1&amp;b=2\"><link rel=canonical href='http://second.org/'>"),
        (3, "http://d.org/p/", "<base href='http://e.org/q/'><meta http-equiv=Refresh content='0; URL=\"r\"'>"),
        (4, "http://f.org/", "<script>'<link rel=canonical href=http://no.org/>'</script><!-- <link rel=canonical href='http://no.org/'> --><link rel=canonical href='http://[bad'>"),
        (5, "http://g.org/", None), (6, None, "<link rel=canonical href='http://h.org/'>"), (7, "http://i.org/", "<link rel=canonical href=''><link rel=canonical>"), (8, "http://j.org/", "<link rel=canonical href='mailto:x'><![bad"),
    ]
    pages = spark.createDataFrame(html, "page_id long, url string, html string")
    assert {tuple(r) for r in url_filter.html_aliases(pages).collect()} == {
        ("http://a.org/x/y", "http://a.org/z"), ("http://b.org/", "http://c.org/?a=1&b=2"), ("http://b.org/", "http://second.org/"), ("http://d.org/p/", "http://e.org/q/r"),
    }


def test_aliases_of_any_case_share_a_block(spark):
    html = [(1, "HTTP://A.org/x", "<link rel=canonical href='/y'>"), (2, "http://a.org/y", "<link rel=canonical href='http://X.net/fr/b'>"), (2, "http://a.org/y", None), (3, "http://a.ORG/x#top", ""), (4, "http://other.org/" + "long" * 20_000, "")]
    pages = spark.createDataFrame(html, "page_id long, url string, html string")
    judged = url_filter.judge_urls(pages, queries.RULES, url_filter.html_aliases(pages)).collect()
    assert Counter((r.page_id, r.verdict) for r in judged) == Counter([(1, "block"), (2, "block"), (2, "block"), (3, "block"), (4, "allow")])
    edges = spark.createDataFrame([(None, "http://a.org/y"), ("http://a.org/y", None), (None, None), ("x", "http://a.org/y")], "a string, b string")
    assert {r.verdict for r in url_filter.judge_urls(pages, queries.RULES, edges).collect()} == {"allow"}


def test_many_rules_against_a_plain_search(spark):
    rng = random.Random(9)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rules = [url_filter.Rule(rng.choice(("allow", "block")), rng.choice(hosts), rng.choice(("/", "/a/", "/a/b/", ""))) for _ in range(400)]
    rules += [url_filter.Rule("block", f"h{i}.org") for i in range(20_000)]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(('', '/', '/a/x', '/a/b/c', '/ab'))}" for _ in range(300)] + ["http://x.h777.org/", "http://xh777.org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules, spark.createDataFrame([], "a string, b string")).collect()}
    for i, u in enumerate(urls):
        host, _, path = u[7:].partition("/")
        path = u[7 + len(host) :]
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = min(fits, key=lambda r: (-len(r.name), r.verdict, r.name), default=None)
        assert got[i] == ((best.name, best.verdict) if best else (None, "allow"))


def test_labels_against_plain_expectation_maximisation():
    """The fit from pattern counts equals one that goes over every document, a loop at a time."""
    rng = np.random.default_rng(3)
    truth = rng.random(600) < 0.7
    right = np.array([0.95, 0.9, 0.8, 0.7])
    votes = np.where(rng.random((600, 4)) < 0.4, quality.NONE, np.where((rng.random((600, 4)) < right) == truth[:, None], quality.GOOD, quality.BAD))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float))
    accuracy = [0.9] * 4
    for _ in range(200):
        good = []
        for row in votes:
            a = b = 0.5
            for j, v in enumerate(row):
                if v == quality.GOOD:
                    a, b = a * accuracy[j], b * (1 - accuracy[j])
                elif v == quality.BAD:
                    a, b = a * (1 - accuracy[j]), b * accuracy[j]
            good.append(a / (a + b))
        for j in range(4):
            agreed = sum(g if row[j] == quality.GOOD else 1 - g for g, row in zip(good, votes, strict=True) if row[j] != quality.NONE)
            cast = sum(row[j] != quality.NONE for row in votes)
            accuracy[j] = min(0.999, max(0.5, (agreed + 0.9 * 20) / (cast + 20)))
    assert np.allclose(model.accuracy, accuracy, atol=1e-6)
    assert np.allclose(model.posterior(votes), good, atol=1e-6)
    assert np.mean((model.posterior(votes) > 0.5) == truth) > 0.75


def test_scorer_against_plain_descent():
    """The fitted loss is near the least that long plain gradient descent finds."""
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(20, 6, replace=False)).astype(np.uint16), rng.random(6).astype(np.float32)) for _ in range(300)]
    x = np.zeros((300, 21))
    x[:, 20] = 1
    for i, (at, value) in enumerate(rows):
        x[i, at] = value
    good = 1 / (1 + np.exp(-(x @ rng.standard_normal(21) * 3)))
    scale = np.where(good > 0.5, 0.5 / good.mean(), 0.5 / (1 - good.mean()))

    def loss(w):
        p = 1 / (1 + np.exp(-(x @ w)))
        return -(scale * (good * np.log(p) + (1 - good) * np.log(1 - p))).mean() + 0.5e-4 * (w @ w)

    plain = np.zeros(21)
    for _ in range(20_000):
        plain -= 0.5 * (x.T @ ((1 / (1 + np.exp(-(x @ plain))) - good) * scale) / 300 + 1e-4 * plain)
    assert loss(quality.fit_scorer(rows, good, width=20).astype(float)) <= loss(plain) * 1.02


def test_quality_of_odd_texts(spark):
    """Null, empty and repeated texts, clashing names; a long clean text votes like its parts."""
    sf = "/root/testdata/sf0.1"
    clean = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality = 1 and lang = 'en' and n_chars > 1000").dropDuplicates(["text"]).orderBy("doc_id").limit(400).collect()]
    long = "\n".join(dict.fromkeys(line for text in clean for line in text.split("\n")))
    assert len(long) > 400_000
    assert quality.BAD not in quality.votes(quality.measures(long.encode())) and quality.GOOD in quality.votes(quality.measures(long.encode()))
    shapes = " ".join(f"{'aZ9-'[i % 4]}{'Z9-a'[i // 4 % 4]}{'9-aZ'[i // 16 % 4]}{'aZ9-'[i // 64]}" for i in range(256)).encode()
    at, value = quality.features(shapes, quality.measures(shapes))
    assert math.isclose(value.sum(), 4 + len(quality.measures(shapes)), rel_tol=1e-4)  # every shape's share is there
    rows = [(None, None, "a"), (1, "", "a"), (1, "", "a"), (2, clean[0], "a"), (3, clean[0], "b"), (None, clean[1], "a"), (5, "x" * 100_000, "a")]
    df = documents(spark, rows)
    for name in ("id", "key", "pattern", "at", "value", "good", "score"):
        df = df.withColumn(name, F.lit(1))
    scored = quality.score_quality(df).collect()
    assert Counter(r.doc_id for r in scored) == Counter(r[0] for r in rows)
    assert len({(r.posterior, r.score, r.good) for r in scored if r.doc_id in (2, 3)}) == 1
    assert len({(r.posterior, r.score, r.good) for r in scored if r.doc_id == 1}) == 1
    assert quality.keep_good(df).columns == df.columns


def test_simhash_long_texts_and_names(spark):
    long = [r.text for r in table(spark, "documents").orderBy(F.desc("n_chars")).limit(3).collect()]
    words = " ".join(f"w{i % 700}" for i in range(60_000))
    rows = [*enumerate([*long, words, words + " end", words.upper()])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("id", "print", "component", "low", "root", "mask", "value"):
        df = df.withColumn(name, F.lit("clash"))
    got = {r.doc_id: (r.print % (1 << 64), r.component) for r in simhash.near_duplicates(df).collect()}
    prints = [exact_print(t, 3) for _, t in rows]
    assert [got[i][0] for i, _ in rows] == prints
    assert got[5][1] == got[3][1] == 3 and got[4][1] in (3, 4)


def test_simhash_hot_fingerprint(spark):
    """One text in a third of all rows, and a chain of near ones, with ids that repeat or are null."""
    rows = [(i, "the same text in many rows", "a") for i in range(10, 1510)] + [(None, "a text without an id", "a")] * 3 + [(i, f"text number {i} alone", "a") for i in range(2000, 3000)]
    got = Counter((r.doc_id is None or r.component == (10 if r.doc_id < 2000 else r.doc_id)) for r in simhash.near_duplicates(documents(spark, rows)).collect())
    assert got == Counter({True: len(rows)})


def test_packing_in_many_buckets(spark):
    rng = random.Random(7)
    rows = [(i // 3, i, 0, rng.choice((1, 1, 1, 5, 60, 500, 1024, 1024)), i) for i in range(400)]
    cutted = spark.createDataFrame(rows, "id long, piece int, start long, length long, ids_crc32 long").withColumn("bucket", F.lit(1)).withColumn("rank", F.lit("clash"))
    out = packing.pack(cutted.drop("bucket", "rank")).collect()
    assert Counter((r.id, r.piece, r.length) for r in out) == Counter((r[0], r[1], r[3]) for r in rows)
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= math.ceil(sum(r[3] for r in rows) / 1024) + 2


def clustered(spark, kind, n=3000):
    rng = np.random.default_rng(12)
    if kind == "clustered":
        x = rng.standard_normal((30, 48))[rng.integers(0, 30, n)] + 0.5 * rng.standard_normal((n, 48))
    elif kind == "decaying":
        x = rng.standard_normal((n, 48)) * np.linspace(3, 0.05, 48)
    else:
        x = rng.standard_normal((n, 48))
        x[: n // 3] = x[0]  # one vector in a third of all rows
    return x, spark.createDataFrame([(i, v.tolist(), "clash") for i, v in enumerate(x)], "vec_id long, embedding array<double>, list string")


@pytest.mark.parametrize(("kind", "probe"), [("clustered", 0.2), ("decaying", 0.4), ("hot", ann.PROBE)])
def test_ann_recall_by_structure(spark, kind, probe):
    x, df = clustered(spark, kind)
    got = defaultdict(list)
    for r in ann.search(df, F.col("id") % 20 == 0, probe=probe).collect():
        got[r.query_id].append(r.score)
    found = []
    for q in range(0, len(x), 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        least = np.sort(scores)[-20]
        assert len(got[q]) == 20
        found.append(np.mean(np.array(got[q]) >= least - 1e-9))
    assert np.mean(found) >= 0.9


@pytest.mark.parametrize(("kind", "columns", "share"), [("table", 32, 0.3), ("clustered", 8, 0.15), ("decaying", 16, 0.15)])
def test_scan_abandons_early(spark, kind, columns, share):
    """Few candidates are left after some columns, and nearly all true neighbours stay."""
    x = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()], float) if kind == "table" else clustered(spark, kind)[0]
    x = x[np.random.default_rng(1).permutation(len(x))]
    k, spin = 20, ann.rotation(x)
    near = ann.calibrated(x @ spin, k)
    q = x[-200:]
    scores = q @ x.T
    scores[np.arange(200), np.arange(len(x) - 200, len(x))] = -np.inf
    order = np.argsort(-scores, axis=1)
    trace = []
    pairs = set(zip(*(a.tolist() for a in ann.adaptive_scan(q @ spin, x @ spin, np.take_along_axis(scores, order[:, 2 * k - 1 : 2 * k], 1).ravel(), near, trace=trace)), strict=True))
    assert trace[columns // ann.BLOCK - 1] <= share * 200 * len(x)
    assert np.mean([(i, j) in pairs for i in range(200) for j in order[i, :k].tolist()]) >= 0.95


def test_cut_is_shared(spark):
    assert cut(spark.range(3)).count() == 3
