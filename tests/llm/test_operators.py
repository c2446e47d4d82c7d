"""Each training-data operator against a brute-force model, on whole small tables and on edge cases."""

import dataclasses
import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ann, automaton_dedup, chat, components, knn_join, mixing, packing, quality, queries, similar, simhash, suffix_dedup, url_filter
from plumbline.llm.common import cut
from plumbline.llm.suffix_index import NOBODY, first_owners

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOC)


def edge_documents(spark):
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    passage = " ".join(f"common{i}" for i in range(40))
    rows = [
        (3, None, "a"), (4, "", None), (5, " \t\n", "b"), (1, "One two THREE four", "a"), (2, "one two three four", None),
        (2, "one two three four", None), (None, "no id here at all", "a"), (7, passage, "b"), (8, f"before {passage} after", "c"),
        (9, f"other {passage}", "a"), (10, "a" * 500, "a"), (11, "b" + "a" * 400, "a"), (12, long, "d"), (13, long + " end", "d"), (14, "é" * 60, "é"), (15, "x" + "é" * 60, "é"),
    ]
    return documents(spark, rows)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def repeat_case(spark, which):
    """Documents, and the limit of segments for a minimizer: the crowded phrase exceeds it."""
    if which == "table":
        return table(spark, "documents"), {}
    if which == "edge":
        return edge_documents(spark), {}
    rng = random.Random(11)
    phrase = "one phrase of many words that very many different texts hold"
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(200):
        before, after = (" ".join(rng.choice(words[: rng.choice((1, 2, 40))]) for _ in range(4)) for _ in range(2))
        rows.append((i, f"{before} {phrase} {after}" * (1 + i % 2), "a"))
    return documents(spark, rows + edge_documents(spark).select("doc_id", "text", "source").collect()).repartition(5), {"crowded": 3}


def repeats(seqs, length):
    """{row: covered positions}; a window counts if it starts in a document of a smaller id."""
    low = {}
    for d, s in seqs:
        for i in range(len(s) - length + 1):
            w = s[i : i + length]
            low[w] = min(d, low.get(w, d))
    out = []
    for d, s in seqs:
        hit = set()
        for i in range(len(s) - length + 1):
            if low[s[i : i + length]] < d:
                hit |= set(range(i, i + length))
        out.append(hit)
    return out


def runs(hit):
    return sum(1 for i in hit if i - 1 not in hit)


@pytest.mark.parametrize("which", ["table", "edge", "crowded"])
def test_suffix_dedup(spark, which):
    df, limit = repeat_case(spark, which)
    rows = df.select(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit(""))).collect()
    seqs = [(r[0], r[1].encode()) for r in rows]
    want = Counter()
    for (d, s), hit in zip(seqs, repeats(seqs, 50), strict=True):
        kept = bytes(b for i, b in enumerate(s) if i not in hit)
        want[(d, len(s), len(hit), runs(hit), hashlib.sha256(kept).hexdigest())] += 1
    found = suffix_dedup.mark_repeated_bytes(df, **limit).collect()
    got = Counter((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found)
    assert got == want


@pytest.mark.parametrize("which", ["table", "edge", "crowded"])
def test_automaton_dedup(spark, which):
    df, limit = repeat_case(spark, which)
    rows = df.select(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit(""))).collect()
    seqs = [(r[0], tuple(r[1].encode().split())) for r in rows]
    want = Counter()
    for (d, s), hit in zip(seqs, repeats(seqs, 13), strict=True):
        want[(d, len(s), len(hit), b" ".join(w for i, w in enumerate(s) if i not in hit))] += 1
    found = automaton_dedup.mark_repeated_words(df, **limit).collect()
    got = Counter((-1 if r.doc_id is None else r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), bytes(r.kept)) for r in found)
    assert got == want


@pytest.mark.parametrize("index", [first_owners, automaton_dedup.first_owners])
def test_indexes_agree_with_brute_force(index):
    """Texts and foreign patterns, some with symbols that no text has."""
    rng = random.Random(5)
    symbols, wrap = (b"ab\0\xff", bytes) if index is first_owners else (b"abcd", lambda s: b" ".join(bytes([c]) for c in s))
    for depth in (8, 9, 50):
        base = bytes(rng.choice(symbols) for _ in range(300))
        texts = [base[a : a + depth + rng.randint(0, 60)] for a in (rng.randint(0, 200) for _ in range(40))]
        owners = np.array([rng.randint(0, 9) for _ in texts])
        low = {}
        for t, o in zip(texts, owners.tolist(), strict=True):
            for i in range(len(t) - depth + 1):
                low[t[i : i + depth]] = min(o, low.get(t[i : i + depth], o))
        foreign = [bytes(rng.choice(symbols + b"z") for _ in range(30)) + base[a : a + 80] for a in range(0, 200, 7)]
        for patterns in (None, foreign):
            found = index([wrap(t) for t in texts], owners, depth, None if patterns is None else [wrap(p) for p in patterns])
            want = [[low.get(p[i : i + depth], NOBODY) for i in range(len(p) - depth + 1)] for p in patterns or texts]
            assert [f.tolist() for f in found] == want


@pytest.mark.parametrize("module", [suffix_dedup, automaton_dedup])
def test_all_that_goes_was_marked_by_an_index(spark, module, monkeypatch):
    """Without the answers of the indexes nothing is removed, with them much is."""
    mark = suffix_dedup.mark_repeated_bytes if module is suffix_dedup else automaton_dedup.mark_repeated_words
    removed = F.sum(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]))
    docs = table(spark, "documents")
    assert mark(docs).agg(removed).first()[0] > 1000

    real = module.windows

    def blind(*args, **kwargs):
        found = real(*args, **kwargs)
        return dataclasses.replace(found, first_owners=lambda texts, owners: [np.full(f.shape, NOBODY) for f in found.first_owners(texts, owners)])

    monkeypatch.setattr(module, "windows", blind)
    assert mark(docs).agg(removed).first()[0] == 0


def test_remove_keeps_columns(spark):
    df = edge_documents(spark).withColumn("kept", F.lit(1)).withColumn("unit", F.lit("u"))
    out = suffix_dedup.remove_repeated_bytes(df)
    assert out.columns == df.columns and out.count() == df.count()
    by = {r.doc_id: r.text for r in out.collect()}
    assert by[3] is None and by[4] == "" and by[8] == "before  after"[:6] + by[8][6:] and "common5 " not in by[8]


def exact_print(text, n):
    import xxhash

    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


@pytest.mark.parametrize("which", ["table", "edge"])
def test_simhash(spark, which):
    df = table(spark, "documents").where("n_chars < 3000") if which == "table" else edge_documents(spark).where("coalesce(n_chars, 0) < 9000")
    rows = df.select("doc_id", "text").collect()
    prints = [exact_print(r.text, 3) for r in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                group[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        key = (r.doc_id is not None, r.doc_id)
        least[root(i)] = min(least.get(root(i), key), key, key=lambda k: (k[0], k[1] or 0))
    want = Counter((r.doc_id, prints[i], least[root(i)][1]) for i, r in enumerate(rows))
    got = Counter((r.doc_id, r.print % (1 << 64), r.component) for r in simhash.near_duplicates(df).collect())
    assert got == want


def test_simhash_links_split_shards(spark):
    rng = random.Random(3)
    values = set()
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(12):
            values.add(base)
            base ^= 1 << rng.randrange(64)
            base ^= 1 << rng.randrange(64)
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "print long")
    for limit in (4096, 2):
        edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, 2, tree_limit=limit).collect()]
        assert all((a ^ b).bit_count() <= 4096 for a, b in edges)

        def classes(pairs):
            root = {v: v for v in values}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in pairs:
                root[find(a)] = find(b)
            out = defaultdict(set)
            for v in values:
                out[find(v)].add(v)
            return sorted(map(sorted, out.values()))

        assert classes(edges) == classes([(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2])


def test_similar_documents(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    rows, n = [], 0
    for k in range(60):
        text = [rng.choice(words) for _ in range(300)]
        rows.append((n, " ".join(text), "a"))
        near = list(text)
        for _ in range(4):
            near[rng.randrange(300)] = "changed"
        rows.append((n + 1, " ".join(near), "b"))
        n += 2
    kept = {r.doc_id for r in simhash.drop_similar(documents(spark, rows)).collect()}
    assert len(kept) <= 63 and {r for r in range(0, n, 2)} <= kept


def test_drop_similar_is_exact(spark):
    """Against all pairs, in chains, crowds and one common passage, at three similarities."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for _ in range(40):
        text = [rng.choice(words) for _ in range(rng.choice((20, 100, 150)))]
        for _ in range(5):
            texts.append(" ".join(text))
            text = list(text)
            for _ in range(rng.choice((0, 1, 2, 3, 4))):
                text[rng.randrange(len(text))] = rng.choice(words)
    texts += [" ".join([*passage, *rng.choices(words, k=rng.choice((2, 8, 40)))]) for _ in range(120)]
    texts += ["", None, " \n", "one", "One", "one two three four", "a b c d e", "a b c d e f", "same words all of them " * 9]
    df = documents(spark, [(i, t, "a") for i, t in enumerate(texts)]).repartition(5)

    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = [grams(t) for t in texts]
    for similarity in (0.7, 0.75, 0.8):
        root = list(range(len(sets)))
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(a & sets[j])
                if both / (len(a) + len(sets[j]) - both) >= similarity - 1e-12:
                    x, y = root[i], root[j]
                    root = [min(x, y) if r in (x, y) else r for r in root]
        for piece in {0.7: (4,), 0.75: (None, 4), 0.8: (None,)}[similarity]:
            got = sorted(r.doc_id for r in simhash.drop_similar(df, similarity=similarity, piece=piece).collect())
            assert got == sorted(set(root)), (similarity, piece)


def test_bk_trees_against_brute_force():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, (12, 4), np.uint64)
    prints = np.repeat(base, 30, axis=0)
    for _ in range(40):
        prints ^= np.where(rng.random(prints.shape) < 0.4, np.uint64(1) << rng.integers(0, 64, prints.shape, np.uint64), np.uint64(0))
    prints[5] = prints[3]
    prints = prints[rng.permutation(len(prints))]
    tree = np.sort(rng.integers(0, 5, len(prints)))
    distance = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=np.int64)
    forest = simhash.BKForest(prints, tree)
    for radius in (0, 60, 96, 256):
        near = (distance <= radius) & (tree[:, None] == tree[None]) & ~np.eye(len(prints), dtype=bool)
        queries = np.flatnonzero(rng.random(len(prints)) < 0.5)
        got = [(i, j) for a, b in forest.around(queries, radius) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert sorted(got) == [(i, j) for i in queries.tolist() for j in np.flatnonzero(near[i]).tolist()]
        want = [min(((distance[i, j], j) for j in np.flatnonzero(near[i, :i])), default=(0, -1))[1] for i in range(len(prints))]
        assert forest.nearest(radius).tolist() == want


def test_search_radius_holds_all_pairs_at_the_similarity():
    """Prints of 3000 pairs at similarity 0.8, of 4 to 900 shingles, are within the radius; of unlike sets, not."""
    rng = np.random.default_rng(10)
    radius = similar.search_radius(Fraction(4, 5))
    for k in range(3000):
        own = (1, 1, 2, 3, 20, 90)[k % 6]
        x = int(rng.integers(0, own + 1))
        hashes = rng.integers(0, 1 << 63, 10 * own, np.uint64) << np.uint64(1) ^ rng.integers(0, 2, 10 * own, np.uint64)
        both, one, two, unlike = hashes[: 4 * own], hashes[4 * own : 4 * own + x], hashes[4 * own + x : 5 * own], hashes[5 * own :]
        a, b, c = (simhash.majority(h, similar.PRINT) for h in (np.concatenate((both, one)), np.concatenate((both, two)), unlike))
        assert np.bitwise_count(a ^ b).sum() <= radius
        assert own < 20 or np.bitwise_count(a ^ c).sum() > radius - 10


def test_all_similar_texts_were_found_by_bk_trees(spark, monkeypatch):
    """Without the answers of the trees only texts of equal words go, with them the near ones too."""
    rng = random.Random(15)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(30)]
    rows = [*texts, *(t + " more" for t in texts), *(t.upper() for t in texts)]
    docs = documents(spark, [(i, t, "a") for i, t in enumerate(rows)])
    assert {r.doc_id for r in simhash.drop_similar(docs).collect()} == set(range(30))

    class Blind(simhash.BKForest):
        def around(self, queries, radius):
            return iter(())

        def nearest(self, radius):
            return np.full(len(self.prints), -1)

    monkeypatch.setattr(similar, "BKForest", Blind, raising=False)
    assert {r.doc_id for r in simhash.drop_similar(docs).collect()} == set(range(60))


def test_hot_lists_are_split(spark):
    """500 texts share a prefix shingle without being similar: no task meets them all, no link is lost."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join([*passage, *(f"w{rng.randrange(10**9)}" for _ in range(6))]) for _ in range(500)]  # 26 of 38 shingles
    near = [t.rsplit(" ", 2)[0] for t in texts[::50]]  # 30 of 32
    df = documents(spark, [(i, t, "a") for i, t in enumerate([*texts, *near])]).repartition(5)
    kept = {r.doc_id for r in simhash.drop_similar(df, piece=50).collect()}
    assert kept == set(range(500))

    limit = Fraction(4, 5)
    nodes = cut(similar._nodes(df, "doc_id", "text"))
    common = similar._common(nodes, 510, 5)
    hot = similar._hot(nodes, 510, common, 5, limit, 50)
    lists = cut(similar._lists(nodes, common, hot, 5, limit))
    assert lists.groupBy("h").count().agg(F.max("count")).first()[0] >= 400
    assert lists.groupBy("h", "part").count().agg(F.max("count")).first()[0] < 100
    place = nodes.select("handle", F.xxhash64("node").alias("component"))
    opened = similar._open(lists, place, 50)
    sizes = opened.groupBy("h", "part").count()
    assert sizes.agg(F.max("count")).first()[0] < 200
    # every pair of a hot list is met once
    longest = lists.groupBy("h").count().orderBy(F.desc("count")).first()
    rows = opened.where(F.col("h") == longest["h"]).select("part", "handle", "side").collect()
    by_part = defaultdict(list)
    for r in rows:
        by_part[r.part].append((r.handle, r.side))
    met = Counter(tuple(sorted((a, b))) for members in by_part.values() for i, (a, x) in enumerate(members) for b, y in members[:i] if x < 0 or x != y)
    assert len(met) == longest["count"] * (longest["count"] - 1) // 2 and set(met.values()) == {1}


def test_every_pair_at_the_threshold_goes(spark):
    """200 pairs of similarity 0.8 lose one text each, 200 of 0.79 lose none; so do pairs of the tables."""
    rng = random.Random(6)
    rows = []
    for k in range(400):
        text = [f"w{rng.randrange(10**9)}" for _ in range(104)]  # 100 shingles
        rows += [(2 * k, " ".join(text), "a"), (2 * k + 1, " ".join(text[: 84 - k % 2]), "b")]
    pairs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id in (922, 8228, 5333, 9115)").select("doc_id", "text").collect()
    rows += [(10**6 + r.doc_id, r.text, "c") for r in pairs]  # similarity 0.814 and 0.59
    kept = {r.doc_id for r in simhash.drop_similar(documents(spark, rows)).collect()}
    assert kept == {i for i, _, _ in rows} - {2 * k + 1 for k in range(0, 400, 2)} - {10**6 + 8228}


def test_rows_of_one_id_keep_their_texts(spark):
    """Null and repeated ids: only the rows judged duplicate or bad go."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(9)]
    ids = [None, None, None, 5, 5, 5, 6, 7, 8]
    near = [(9, texts[0] + " more", "a"), (None, texts[3], "a"), (5, texts[4], "a"), (5, texts[4], "b"), (5, texts[8], "a")]
    kept = simhash.drop_similar(documents(spark, [*((i, t, "a") for i, t in zip(ids, texts, strict=True)), *near])).collect()
    want = [*zip(ids, texts, strict=True)]
    want[3], want[8] = (None, texts[3]), (5, texts[8])
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(want)

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.when(F.col("doc_id") % 3 == 1, F.lit(1))).otherwise(F.col("doc_id")))
    key = F.coalesce(F.col("doc_id"), F.lit(-1))
    scored = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "lang", "source", "n_chars"))
    by_row = {r.row: r.good for r in quality._scored(scored, "doc_id", "text").join(scored.withColumn("key", quality.row_key("doc_id", "text")), "key").select("row", "good").collect()}
    assert not all(by_row.values())
    want = Counter((r.id, r.text) for r in scored.select("row", key.alias("id"), "text").collect() if by_row[r.row])
    assert Counter((r.id, r.text) for r in quality.keep_good(scored).select(key.alias("id"), "text").collect()) == want


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(200)] + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(150)] + [(5000, 5000)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}


def test_mixing(spark):
    for df in (table(spark, "documents"), edge_documents(spark)):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df).collect()))
        by = defaultdict(list)
        for r in rows:
            by[r.source].append(r)
            assert 0 <= r.taken <= 3 * r.size
        names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
        size = {s: sum(r["size"] for r in by[s]) for s in names}
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        target = dict.fromkeys(names, 0.0)
        capped, left = set(), sum(size.values())
        while True:
            free = [s for s in names if s not in capped]
            level = (left - sum(3 * size[s] for s in capped)) / max(1, sum(weight[s] for s in free))
            over = {s for s in free if level * weight[s] > 3 * size[s]}
            if not over:
                break
            capped |= over
        target = {s: 3.0 * size[s] if s in capped else level * weight[s] for s in names}
        for s in names:
            assert all(math.isclose(r.target, target[s], rel_tol=1e-12, abs_tol=1e-9) and r.source_size == size[s] for r in by[s])
            assert abs(sum(r.taken for r in by[s]) - target[s]) <= 1


def test_curriculum(spark):
    df = table(spark, "documents")
    out = mixing.curriculum(df)
    assert out.columns == df.columns
    taken = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert max(taken.values()) <= 3
    want = {r.id: r.taken / r["size"] for r in mixing.mix(df).collect()}
    assert all(abs(want[d] - taken[d]) <= 1 for d in want)
    assert mixing.curriculum(edge_documents(spark)).count() > 0


def test_chat(spark):
    text = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi " * 30), (1, 2, "assistant", text * 3), (1, 3, "user", "#### </turn</turn>\\"), (1, 4, "assistant", "</turn>\n### user:\n"),
            (1, 5, "user", None), (1, 6, "assistant", "é" * 9), (2, 0, "assistant", ""), (2, 0, "assistant", "x"), (None, 1, None, "a"), (None, None, "we:ird\n\\role", "b"), (-7, 0, "user", text), (-7, 1, "assistant", text)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(0))
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    for budget in (5, 20, 1024):
        windows = chat.format_chats(df, budget=budget, history=2)
        got = {r.conv: r for r in chat.read_back(windows).collect()}
        assert set(got) == set(by)
        for c, turns in by.items():
            turns.sort()
            said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
            loss = "".join(x for _, _, r, x in turns if r == "assistant")
            assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    several = [r for r in chat.format_chats(df, budget=20).collect() if r.conv == 1]
    assert len(several) > 1 and all(r.text.startswith("### system:\nbe brief</turn>") for r in several)


def test_url_filter(spark):
    rows = [(1, "http://A.example.com/en/1?x"), (2, "https://www.Example.com/en/"), (3, "http://x.net/es/a"), (4, None), (5, "no scheme"), (6, "http://free.org/p#q"), (7, "http://alias.org/"), (8, "http://both.org/"), (9, "http://com"), (10, "http://x.com"), (11, "http://x.com/"), (6, "http://free.org/p#q")]
    pages = spark.createDataFrame([(i, u, "") for i, u in rows], "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    edges = spark.createDataFrame([("http://alias.org/", "http://hop.org/"), ("http://hop.org/", "http://x.net/es/a"), ("http://both.org/", "http://x.net/fr/b"), ("http://both.org/", "http://ok.com/"), (None, "http://free.org/p#q")], "a string, b string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, queries.RULES, edges).collect()}
    assert {i: (r.host, r.path, r.rule, r.verdict) for i, r in got.items()} == {
        1: ("a.example.com", "/en/1", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        3: ("x.net", "/es/a", "net/es/", "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("free.org", "/p", None, "allow"),
        7: ("alias.org", "/", None, "block"), 8: ("both.org", "/", None, "allow"), 9: ("com", "", None, "allow"), 10: ("x.com", "", None, "allow"), 11: ("x.com", "/", "com/", "allow"),
    }
    html = spark.createDataFrame([(1, "http://a.org/", "<html><link href='http://b.org/' rel=canonical>"), (2, "http://c.org/", '<meta http-equiv="refresh" content="0; url=http://d.org/">'), (3, "http://e.org/", None)], "page_id long, url string, html string")
    assert {tuple(r) for r in url_filter.html_aliases(html).collect()} == {("http://a.org/", "http://b.org/"), ("http://c.org/", "http://d.org/")}


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    both = quality.score_quality(docs).join(labels, "doc_id").select("good", "quality").collect()
    right = Counter((r.quality, r.good) for r in both)
    assert right[(1, True)] >= 0.99 * (right[(1, True)] + right[(1, False)])
    assert right[(0, False)] >= 0.9 * (right[(0, True)] + right[(0, False)])
    edge = edge_documents(spark)
    assert quality.score_quality(edge).count() == edge.count()
    kept = quality.keep_good(edge)
    assert kept.columns == edge.columns


def plan_is_sound(plan, counts, capacity):
    used, seen = Counter(), set()
    for first, times, lengths in plan.runs:
        assert times > 0 and sum(lengths) <= capacity
        assert not seen & set(range(first, first + times))
        seen |= set(range(first, first + times))
        for n in lengths:
            used[n] += times
    assert used == {n: c for n, c in enumerate(counts) if c} and len(seen) == plan.sequences


def test_packing_plan():
    rng = np.random.default_rng(1)
    for size, top in ((5, 1024), (200, 1024), (20_000, 1024), (3000, 300), (500, 40)):
        counts = np.bincount(rng.integers(1, top + 1, size), minlength=1025)
        plan = packing.Plan(counts)
        plan_is_sound(plan, counts, 1024)
        least = -(-int((counts * np.arange(1025)).sum()) // 1024)
        bins = []
        for n in np.repeat(np.arange(1025), counts)[::-1]:
            i = min((i for i, b in enumerate(bins) if b >= n), key=lambda i: bins[i], default=None) if size <= 3000 else 0
            if size > 3000:
                break
            if i is None:
                bins.append(1024 - n)
            else:
                bins[i] -= n
        assert plan.sequences <= (len(bins) * 1.01 + 1 if size <= 3000 else least * 1.01 + 1)


@pytest.mark.parametrize("which", ["table", "edge"])
def test_packing(spark, which):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    df = table(spark, "documents") if which == "table" else edge_documents(spark).union(documents(spark, [(20, "a <|endoftext|> b " + "z" * 3000, "s")]))
    slow = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for r in df.collect():
        ids = np.array([*slow.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    rows = packing.pack(packing.pieces(df, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))).collect()
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= math.ceil(sum(r.length for r in rows) / 1024) * 1.02 + 1


def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 16)) * rng.uniform(0.2, 3, (700, 1))
    x[5] = x[7] = x[300]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(800, None, 0), (820, [0.0] * 16, 0), (840, [float("nan")] * 16, 0), (860, [1.0] * 3, 0), (880, [None] + [1.0] * 15, 0), (900, [float("inf")] + [0.0] * 15, 0), (None, [1.0] * 16, 0), (40, x[41].tolist(), 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, part int")


def test_ann(spark):
    df = vectors(spark)
    got = defaultdict(list)
    for r in ann.search(df, F.col("id") % 20 == 0, k=20, probe=0.8).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.score, r.rank))
    data = [(r.vec_id, np.array(r.embedding)) for r in df.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 16 and None not in r.embedding]
    data = [(i, v) for i, v in data if np.isfinite(v).all() and v.any()]
    hits = total = 0
    for q, v in data:
        if q % 20 or q == 40:
            continue
        best = sorted(((-float((v * x).sum()), i) for i, x in data if i != q))[:20]
        assert [g[2] for g in got[q]] == list(range(1, 21))
        assert all(math.isclose(s, float((v * dict(data)[i]).sum()), rel_tol=1e-12) for i, s, _ in got[q] if i != 40)
        hits += len({i for _, i in best} & {g[0] for g in got[q]})
        total += 20
    assert set(got) == {q for q, _ in data if q % 20 == 0} and hits >= 0.95 * total
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0]), (20, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.id) for r in ann.search(few, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()] == [(0, 20), (0, 1), (20, 0), (20, 1)]


def test_ann_recall_on_table(spark):
    df = table(spark, "embeddings")
    got = defaultdict(set)
    for r in ann.search(df, F.col("id") % 20 == 0).collect():
        got[r.query_id].add(r.id)
    assert {len(v) for v in got.values()} == {20}
    rows = df.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    found = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        found.append(len(set(ids[np.argsort(-score)[:20]].tolist()) & got[int(ids[q])]) / 20)
    assert np.mean(found) >= 0.9


def test_knn_join(spark):
    df = vectors(spark)
    got = defaultdict(list)
    for r in knn_join.search(df, F.col("id") % 100 == 0, k=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.score))
    data = [(r.vec_id, [math.floor(1024 * v) for v in r.embedding]) for r in df.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 16 and all(v is not None and math.isfinite(v) for v in r.embedding)]
    for q, v in data:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in data if i != q)[:10]
            assert got[q] == [(i, -s) for s, i in best]
    assert set(got) == {q for q, _ in data if q % 100 == 0}


def test_empty_tables(spark):
    docs = documents(spark, [])
    empty = {
        "suffix": suffix_dedup.mark_repeated_bytes(docs), "removed": suffix_dedup.remove_repeated_bytes(docs), "words": automaton_dedup.mark_repeated_words(docs), "simhash": simhash.near_duplicates(docs),
        "similar": simhash.drop_similar(docs), "mix": mixing.mix(docs), "curriculum": mixing.curriculum(docs), "quality": quality.score_quality(docs), "good": quality.keep_good(docs),
        "chat": chat.read_back(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))),
        "urls": url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), queries.RULES, spark.createDataFrame([], "a string, b string")),
        "ann": ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 20 == 0),
        "knn": knn_join.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 100 == 0),
    }
    import public_tokenizers as P

    empty["pack"] = packing.pack(packing.pieces(docs, P.path("byte_bpe_50k.json")))
    assert {k: v.count() for k, v in empty.items()} == dict.fromkeys(empty, 0)


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF)
        assert docs.columns == before.columns, name
        rows = docs.collect()
        assert rows, name
        if name == "suffix-array dedup":
            seqs = [(r.doc_id, r.text.encode()) for r in before.collect()]
            for (d, s), hit in zip(seqs, repeats(seqs, 50), strict=True):
                kept = bytes(b for i, b in enumerate(s) if i not in hit).decode("utf-8", "ignore") if hit else s.decode()
                assert kept == {r.doc_id: r.text for r in rows}[d]
        elif name != "source mixing":
            assert all(texts[r.doc_id] == r.text for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"
