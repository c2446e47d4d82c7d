"""SQL equivalents of the registered queries."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

import pyspark

_U = r"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda t: length(t) > 1)"
_W = r"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[\x09-\x0D\x1C-\x20\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'), lambda t: t <> '')"
_PAIR = "case when len({u}) >= 2 then list_concat({u}, list_transform(range(1, len({u})), lambda i: {u}[i] || '_' || {u}[i + 1])) else {u} end"


def _tokens(name: str, key: str, table: str, pairs: bool, text: str = "text") -> str:
    words = f"{name}_u as (select {key}, {_U.format(x=text)} as u from {table})"
    return f"{words}, {name} as (select {key.split(' ')[-1]}, {_PAIR.format(u='u') if pairs else 'u'} as tokens from {name}_u)"


_CLAIMS = """
hits as (select b.item_id, d.doc_id, d.lang from benchmark b join documents d on contains(d.text, b.text)),
labels as (select item_id, min(doc_id) as doc_id, arg_min(lang, doc_id) as lang from hits group by 1),
claims as (select coalesce(l.lang, 'auto') as lang, b.item_id as query_idx, b.text, cast(l.doc_id as varchar) as pubkey from benchmark b left join labels l using (item_id))"""

_COLL = r"""
coll as (
  select doc_id as doc_idx, cast(doc_id as varchar) as pubkey,
    case when instr(coalesce(text, ''), chr(10)) > 0 then substring(text, 1, instr(text, chr(10)) - 1) else coalesce(text, '') end as title,
    case when instr(coalesce(text, ''), chr(10)) > 0 then substring(text, instr(text, chr(10)) + 1) else '' end as abstract,
    source as venue, lang, text from documents)"""


def _index(pairs: bool) -> str:
    return f"""{_tokens('tok', 'doc_id as doc_idx', 'documents', pairs)},
tf as (select doc_idx, term, count(*) as tf from (select doc_idx, unnest(tokens) as term from tok) group by all),
corpus as (select count(*) as n, avg(len(tokens)) as avgdl from tok),
terms as (select term, count(*) as df, ln(1 + ((select n from corpus) - count(*) + 0.5::double) / (count(*) + 0.5::double)) as idf from tf group by 1)"""


def _bm25(k1: float, b: float, pairs: bool, claims: str = "claims") -> str:
    return f"""{_index(pairs)}, {_CLAIMS},
{_tokens('qtok', 'query_idx', claims, pairs)},
asked as (select query_idx, term, count(*) as qtf from (select query_idx, unnest(tokens) as term from qtok) group by all),
scores as (
  select a.query_idx, tf.doc_idx, sum(a.qtf * t.idf * tf.tf * {k1 + 1}::double / (tf.tf + {k1}::double * ({1 - b}::double + {b}::double * len(k.tokens) / c.avgdl))) as score
  from asked a join tf using (term) join terms t using (term) join tok k on k.doc_idx = tf.doc_idx cross join corpus c group by 1, 2)"""


def _rank(source: str, k: int, name: str = "ranked") -> str:
    return f"{name} as (select * from (select query_idx, doc_idx, score, row_number() over (partition by query_idx order by round(score, 9) desc, doc_idx) - 1 as rank from {source}) where rank < {k})"


_OUT = "select query_idx, doc_idx, rank, round(score, 6) as score from "
_PLAIN, _CLASSIC, _PAIRED = (2.5, 0.85, False), (1.5, 0.75, False), (2.5, 0.85, True)
_NORM = "normed as (select query_idx, doc_idx, score / (max(score) over (partition by query_idx) + 1e-9::double) as score from {s})"


def _pad(k: int) -> str:
    return f"""fill as (select doc_id as doc_idx from documents order by doc_id limit {k}),
m as (select c.query_idx, count(r.doc_idx) as m from claims c left join ranked r using (query_idx) group by 1),
spare as (select m.query_idx, f.doc_idx, m.m, row_number() over (partition by m.query_idx order by f.doc_idx) as nth from m cross join fill f
  where m.m < {k} and not exists (select 1 from ranked r where r.query_idx = m.query_idx and r.doc_idx = f.doc_idx)),
pad as (select query_idx, doc_idx, score, rank from ranked union all select query_idx, doc_idx, 0.0::double, m + nth - 1 from spare where nth <= {k} - m)"""


_EDGES = """pairs as (
  select doc_idx, i, j, tokens[i + 1] as a, tokens[i + j + 2] as b
  from (select doc_idx, tokens, unnest(range(len(tokens))) as i from tok) cross join (select unnest(range(5)) as j) where i + j + 1 < len(tokens)),
twice as (select doc_idx, i, j, a as term, b as neighbor from pairs where a <> b union all select doc_idx, i, j, b, a from pairs where a <> b),
graph as (select term, neighbor, count(*) as cnt, min([doc_idx, i, j]) as seen from twice group by 1, 2),
near as (select * from (select term, neighbor, cnt, cnt / (sum(cnt) over (partition by term) + 1e-9::double) as share,
  row_number() over (partition by term order by cnt desc, seen) as nth from graph) where nth <= 6)"""

_DIFFUSE = """w0 as (select distinct query_idx, term, 1.0::double as weight from asked),
w1 as (select query_idx, term, sum(weight) as weight from (select * from w0 union all select w.query_idx, n.neighbor, w.weight * n.share * 0.65::double from w0 w join near n using (term)) group by 1, 2),
w2 as (select query_idx, term, sum(weight) as weight from (select * from w1 union all select w.query_idx, n.neighbor, w.weight * n.share * 0.65::double from w1 w join near n using (term)) group by 1, 2)"""


def _feedback(source: str) -> str:
    return f"""{_rank(source, 7, 'top')},
firsts as (select doc_idx, term, min(pos) as pos from (select doc_idx, unnest(tokens) as term, unnest(range(len(tokens))) as pos from tok where doc_idx in (select doc_idx from top)) group by 1, 2),
bags as (select t.query_idx, tf.term, sum(tf.tf) as cnt, min([t.rank, f.pos]) as seen from top t join tf using (doc_idx) join firsts f on f.doc_idx = tf.doc_idx and f.term = tf.term group by 1, 2),
kept as (select * from (select *, row_number() over (partition by query_idx order by cnt desc, seen) as nth from bags) where nth <= 8),
feed as (select query_idx, term, 0.85::double * cnt / sum(cnt) over (partition by query_idx) as weight from kept)"""


_DENSE = """qv as (select item_id as query_idx, list_transform(embedding, lambda x: cast(x as double)) as q from benchmark join embeddings on vec_id = item_id),
dv as (select vec_id as doc_idx, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
sims as (select query_idx, doc_idx, list_inner_product(q, v) / (sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(v, v))) as score from qv cross join dv)"""

_BOTH = f"{_bm25(*_PLAIN)}, {_rank('scores', 2000, 'sparse')}, {_DENSE}, {_rank('sims', 1 << 30, 'dense')}, lists as (select 0 as list_no, * from dense union all select 1, * from sparse)"
_FUSED = """fused0 as (select query_idx, doc_idx, sum(1.0::double / (60 + rank + 1)) as score, min([list_no, rank]) as seen from lists group by 1, 2),
fused as (select query_idx, doc_idx, score, row_number() over (partition by query_idx order by round(score, 9) desc, seen, doc_idx) - 1 as rank from fused0)"""
_CANDIDATES = """cand as (select query_idx, doc_idx, row_number() over (partition by query_idx order by seen, doc_idx) - 1 as pos
  from (select query_idx, doc_idx, min([list_no, rank]) as seen from lists where rank < 500 group by 1, 2))"""
_SIDE = """left join {t} {a} on {a}.query_idx = c.query_idx and {a}.doc_idx = c.doc_idx
left join (select query_idx, count(*) as n from {t} group by 1) {a}n on {a}n.query_idx = c.query_idx"""
_FEATURE = "round(coalesce({a}.score, 0.0::double), 6) as {n}_score, cast(coalesce({a}.rank, {a}n.n, 0) as bigint) as {n}_rank"


def _overlap(fused: str) -> str:
    return f"""pairs0 as (select f.query_idx, f.doc_idx, f.rank as fusion_rank, list_distinct({_U.format(x='q.text')}) as qw, {_U.format(x='d.text')} as dw
  from {fused} f join claims q using (query_idx) join documents d on d.doc_id = f.doc_idx),
over as (select query_idx, doc_idx, fusion_rank, case when len(qw) > 0 then len(list_intersect(qw, dw)) / len(qw)::double else 0.0::double end as score from pairs0),
final as (select query_idx, doc_idx, score, row_number() over (partition by query_idx order by round(score, 9) desc, fusion_rank) - 1 as rank from over)"""


_FIRST = f"""{_bm25(*_PLAIN)}, {_rank('scores', 2000)},
first as (select c.lang, c.query_idx, min(case when cast(r.doc_idx as varchar) = c.pubkey then r.rank end) as hit from claims c left join ranked r using (query_idx) where c.pubkey is not null and c.pubkey <> '' group by 1, 2),
per as (select lang, avg(case when hit < 5 then 1.0::double / (hit + 1) else 0.0::double end) as mrr5, avg(case when hit < 5 then 1.0::double else 0 end) as r5, avg(case when hit < 10 then 1.0::double else 0 end) as r10,
  avg(case when hit < 30 then 1.0::double else 0 end) as r30, avg(case when hit < 50 then 1.0::double else 0 end) as r50 from first group by 1),
long as (unpivot per on mrr5, r5, r10, r30, r50 into name metric value value)"""

_SYMBOLS = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{24C2}-\x{1F251}]+"
_SPACES = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

_MINING = f"""{_CLAIMS}, {_COLL},
docs as (select doc_idx, pubkey, title || chr(10) || abstract as article from coll),
english as (select pubkey, arg_max(text, query_idx) as english from claims where lang = 'en' and pubkey is not null group by 1),
wanted as (select c.*, case when c.lang = 'en' then c.text else coalesce(e.english, c.text) end as search_text, d.article as positive from claims c left join english e using (pubkey) join docs d on d.pubkey = c.pubkey),
tok as (select doc_idx, {_W.format(x='article')} as tokens from docs),
tf as (select doc_idx, term, count(*) as tf from (select doc_idx, unnest(tokens) as term from tok) group by all),
corpus as (select count(*) as n, avg(len(tokens)) as avgdl from tok),
raw as (select term, ln((select n from corpus) - count(*) + 0.5::double) - ln(count(*) + 0.5::double) as raw from tf group by 1),
terms as (select term, case when raw < 0 then 0.25::double * (select avg(raw) from raw) else raw end as idf from raw),
keys as (select distinct search_text, pubkey from wanted),
asked as (select search_text, pubkey, term, count(*) as qtf from (select search_text, pubkey, unnest({_W.format(x='search_text')}) as term from keys) group by all),
scores as (select a.search_text, a.pubkey, tf.doc_idx, sum(a.qtf * t.idf * tf.tf * 2.5::double / (tf.tf + 1.5::double * (0.25::double + 0.75::double * len(k.tokens) / c.avgdl))) as score
  from asked a join tf using (term) join terms t using (term) join tok k on k.doc_idx = tf.doc_idx cross join corpus c group by all),
filled as (select k.search_text, k.pubkey, d.doc_idx, d.pubkey as key, d.article, s.score from keys k cross join docs d left join scores s on s.search_text = k.search_text and s.pubkey = k.pubkey and s.doc_idx = d.doc_idx),
ranked as (select *, row_number() over (partition by search_text, pubkey order by score is null, round(score, 9) desc, doc_idx) as rank from filled),
picked as (select search_text, pubkey, arg_min(doc_idx, rank) as doc_idx, arg_min(article, rank) as article from ranked where rank <= 10 and key <> pubkey group by 1, 2)"""


def oracle_sql() -> dict[str, str]:
    w = _W.format(x="text")
    sql = {
        "tokenize_counts": f"with {_tokens('tok', 'doc_id as doc_idx', 'documents', False)} select doc_idx, len(tokens) as n_tokens, cast(len(list_distinct(tokens)) as bigint) as n_distinct from tok",
        "bigram_counts": f"with {_tokens('tok', 'doc_id as doc_idx', 'documents', True)} select doc_idx, len(tokens) as n_terms, cast(len(list_distinct(list_filter(tokens, lambda t: contains(t, '_')))) as bigint) as n_pairs, md5(array_to_string(tokens, ' ')) as terms_md5 from tok",
        "doc_text_fielded": f"with {_COLL} select doc_idx, md5('Title: ' || trim(title, ' ') || ' | Abstract: ' || trim(abstract, ' ') || case when trim(coalesce(venue, ''), ' ') <> '' then ' | Venue: ' || trim(venue, ' ') else '' end) as text_md5 from coll",
        "doc_text_boosted": f"with {_COLL} select doc_idx, md5(trim(concat_ws(' ', title, title, title, coalesce(venue, ''), coalesce(venue, ''), abstract), ' ')) as text_md5 from coll",
        "dense_text_truncated": f"with {_COLL} select doc_idx, length(substring(title || chr(10) || abstract, 1, 2048)) as n_chars, md5(substring(title || chr(10) || abstract, 1, 2048)) as text_md5 from coll",
        "normalize_claims": f"""with s as (select conv_id, turn, text || ' #tag @user https://example.org/a?b www.example.org ' as t from conversations),
n as (select conv_id, turn, t, trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(t, 'https?://[^\\s]+|www\\.[^\\s]+', '', 'g'), '@[\\p{{L}}\\p{{N}}_]+', '', 'g'), '{_SYMBOLS}', ' ', 'g'), '#', ' '), '{_SPACES}', ' ', 'g'), ' ') as o from s)
select conv_id, turn, md5(case when o = '' then t else o end) as claim_md5 from n""",
        "distinctive_terms": r"""with w as (select conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda t: length(t) >= 6 and regexp_full_match(t, '\p{L}+')) as w from conversations)
select conv_id, turn, array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i), lambda i: w[i]), ' ') as terms from w""",
        "whitespace_terms": f"select doc_id, len({w}) as n_terms, md5(array_to_string({w}, ' ')) as terms_md5 from documents",
        "text_fingerprints": """with r as (select lang, ('0x' || substring(sha256(cast(doc_id as varchar) || ':' || sha256(coalesce(text, ''))), 1, 12))::bigint as v from documents)
select lang, substring(sha256(cast(count(*) as varchar) || ':' || cast(sum(v) as varchar)), 1, 16) as fingerprint from r group by 1""",
        "term_frequency": f"with {_index(False)} select doc_idx, term, tf from tf",
        "document_frequency": f"with {_index(False)} select term, df from terms",
        "corpus_stats": f"with {_index(True)} select n, round(avgdl, 6) as avgdl from corpus",
        "idf_table": f"with {_index(False)} select term, round(idf, 6) as idf from terms",
        "okapi_idf_table": f"""with {_index(False)}, raw as (select term, ln((select n from corpus) - df + 0.5::double) - ln(df + 0.5::double) as raw from terms)
select term, round(case when raw < 0 then 0.25::double * (select avg(raw) from raw) else raw end, 6) as idf from raw""",
        "bm25_top5": f"with {_bm25(*_PLAIN)}, {_rank('scores', 5)} {_OUT} ranked",
        "bm25_vanilla_top5": f"with {_bm25(*_CLASSIC)}, {_rank('scores', 5)} {_OUT} ranked",
        "bm25_normalized": f"with {_bm25(*_PAIRED)}, {_NORM.format(s='scores')}, {_rank('normed', 10)} {_OUT} ranked",
        "bm25_rank_padded": f"with {_bm25(*_PAIRED)}, {_rank('scores', 2000)}, {_pad(2000)} {_OUT} pad",
        "cooccurrence_edges": f"with {_tokens('tok', 'doc_id as doc_idx', 'documents', True)}, {_EDGES} select term, count(*) as degree, cast(sum(cnt) as bigint) as total from graph group by 1",
        "dense_cosine_top10": f"with {_DENSE}, {_rank('sims', 10)} {_OUT} ranked",
        "dense_full_rank": f"with {_DENSE}, {_rank('sims', 1 << 30)} {_OUT} ranked",
        "rrf_fusion": f"with {_BOTH}, {_FUSED} {_OUT} fused where rank < 30",
        "candidate_union": f"with {_BOTH}, {_CANDIDATES} select query_idx, doc_idx, pos from cand",
        "fusion_features": f"with {_BOTH}, {_CANDIDATES} select c.query_idx, c.doc_idx, {_FEATURE.format(a='d', n='dense')}, {_FEATURE.format(a='s', n='sparse')} from cand c {_SIDE.format(t='dense', a='d')} {_SIDE.format(t='sparse', a='s')}",
        "fusion_features_rrf": f"with {_BOTH}, {_CANDIDATES}, {_FUSED} select c.query_idx, c.doc_idx, {_FEATURE.format(a='d', n='dense')}, {_FEATURE.format(a='s', n='sparse')}, {_FEATURE.format(a='f', n='rrf')} from cand c {_SIDE.format(t='dense', a='d')} {_SIDE.format(t='sparse', a='s')} {_SIDE.format(t='fused', a='f')}",
        "lexical_rerank": f"with {_BOTH}, {_FUSED}, heads as (select * from fused where rank < 30), {_overlap('heads')} {_OUT} final",
        "yes_no_probability": "select vec_id, round(1.0::double / (1.0::double + exp(embedding[2]::double - embedding[1]::double)), 6) as p_yes from embeddings",
        "mrr_recall_by_language": f"with {_FIRST} select lang, metric, round(value, 6) as value from long",
        "global_macro_metrics": f"with {_FIRST} select metric, round(avg(value), 6) as value from long group by 1",
        "label_counts": f"with {_CLAIMS} select case when grouping(lang) = 1 then '*' else lang end as lang, count(*) as total, count(*) filter (pubkey <> '') as labeled, count(*) - count(*) filter (pubkey <> '') as unlabeled from claims group by rollup (lang)",
        "ndcg10": f"with {_FIRST} select lang, round(avg(case when hit < 10 then 1.0::double / log2(hit + 2) else 0.0::double end), 6) as ndcg from first group by 1",
        "hard_negatives": f"with {_MINING} select w.lang, w.query_idx, md5(w.text) as anchor_md5, md5(w.positive) as positive_md5, p.doc_idx as negative_idx, md5(p.article) as negative_md5 from wanted w join picked p on p.search_text = w.search_text and p.pubkey = w.pubkey where p.article <> ''",
        "merge_custom_documents": f"""with {_COLL}, twice as (select 0 as src, doc_idx as pos, pubkey, title, venue from coll union all select 1, page_id, cast(page_id * 7 as varchar), url, 'web' from pages)
select pubkey, cast(min([src, pos])[1] as bigint) as src, min([src, pos])[2] as pos, md5(arg_max(title, [src, pos])) as title_md5, arg_max(venue, [src, pos]) as venue from twice group by pubkey""",
        "submission_rows": f"with {_bm25(*_PLAIN)}, {_rank('scores', 5)}, {_pad(5)} select c.lang, c.query_idx as index, '[''' || string_agg(cast(p.doc_idx as varchar), ''', ''' order by p.rank) || ''']' as preds from pad p join claims c using (query_idx) group by 1, 2",
        "result_cards": f"""with {_bm25(*_PLAIN)}, {_rank('scores', 5)}, {_COLL}
select r.query_idx, r.rank + 1 as place, c.pubkey, replace(replace(replace(replace(replace(case when length(title) > 100 then substring(title, 1, 100) || '...' else title end, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as title, coalesce(c.venue, '') as venue from ranked r left join coll c using (doc_idx)""",
        "adhoc_search": f"with adhoc as (select 0::bigint as query_idx, 'the and of that ation' as text), {_bm25(*_PLAIN, claims='adhoc')}, {_rank('scores', 5)} {_OUT} ranked",
    }
    english = "en_claims as (select * from claims where lang = 'en')"
    base = _bm25(*_PAIRED, claims="en_claims").replace(_CLAIMS, f"{_CLAIMS}, {english}")
    flat = "select a.query_idx, tf.doc_idx, sum(a.weight) as score from {w} a join tf using (term) group by 1, 2"
    grown = f"{_EDGES}, {_DIFFUSE}, wide as (select query_idx, doc_idx, sum(score) as score from (select * from scores union all {flat.format(w='w2')}) group by 1, 2)"
    sql |= {
        "top_neighbors": f"with {base}, {_EDGES} select term, neighbor, cnt, nth, round(share, 6) as share from near where term in (select term from asked)",
        "diffusion_weights": f"with {base}, {_EDGES}, {_DIFFUSE} select query_idx, term, round(weight, 6) as weight from w2",
        "prf_terms": f"with {base}, {_feedback('scores')} select query_idx, term, round(weight, 6) as weight from feed",
        "bm25_expanded_top5": f"with {base}, {grown}, {_feedback('wide')}, total as (select query_idx, doc_idx, sum(score) as score from (select * from wide union all {flat.format(w='feed')}) group by 1, 2), {_NORM.format(s='total')}, {_rank('normed', 5)} {_OUT} ranked",
    }
    some = "select {t}.* from {t} join claims using (query_idx) where claims.lang = 'en'"
    spread = f"{_EDGES}, asked_en as ({some.format(t='asked')}), scores_en as ({some.format(t='scores')}), {_DIFFUSE.replace('from asked)', 'from asked_en)')}, wide as (select query_idx, doc_idx, sum(score) as score from (select * from scores_en union all {flat.format(w='w2')}) group by 1, 2)"
    whole = f"total as (select query_idx, doc_idx, sum(score) as score from (select * from wide union all {flat.format(w='feed')} union all select scores.* from scores join claims using (query_idx) where claims.lang <> 'en') group by 1, 2)"
    sql["pipeline_hybrid"] = f"""with {_bm25(*_PLAIN)}, {spread}, {_feedback('wide')}, {whole}, {_NORM.format(s='total')}, {_rank('normed', 2000)}, {_pad(2000)},
{_DENSE}, {_rank('sims', 1 << 30, 'dense')}, lists as (select 0 as list_no, * from dense union all select 1, query_idx, doc_idx, score, rank from pad), {_FUSED}, heads as (select * from fused where rank < 30), {_overlap('heads')} {_OUT} final where rank < 5"""
    if not stop_words():
        return sql
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words())
    sql["stop_word_counts"] = f"with {_tokens('tok', 'doc_id as doc_idx', 'documents', False)} select doc_idx, len(list_filter(tokens, lambda t: t not in ({words}))) as n_tokens from tok"
    return sql


def stop_words() -> list[str]:
    """The library's English, German and French lists, read from its own files; none where these are not at hand."""
    found: set[str] = set()
    folders = [Path(pyspark.__file__).parent / "jars", Path(os.environ.get("SPARK_HOME", "")) / "jars"]
    jars = [jar for folder in folders for jar in folder.glob("spark-mllib_*.jar")]
    if not jars:
        return []
    with zipfile.ZipFile(jars[0]) as files:
        for lang in ("english", "german", "french"):
            found |= {w.strip().lower() for w in files.read(f"org/apache/spark/ml/feature/stopwords/{lang}.txt").decode().splitlines() if w.strip()}
    return sorted(found)
