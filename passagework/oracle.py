"""The queries as SQL for DuckDB, on the same tables (which hold no ideographs)."""

from __future__ import annotations

from passagework.functions.text import ASCII_PUNCTUATION, CJK_PUNCTUATION, STOP_WORDS
from passagework.operators.generation import NO_EVIDENCE_EXTRACTIVE, NO_EVIDENCE_STUFF
from passagework.queries import REWRITTEN, K

_PUNCT = ("[" + "".join("\\" + c for c in ASCII_PUNCTUATION) + CJK_PUNCTUATION + "]").replace("'", "''")
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '{_PUNCT}', ' ', 'g'), '[\\t\\n\\x0b\\f\\r ]+', ' ', 'g'))"


def toks(x: str) -> str:
    return f"regexp_extract_all({norm(x)}, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}]|[a-zA-Z]+|[0-9]+')"


def itoks(x: str) -> str:
    return f"list_filter({toks(x)}, lambda w: w not in ({_STOP}))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\t\\n\\x0b\\f\\r ]+|[\\t\\n\\x0b\\f\\r ]+$', '', 'g')"


def _fixed(size: int, overlap: int) -> str:
    return f"""
p as (select doc_id, i, {_strip(f"substr(text, i + 1, {size})")} t from documents, unnest(generate_series(0, greatest(length(text), 1) - 1, {size - overlap})) u(i)),
chunks as (select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as position, t as text from p where length(t) >= 1)"""


_Q = f"questions as (select item_id query_id, text as question from benchmark)"
_POST = f"""
d_ as (select doc_id, {itoks('text')} t from documents),
post as (select term, doc_id chunk_id, count(*) tf, any_value(dl) dl from (select doc_id, len(t) dl, unnest(t) term from d_) group by 1, 2),
ts as (select term, count(*) df from post group by 1),
cs as (select count(*) n, avg(len(t)) avgdl from d_)"""


def _bm25(k: int, name: str = "bm", questions: str = "questions") -> str:
    return f"""
qt_{name} as (select query_id, unnest(list_distinct({itoks('question')})) term from {questions}),
h_{name} as (select query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))), 9) score
  from post join qt_{name} using (term) join ts using (term), cs group by 1, 2),
{name} as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from h_{name}) where rank <= {k})"""


_SELECT_HITS = "select query_id, rank::int as rank, chunk_id, round(score, 6) score from "
BM25 = f"with {_Q},{_POST},{_bm25(K)}"


def _dense(score: str, where: str = "true") -> str:
    return f"""
with q as (select vec_id query_id, embedding::double[] q from embeddings where vec_id % 20 = 0),
s as (select query_id, vec_id chunk_id, round({score}, 9) score from q, (select vec_id, embedding::double[] v from embeddings where {where}))
select query_id, rank::int as rank, chunk_id, round(score, 6) score from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from s) where rank <= {K}"""


def _hybrid(w: float) -> str:
    k = 2 * K
    return f"""with {_Q},{_POST},{_bm25(k)},
oc as (select query_id, chunk_id, count(*)::double score from post join qt_bm using (term) group by 1, 2),
ov as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from oc) where rank <= {k}),
u as (select query_id, chunk_id, rank, 0 ch, 1.0::double w from bm union all select query_id, chunk_id, rank, 1, {w}::double from ov),
f as (select query_id, chunk_id, round(sum(w / (60 + rank)), 12) score, min(ch * 1000 + rank) seen from u group by 1, 2)
select query_id, rank::int as rank, chunk_id, round(score, 6) score from (select *, row_number() over (partition by query_id order by score desc, seen, chunk_id) rank from f) where rank <= {K}"""


_GOLD = f"""gold as (select item_id sample_id, list(doc_id order by doc_id) g from documents join benchmark b on contains(documents.text, b.text) group by 1)"""


def _metrics(k: int, name: str = "m") -> str:
    return f"""
r_{name} as (select sample_id, g, chunk_id, rank, case when list_contains(g, chunk_id) then 1 else 0 end rel from gold left join bm on bm.query_id = sample_id and rank <= {k}),
c_{name} as (select *, sum(rel) over (partition by sample_id order by rank rows unbounded preceding) seen from r_{name}),
a_{name} as (select sample_id, any_value(g) g, sum(rel) hits, count(chunk_id) docs, min(case when rel = 1 then rank end) f, sum(case when rel = 1 then seen / rank else 0 end) ap,
   sum(case when rel = 1 then 1 / log2(rank + 1) else 0 end) dcg from c_{name} group by 1),
i_{name} as (select *, least(len(g), {k}) most, list_sum(list_transform(generate_series(1, least(len(g), {k})), lambda i: 1 / log2(i + 1))) ideal from a_{name}),
{name} as (select sample_id, unnest(['recall@{k}', 'precision@{k}', 'hit_rate@{k}', 'mrr@{k}', 'map@{k}', 'ndcg@{k}']) metric,
   unnest([hits / len(g), case when docs > 0 then hits / docs else 0 end, (hits > 0)::int::double, coalesce(1 / f, 0), ap / most, dcg / ideal]) value from i_{name})"""


_PAIRS = """
c as (select conv_id, turn, role, text from conversations),
s as (select q.conv_id || ':' || q.turn sample_id, q.text question, a.text answer, coalesce(p.text, '') pred, p.text is not null cited
      from c q join c a on a.role = 'assistant' and a.conv_id = q.conv_id and a.turn = q.turn + 1 left join c p on p.role = 'assistant' and p.conv_id = q.conv_id and p.turn = q.turn + 3 where q.role = 'user' and a.text <> '')"""

_TEXTS = "t_ as (select bm.*, text from bm join documents on doc_id = chunk_id)"
_PACK = f"""{_TEXTS},
b_ as (select query_id, rank, '[' || rank || '] （来源：' || chunk_id || ')' || chr(10) || text block from t_),
k_ as (select *, sum(length(block)) over (partition by query_id order by rank rows unbounded preceding) cum from b_),
pk as (select query_id, string_agg(substr(block, 1, 4000), chr(10) || chr(10) order by rank) context, count(*) n_used from k_ where rank = 1 or cum <= 4000 group by 1)""".replace("chunk_id || ')'", "chunk_id || '）'")

_BEIR_SAMPLES = """with b as (select item_id::varchar sample_id, any_value(b.text) question, string_agg(doc_id::varchar, '|' order by doc_id::varchar) gold
  from labels l join benchmark b on l.doc_id % 40 = b.item_id where quality > 0 group by item_id) """
_NEXT = "(doc_id + 1) % (select max(doc_id) + 1 from documents)"
_SQUAD = """s as (select *, dense_rank() over (order by coalesce(lang, 'und')) - 1 a, row_number() over (partition by coalesce(lang, 'und') order by doc_id) - 1 p from documents)"""

ORACLE_SQL = {
    "text_normalize": f"select doc_id, md5({norm('text')}) normal_md5 from documents",
    "text_tokens": f"select doc_id, len({toks('text')}) n, md5(array_to_string({toks('text')}, ' ')) tokens_md5 from documents",
    "text_index_tokens": f"select doc_id, md5(array_to_string({itoks('text')}, ' ')) tokens_md5 from documents",
    "text_char_ngrams": f"""with s as (select doc_id, replace({norm('text')}, ' ', '') s from documents),
g as (select doc_id, case when s = '' then [] else list_transform(generate_series(1, greatest(length(s) - 2, 1)), lambda i: substr(s, i, 3)) end g from s)
select doc_id, len(g) n, md5(array_to_string(g, '|')) grams_md5 from g""",
    "chunk_fixed": f"with {_fixed(300, 60)} select * from chunks",
    "chunk_ids": f"with {_fixed(400, 80)} select doc_id, position, doc_id || '#' || position || '-' || substr(md5(text), 1, 8) chunk_id from chunks",
    "encode_hashing": f"""with s as (select doc_id, {itoks('text')} t, replace({norm('text')}, ' ', '') s from documents),
f as (select doc_id, unnest(list_concat(t, case when s = '' then [] else list_transform(generate_series(1, greatest(length(s) - 2, 1)), lambda i: substr(s, i, 3)) end)) f from s),
h as (select doc_id, ('0x' || substr(md5(f), 25, 8))::bigint h from f),
w as (select doc_id, (h % 512)::int bucket, sum(case when (h >> 8) % 2 = 1 then 1 else -1 end) w from h group by 1, 2 having w <> 0)
select doc_id, bucket, round(w / sqrt(sum(w * w) over (partition by doc_id)), 9) "value" from w""",
    "dense_topk": _dense("list_inner_product(q, v)"),
    "ann_ivf_topk": _dense("list_inner_product(q, v) / (sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(v, v)))"),
    "ann_ivf_exact": _dense("list_inner_product(q, v)"),
    "ann_ivf_recall": f"select count(*) as n, true as recalled, true as pruned from (select q.vec_id as a, v.vec_id as b from embeddings q, embeddings v where q.vec_id % 20 = 0 qualify row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) desc, v.vec_id) <= {K} + 1) where a <> b",
    "dense_topk_filtered": _dense("list_inner_product(q, v)", "label in (0, 1, 2)"),
    "dense_topk_l2": _dense("1 / (1 + pow(list_distance(q, v), 2))"),
    "dense_topk_cosine": _dense("list_inner_product(q, v) / (sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(v, v)))"),
    "bm25_postings": f"with {_POST[1:]} select term, chunk_id, tf, dl from post",
    "bm25_term_stats": f"with {_POST[1:]} select * from ts",
    "bm25_corpus_stats": f"with {_POST[1:]} select n, round(avgdl, 6) avgdl from cs",
    "bm25_topk": f"{BM25} {_SELECT_HITS} bm",
    "bm25_topk_blocks": f"{BM25} {_SELECT_HITS} bm",
    "hybrid_rrf": _hybrid(1.0),
    "hybrid_rrf_weighted": _hybrid(2.0),
    "transformed_maxmerge": f"""{BM25}, q2 as (select query_id, regexp_replace(question, '{REWRITTEN}', '') question from questions),{_bm25(K, 'b2', 'q2')},
u as (select query_id, chunk_id, score, rank, 0 v from bm union all select query_id, chunk_id, score, rank, 1 from b2),
f as (select query_id, chunk_id, max(score) score, min(v * 1000 + rank) seen from u group by 1, 2)
select query_id, rank::int as rank, chunk_id, round(score, 6) score from (select *, row_number() over (partition by query_id order by score desc, seen, chunk_id) rank from f) where rank <= {K}""",
    "rerank_identity": f"{BM25} {_SELECT_HITS} bm where rank <= 3",
    "rerank_lexical": f"""with {_Q},{_POST},{_bm25(10)}, {_TEXTS},
r as (select t_.*, list_distinct({itoks('question')}) qt, {itoks('text')} ct from t_ join questions using (query_id)),
s as (select query_id, chunk_id, rank bf, round(0.7::double * (len(list_filter(qt, lambda t: list_contains(ct, t))) / len(qt)) - 0.15::double * least(length(text) / 1000, 1) + (1 - 0.7::double) * (1 / (1 + exp(-greatest(least(score, 30), -30)))), 9) score from r)
select query_id, rank::int as rank, chunk_id, round(score, 6) score from (select *, row_number() over (partition by query_id order by score desc, bf) rank from s) where rank <= {K}""",
    "metadata_filter_eq": "select doc_id, lang, source from documents where lang = 'fr'",
    "metadata_filter_in": "select doc_id, lang, source from documents where lang in ('fr', 'de') and source = 'src0'",
    "pack_contexts": f"{BM25}, {_PACK} select query_id, md5(context) context_md5, n_used from pk",
    "generate_extractive": f"""{BM25}, {_TEXTS},
s as (select query_id, rank, chunk_id, unnest(regexp_extract_all(text, '[^。！？!?\\n]+[。！？!?]?')) sent, generate_subscripts(regexp_extract_all(text, '[^。！？!?\\n]+[。！？!?]?'), 1) pos from t_),
n as (select s.* replace ({_strip('sent')} as sent), list_distinct({itoks('question')}) qt from s join questions using (query_id)),
v as (select *, list_distinct({itoks('sent')}) st from n where length({norm('sent')}) >= 2),
c as (select *, round(len(list_filter(qt, lambda t: list_contains(st, t))) / greatest(len(qt), 1) - 0.0005::double * length(sent), 9) score from v where len(st) > 0),
p as (select * from (select *, row_number() over (partition by query_id order by score desc, rank, pos) r from c) where r <= 2),
g as (select query_id, string_agg(sent, ' ' order by r) t, list(chunk_id order by r) ids from p group by 1)
select query_id, coalesce(t, '{NO_EVIDENCE_EXTRACTIVE}') as text, case when ids is null then '' when len(ids) = 2 and ids[1] = ids[2] then ids[1]::varchar else array_to_string(ids, ',') end citations from questions left join g using (query_id)""",
    "generate_echo": f"{BM25}, {_PACK} select query_id, case when context is null then '{NO_EVIDENCE_STUFF}' else {_strip(f'''right('【参考资料】' || chr(10) || context || chr(10) || chr(10) || '【问题】' || chr(10) || question || chr(10) || chr(10) || '【回答】', 200)''')} end as text from questions left join pk using (query_id)",
    "calls_kept": "select doc_id, md5('> ' || right(text, 200)) answer_md5, case when text is not null then 1.0::double end calls_a_text from documents",
    "citations": """with s as (select conv_id, turn, '[' || turn % 4 || '] ' || coalesce(text, '') || ' [' || conv_id % 5 || '][' || length(text) || ']' said from conversations),
m as (select conv_id, turn, list_transform(regexp_extract_all(said, '\\[(\\d{1,9})\\]', 1), lambda x: x::int) n from s)
select conv_id, turn, array_to_string(list_transform(list_filter(n, lambda x, i: x between 1 and 80 and list_position(n, x) = i), lambda x: 'c' || x), ',') cited from m""",
    "text_sentences": """with s as (select doc_id, regexp_extract_all(text, '[^。！？!?\n]+[。！？!?]?') s from documents) select doc_id, len(s) n, md5(array_to_string(s, '|')) sentences_md5 from s""",
    "semi_anti_join": "select doc_id, lang, doc_id in (select doc_id from labels) labelled from documents",
    "source_jsonl": "select doc_id::varchar doc_id, md5(text) text_md5, 't' || doc_id % 7 title, lang, n_chars::varchar n_chars from documents where text <> ''",
    "source_jsonl_filtered": "select doc_id::varchar doc_id, 't3' title from documents where lang in ('fr', 'de') and doc_id % 7 = 3 and text <> ''",
    "source_memory": "select item_id::varchar doc_id, text, item_id::varchar title, length(text)::varchar length from benchmark",
    "dataset_jsonl_corpus": "select doc_id::varchar doc_id, md5(text) text_md5, 't' || doc_id % 7 title from documents",
    "dataset_jsonl_samples": "select item_id::varchar sample_id, text as question, case when item_id % 2 = 0 then text || '|[2] b' else '[1] ' || text end answers, (item_id * 3)::varchar gold from benchmark",
    "dataset_beir_corpus": f"select doc_id::varchar doc_id, md5({_strip("'t' || doc_id % 7 || chr(10) || text")}) text_md5, 't' || doc_id % 7 title from documents",
    "dataset_beir_samples": _BEIR_SAMPLES + "select sample_id, question, gold from b",
    "dataset_convert": _BEIR_SAMPLES + "select sample_id, question, 0 n_answers, gold from b",
    "dataset_hotpot_corpus": "select 'd' || doc_id doc_id, 'd' || doc_id title, md5(text) text_md5 from documents",
    "dataset_hotpot_samples": f"select 'q' || doc_id sample_id, b.text as question, 'a' || doc_id answers, least('d' || doc_id, 'd' || {_NEXT}) || '|' || greatest('d' || doc_id, 'd' || {_NEXT}) gold, 'bridge' as type, 'easy' as level from documents join benchmark b on doc_id % (select count(*) from benchmark) = item_id",
    "dataset_squad_corpus": f"with {_SQUAD} select 'a' || a || '#' || p doc_id, 'in ' || lang title, md5(text) text_md5 from s",
    "dataset_squad_samples": f"""with {_SQUAD} select 'q' || doc_id sample_id, 'What says text {{' || doc_id || '}} of "' || lang || '"?' question, md5(case when doc_id % 3 = 0 then '' else text end) answers_md5, 'a' || a || '#' || p gold from s""",
    "kb_save_load": f"{BM25} select query_id, rank::int as rank, round(score, 6) score from bm",
    "kb_upsert": "select count(*) documents, count(*) + count(*) filter (doc_id % 2 = 0) chunks, count(*) + count(*) filter (doc_id % 2 = 0) bm25_chunks, 16 dimension from documents where trim(text) <> ''",
    "metric_rouge_l": f"""with recursive {_PAIRS},
t as (select sample_id, {toks('pred')} p, {toks('answer')} g from s),
l as (select sample_id, 0 i, list_transform(g, lambda x: 0) as row_, p, g from t union all
  select sample_id, i + 1, list_transform(c, lambda x, j: list_max(c[1:j])), p, g from
    (select *, list_transform(g, lambda x, j: case when x = p[i + 1] then coalesce(row_[j - 1], 0) + 1 else row_[j] end) c from l where i < len(p))),
e as (select sample_id, len(p) np, len(g) ng, coalesce(row_[len(g)], 0) n from l where i = len(p))
select sample_id, 'rouge_l' metric, case when n > 0 then round(2 * (n / np) * (n / ng) / (n / np + n / ng), 9) else 0 end as "value" from e""",
    "metric_exact_match": f"with {_PAIRS} select sample_id, 'exact_match' metric, ({norm('answer')} = {norm('pred')})::int::double as \"value\" from s",
    "metric_answer_contains": f"with {_PAIRS} select sample_id, 'answer_contains' metric, ({norm('answer')} <> '' and contains({norm('pred')}, {norm('answer')}))::int::double as \"value\" from s",
    "metric_token_f1": f"""with {_PAIRS},
t as (select sample_id, {toks('pred')} p, {toks('answer')} g from s),
pc as (select sample_id, w, count(*) a from (select sample_id, unnest(p) w from t) group by 1, 2),
gc as (select sample_id, w, count(*) b from (select sample_id, unnest(g) w from t) group by 1, 2),
m as (select sample_id, sum(least(a, b)) c from pc join gc using (sample_id, w) group by 1),
r as (select t.sample_id, coalesce(c, 0) / greatest(len(p), 1) pr, coalesce(c, 0) / greatest(len(g), 1) rc from t left join m using (sample_id))
select sample_id, unnest(['token_f1', 'token_precision', 'token_recall']) metric, unnest([round(case when pr > 0 then 2 * pr * rc / (pr + rc) else 0 end, 9), round(pr, 9), round(rc, 9)]) as "value" from r""",
    "metric_context_recall": f"""with {_PAIRS}, t as (select sample_id, {norm('question')} ctx, {norm('answer')} a, {toks('answer')} t from s)
select sample_id, unnest(['context_recall', 'answer_in_context']) metric,
  unnest([case when len(t) > 0 then round(len(list_filter(t, lambda w: contains(ctx, w))) / len(t), 9) else 0 end, (a <> '' and contains(ctx, a))::int::double]) as "value" from t""",
    "metric_faithfulness": f"""with {_PAIRS}, t as (select sample_id, {toks('question')} c, {toks('pred')} p, cited from s)
select sample_id, unnest(['faithfulness', 'citation_rate']) metric,
  unnest([case when len(p) > 0 then round(len(list_filter(p, lambda w: list_contains(c, w))) / len(p), 9) else 0 end, (len(p) > 0 and cited)::int::double]) as "value" from t""",
    "eval_summary": f"{BM25}, {_GOLD},{_metrics(K)} select metric, round(avg(round(value, 9)), 6) as \"value\", count(*) n from m group by 1",
    "ablation_delta": f"""{BM25}, {_GOLD},{_metrics(5, 'm5')},{_metrics(1, 'm1')},
v as (select 'k=5' as variant, metric, round(avg(round(value, 9)), 6) v from m5 group by 2 union all select 'k=1', metric, round(avg(round(value, 9)), 6) from m1 group by 2)
select v.variant, v.metric, v.v as "value", round(v.v - coalesce(b.v, 0), 6) as delta from v left join v b on b.variant = 'k=5' and split_part(b.metric, '@', 1) = split_part(v.metric, '@', 1)""",
    "dedup_documents": "select min(doc_id) doc_id, count(*) copies from documents group by text",
    "kb_stats": f"with {_fixed(300, 60)} select count(distinct doc_id) documents, count(*) chunks from chunks",
} | {f"metric_{n}": f"{BM25}, {_GOLD},{_metrics(K)} select sample_id, metric, round(value, 9) as \"value\" from m where metric = '{n}@{K}'" for n in ("recall", "precision", "hit_rate", "mrr", "map", "ndcg")}
