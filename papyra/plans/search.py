"""Queries of chunking, indexing, retrieval, evaluation, baskets, citations and vector geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import text as tx
from papyra.functions import vectors as vx
from papyra.functions.dates import midpoint
from papyra.functions.union import union_all
from papyra.operators import basket as bk
from papyra.operators import chunking, citations, embedding, evaluation, lexical, retrieval
from papyra.sources.stored import stored

from . import chunk_sql
from .corpus import contents
from .surrogate import BASKET, DOCS, EDITIONS, basket, docs, duck, editions, frame, table, views

K, SEED = 10, 7
LETTERS = "abcdefghijklmnopqrstuvwxyz"

#: Answers over documents: a true citation, an inverted, an unknown and a malformed one, one out of range.
ANSWERS = """
select doc_id as answer_id, concat('See [[', cast(doc_id as string), ':0-', cast(least(20, length(text)) as string), ']], [[', cast(doc_id as string), ':5-3]] and [[', cast(doc_id + 1000000000 as string),
  ':0-5]]; [[ ', cast(doc_id as string), ' ]] [[', cast(doc_id as string), ':0-', cast(length(text) + 1 as string), ']] [[', cast(doc_id as string), ':0-', cast(least(20, length(text)) as string), ']]') as answer,
  concat('[', cast(doc_id as string), ':0-', cast(least(20, length(text)) as string), ']') as qkey,
  case when mod(doc_id, 5) = 0 then concat('x', substr(text, 1, 19)) else substr(text, 1, 20) end as qtext
from {documents}
"""


def _chunks(s, d):
    """Documents as chunks: one a document, with its act and interval."""
    return docs(s, d).withColumn("chunk_id", F.col("doc_id"))


def _letters(text):
    low = F.lower(text)
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])


def _built(s, d):
    """The index as one plan."""
    return lexical.build(docs(s, d).select(F.col("doc_id").alias("chunk_id"), "text"))


def _index(s, d):
    """The index as written once a session and read from there."""
    return lexical.LexicalIndex.read(s, stored(s, "lexical", [f"{d}/documents.parquet"], _built(s, d).write))


def _letter_vectors(s, d):
    """Documents' vectors, written once a session as a vector table is."""
    source = docs(s, d).select(F.col("doc_id").alias("chunk_id"), "act_id", "begin_ord", "end_ord", "is_current", _letters(F.col("text")).alias("v"))
    return s.read.parquet(stored(s, "vectors", [f"{d}/documents.parquet"], source.write.parquet))


def _meta(s, d):
    return docs(s, d).select(F.col("doc_id").alias("chunk_id"), "act_id", "begin_ord", "end_ord", "is_current")


def _lex(s, d, k=K, **more):
    return retrieval.lexical_hits(_index(s, d), basket(s, d), _meta(s, d), k, **more)


def _dense(s, d, k=K):
    return retrieval.dense(basket(s, d).select("query_id", "as_of", _letters(F.col("query")).alias("v")), _letter_vectors(s, d), k)


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("act_id"), F.col("embedding").cast("array<double>").alias("v"))


def _gold(s, d):
    """Documents that hold a query's passage: by its rarest inner term through the index, then letter by letter.

    A document that holds the passage holds the passage's inner words (all but the first and the last,
    which may be parts of longer ones there). A passage without an inner term is looked for everywhere."""

    def build(path):
        q, w, index = basket(s, d).select("query_id", "query"), docs(s, d).select("doc_id", "act_id", "text"), _index(s, d)
        inner = F.regexp_replace("query", r"^[^ \t\n\r]*[ \t\n\r]|[ \t\n\r][^ \t\n\r]*$", "")
        words = q.where(F.col("query").rlike(r"[ \t\n\r].*[ \t\n\r]")).select("query_id", F.explode(F.array_distinct(tx.tokens(inner))).alias("term"))
        rare = words.join(index.terms, "term", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "term"))["term"].alias("term"))
        at = index.postings.join(rare, "term").select("query_id", F.col("chunk_id").alias("doc_id"))
        found = at.join(w, "doc_id").join(q, "query_id").where(F.contains(F.col("text"), F.col("query")))
        rest = w.join(q.join(rare, "query_id", "left_anti"), F.contains(F.col("text"), F.col("query")))
        columns = ["query_id", "act_id", F.col("doc_id").alias("chunk_id")]
        union_all([found.select(*columns), rest.select(*columns)]).write.parquet(path)

    return s.read.parquet(stored(s, "gold", [f"{d}/documents.parquet", f"{d}/benchmark.parquet"], build))


def _fused(s, d, k=None):
    return retrieval.fuse([_dense(s, d, 3 * K), _lex(s, d, 3 * K)], k)


def _stages(s, d, collapsed=True):
    return retrieval.pipeline([_dense(s, d, 3 * K), _lex(s, d, 3 * K)], basket(s, d), docs(s, d).select(F.col("doc_id").alias("chunk_id"), "text"), collapsed)


def _ablation(s, d):
    st = _stages(s, d)
    variants = {"fusion": retrieval.upto(st["fused"], K), "cap": retrieval.upto(st["capped"], K), "rerank": retrieval.upto(st["reranked"], K), "dedup": retrieval.upto(st["collapsed"], K)}
    return union_all([evaluation.metrics(hits, _gold(s, d), basket(s, d), ("act_id",)).withColumn("variant", F.lit(name)) for name, hits in variants.items()])


def _modes(s, d):
    modes = {"dense": _dense(s, d), "lexical": _lex(s, d), "hybrid": _fused(s, d, K), "random": retrieval.random_control(basket(s, d), _meta(s, d), K, SEED)}
    return union_all([evaluation.metrics(hits, _gold(s, d), basket(s, d), ("act_id",)).withColumn("mode", F.lit(name)) for name, hits in modes.items()])


def _probe(s, d):
    asked = basket(s, d).where("as_of is not null")
    ranked = lexical.top(lexical.scores(_index(s, d), asked), 16 * K)
    wanted = retrieval.pit_filter(_gold(s, d).join(_meta(s, d).drop("act_id"), "chunk_id").join(asked.select("query_id", "as_of"), "query_id")).select("query_id", "chunk_id")
    return evaluation.overfetch_probe(ranked, K, wanted)


def _one_gold(s, d):
    return _gold(s, d).groupBy("query_id").agg(F.min("act_id").alias("act_id"))


def _answers(s, d):
    return frame(s, d, ANSWERS).withColumn("quotes", F.create_map("qkey", "qtext"))


def _windowed(s, d):
    spans = chunking.pack_paragraphs(docs(s, d))
    return embedding.windows(spans.withColumn("chunk_id", F.concat("doc_id", F.lit(":"), "start", F.lit("-"), "end")), 4)


def _siblings(s, d):
    seg = chunking.paragraph_spans(docs(s, d).select("doc_id", "text"))
    return chunking.merge_siblings(seg.withColumn("parent_key", F.floor(F.col("para") / 5)), 2000)


def _chunked(s, d):
    """Real chunks with their acts' intervals."""
    meta = docs(s, d).select("doc_id", "begin_ord", "end_ord", "is_current")
    return chunking.chunk_documents(docs(s, d)).join(meta, "doc_id")


def flagship_search(s, d):
    """Chunks of whole documents, indexed, searched for every benchmark passage, as of its date."""
    chunks = _chunked(s, d)
    index = lexical.build(chunks, breadcrumb="breadcrumb")
    hits = retrieval.lexical_hits(index, basket(s, d), chunks.select("chunk_id", "act_id", "begin_ord", "end_ord", "is_current"), K)
    return hits.select("query_id", "rank", "chunk_id", "act_id", "score")


def _verified(s, d):
    return citations.verify(_answers(s, d), docs(s, d))


def _stored(s, d):
    a = _answers(s, d).withColumns({"refused": F.col("answer_id") % 7 == 0, "error": F.when(F.col("answer_id") % 11 == 0, "no answer")})
    return a.join(_verified(s, d).drop("failures"), "answer_id")


def _pool(s, d):
    return bk.synthetic_pool(_chunks(s, d).where("text is not null"), 40, SEED)


def _assembled(s, d):
    """Queries by attributes, and by the content of an act's first and last edition, in one basket."""
    pairs = bk.temporal_pairs(docs(s, d), docs(s, d).withColumn("chunk_index", F.lit(0)), SEED)
    made = pairs.where("doc_id % 8 < 4").select("doc_id", F.concat(F.lit("What of "), "doc_id", F.lit("?")).alias("question"))
    whole = bk.assembled([bk.metadata(_titled(s, d), 60, SEED, TITLED), bk.temporal_semantic(pairs, made, 40)], SEED)
    return whole.groupBy("type", "part").agg(F.count("*").alias("n"), F.count("as_of").alias("dated"))


TITLED = r"^(\S+)\s+(.+?)\s+of\s+(\S+)(?:\s+N\s+(\S+))?"


def _titled(s, d):
    return editions(s, d).withColumn("title", F.concat(F.lit("Order "), F.replace("doc_type", F.lit(" "), F.lit("_")), F.lit(" of "), "date", F.lit(" N "), "doc_id"))


QUERIES = {
    "flagship_search": flagship_search,
    "paragraph_spans": lambda s, d: chunking.paragraph_spans(docs(s, d).select("doc_id", "text")).select("doc_id", "para", "start", "end"),
    "sentence_spans": lambda s, d: docs(s, d).select("doc_id", F.size(chunking.sentences(F.col("text"))).alias("sentences")),
    "sliding_windows": lambda s, d: docs(s, d).select("doc_id", F.explode(chunking.sliding_windows(F.lit(0).cast("long"), F.length("text").cast("long"), 2000, 200)).alias("x")).select("doc_id", "x.start", "x.end"),
    "pack_paragraphs": lambda s, d: chunking.pack_paragraphs(docs(s, d)).select("doc_id", "chunk_index", "start", "end"),
    "merge_siblings": lambda s, d: _siblings(s, d).select("doc_id", "start", "end", "merged"),
    "toc_segments": lambda s, d: chunking.segments(contents(s, d)),
    "toc_breadcrumbs": lambda s, d: contents(s, d).select("doc_id", F.posexplode(chunking.breadcrumbs(F.col("contents"))).alias("node", "p")).select("doc_id", "node", F.array_join("p", " › ").alias("path")),
    "chunk_documents": lambda s, d: chunking.chunk_documents(docs(s, d)),
    "chunk_documents_outline": lambda s, d: chunking.chunk_documents(contents(s, d)),
    "chunk_summary": lambda s, d: chunking.chunk_summary(chunking.chunk_documents(docs(s, d)), docs(s, d)),
    "chunk_stats": lambda s, d: chunking.chunk_stats(chunking.chunk_documents(docs(s, d)), docs(s, d)),
    "chunk_offset_identity": lambda s, d: chunking.offset_violations(chunking.chunk_documents(docs(s, d)), docs(s, d)).agg(F.count("*").alias("violations")),
    "tokenize": lambda s, d: docs(s, d).select("doc_id", tx.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("tokens"), F.md5(F.array_join("t", " ")).alias("digest")),
    "bm25_index": lambda s, d: _built(s, d).terms,
    "bm25_postings": lambda s, d: _index(s, d).postings.select("chunk_id", "term", "tf", "dl"),
    "bm25_statistics": lambda s, d: _index(s, d).stats.select("n", F.round("avgdl", 9).alias("avgdl")),
    "bm25_search": lambda s, d: lexical.search(_index(s, d), basket(s, d), K),
    "l2_normalize": lambda s, d: _vectors(s, d).select("chunk_id", F.round(vx.norm(vx.unit(F.col("v"))), 9).alias("norm"), F.round(F.element_at(vx.unit(F.col("v")), 1), 9).alias("first")),
    "mrl_truncate": lambda s, d: _vectors(s, d).select("chunk_id", F.round(F.element_at(vx.truncated(F.col("v"), 16), 16), 9).alias("last")),
    "context_windows": lambda s, d: _windowed(s, d).select("chunk_id", "window_nr"),
    "token_windows": lambda s, d: embedding.token_windows(chunking.chunk_documents(docs(s, d)), 2000),
    "resume_plan": lambda s, d: embedding.resume_plan(_windowed(s, d), _windowed(s, d).where("doc_id % 3 <> 0").select("chunk_id")),
    "index_load": lambda s, d: embedding.vector_table(_vectors(s, d), docs(s, d).withColumnRenamed("doc_id", "chunk_id").drop("begin_ord", "end_ord"))[0].select("chunk_id", "begin_ord", "end_ord", "is_current"),
    "pit_filter": lambda s, d: retrieval.pit_filter(docs(s, d).join(F.broadcast(basket(s, d).select("query_id", "as_of")))).groupBy("query_id").agg(F.count("*").alias("n")),
    "dense_topk": lambda s, d: retrieval.dense(_vectors(s, d).where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "v"), _vectors(s, d), K),
    "dense_topk_pit": _dense,
    "lexical_pit": _lex,
    "lexical_overfetch": lambda s, d: _lex(s, d, K, overfetch=retrieval.OVERFETCH),
    "rrf_hybrid": lambda s, d: _fused(s, d, K),
    "rrf_fuse": _fused,
    "random_control": lambda s, d: retrieval.random_control(basket(s, d), _meta(s, d), K, SEED),
    "cap_per_act": lambda s, d: retrieval.cap(_fused(s, d), 2),
    "collapse_by_act": lambda s, d: retrieval.collapse(_fused(s, d)),
    "rerank_overlap": lambda s, d: _stages(s, d)["reranked"],
    "search_pipeline": lambda s, d: _stages(s, d, False)["top"],
    "stage_trace": lambda s, d: retrieval.trace(_stages(s, d)),
    "first_match_rank": lambda s, d: evaluation.first_matches(_fused(s, d), _gold(s, d), "chunk_id"),
    "ir_metrics": lambda s, d: evaluation.metrics(_fused(s, d), _gold(s, d), basket(s, d)),
    "ir_metrics_by_type": lambda s, d: evaluation.metrics(_fused(s, d), _gold(s, d), basket(s, d), by="type"),
    "eval_modes": _modes,
    "shuffled_gold": lambda s, d: evaluation.shuffled_gold(_one_gold(s, d), SEED),
    "overfetch_probe": _probe,
    "ablation": _ablation,
    "basket_metadata": lambda s, d: bk.metadata(_titled(s, d), 60, SEED, TITLED),
    "interval_midpoint": lambda s, d: editions(s, d).select("doc_id", midpoint(F.col("begin_date"), F.col("end_date")).alias("as_of")),
    "basket_temporal": lambda s, d: bk.temporal(editions(s, d)),
    "basket_temporal_pairs": lambda s, d: bk.temporal_pairs(docs(s, d), docs(s, d).withColumn("chunk_index", F.lit(0)), SEED).select("act_id", "doc_id", "as_of", "which", "text"),
    "basket_assembled": _assembled,
    "basket_synthetic_pool": _pool,
    "stratified_split": lambda s, d: bk.split(basket(s, d), SEED).select("query_id", "type", "part"),
    "basket_counts": lambda s, d: bk.counts(bk.temporal(editions(s, d)).select(F.col("which").alias("type"))),
    "parse_citations": lambda s, d: citations.cited(frame(s, d, ANSWERS)),
    "parse_malformed": lambda s, d: citations.malformed(frame(s, d, ANSWERS)),
    "resolve_citations": lambda s, d: citations.resolved(citations.cited(frame(s, d, ANSWERS)), docs(s, d)).select("answer_id", "nr", "fragment"),
    "check_citations": lambda s, d: citations.checked(citations.resolved(citations.cited(frame(s, d, ANSWERS)), docs(s, d))).select("answer_id", "nr", "reason"),
    "verify_answer": lambda s, d: _verified(s, d).drop("failures"),
    "answer_summary": lambda s, d: citations.summary(_stored(s, d)),
    "reverify": lambda s, d: citations.reverify(_stored(s, d), docs(s, d)).select("answer_id", "citations", "references_total", "quote_verbatim"),
    "citations_valid": lambda s, d: citations.citations_valid(_stored(s, d)).groupBy("valid").agg(F.count("*").alias("n")),
    "format_fragments": lambda s, d: citations.fragments(_lex(s, d, 3).join(docs(s, d).select(F.col("doc_id").alias("chunk_id"), F.col("title").alias("breadcrumb"), "text"), "chunk_id")),
    "json_fence": lambda s, d: table(s, d, "events").select("event_id", tx.without_fence(F.concat(F.lit("```json\n"), F.coalesce("props", F.lit("{}")), F.lit("\n```"))).alias("json")),
    "fixed_pieces": lambda s, d: embedding.fixed_pieces(docs(s, d)),
    "mrl_geometry": lambda s, d: retrieval.truncation_geometry(table(s, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")), 16),
    "mrl_geometry_all": lambda s, d: retrieval.truncation_geometry(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 16),
}

_V = views(docs=DOCS, basket=BASKET)
_SPANS = "paras as (select doc_id, unnest(range(len(x)))::int as para, unnest(x) as line from (select doc_id, string_split(text, chr(10)) as x from documents)), spans as (select doc_id, para, (sum(length(line) + 1) over (partition by doc_id order by para) - length(line) - 1)::bigint as s, (sum(length(line) + 1) over (partition by doc_id order by para) - 1)::bigint as e from paras), full_spans as (select *, row_number() over (partition by doc_id order by s) as k from spans where e > s)"
_PACK = f"{_SPANS}, recursive_pack as (select doc_id, k, s, e, 0 as c from full_spans where k = 1 union all select f.doc_id, f.k, case when f.e - p.s <= 2000 then p.s else f.s end, f.e, p.c + (f.e - p.s > 2000)::int from recursive_pack p join full_spans f on f.doc_id = p.doc_id and f.k = p.k + 1), packs as (select doc_id, c as chunk_index, min(s) as s, max(e) as e from recursive_pack group by 1, 2)"
_TOK = r"list_concat(regexp_extract_all(lower({0}), '[\p{L}]{2,}'), regexp_extract_all(lower({0}), '[0-9]+(?:[-./][\p{L}\p{N}_]+)+|[0-9]{2,}'))"


def _tok(column: str) -> str:
    return _TOK.replace("{0}", column)


def _lex_sql(key: str, text: str, source: str) -> str:
    return f"toks as (select {key} as chunk_id, {_tok(text)} as t from {source}), post as (select chunk_id, dl, term, count(*) as tf from (select chunk_id, len(t) as dl, unnest(t) as term from toks) group by 1, 2, 3), terms as (select term, count(*) as df from post group by 1), st as (select count(*) as n, avg(len(t)) as avgdl from toks), asked as (select query_id, term, count(*) as qtf from (select query_id, unnest({_tok('query')}) as term from basket) group by 1, 2), scored as (select query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)))), 6) as score from asked join terms using (term) join post using (term), st group by 1, 2)"
_LEX = _lex_sql("doc_id", "text", "documents")
_CRUMBED = "(breadcrumb || chr(10) || text)"
_DOCS = f"docs as ({duck(DOCS)})"
_BUCKET = f"(('0x' || substr(md5(concat('{SEED}:', {{0}})), 1, 8))::ubigint % buckets)"
_RANDOM = f"nb as (select greatest(1, count(*) // {retrieval.DRAWN}) as buckets from docs), dealt as (select doc_id, act_id, {_BUCKET.format('doc_id')} as bucket from docs, nb), asks as (select query_id, {_BUCKET.format('query_id')} as bucket from basket, nb), r10 as (select * from (select query_id, doc_id as chunk_id, act_id, row_number() over (partition by query_id order by md5(concat('{SEED}:', query_id, ':', doc_id)), doc_id)::int as rank from dealt join asks using (bucket)) where rank <= 10)"
_PIT = "(case when q.as_of is null then d.is_current else d.begin_ord <= q.as_of and d.end_ord >= q.as_of end)"


def _leg(name: str, k: int, source: str = "scored") -> str:
    return f"{name} as (select * from (select s.query_id, s.chunk_id, d.act_id, s.score, row_number() over (partition by s.query_id order by s.score desc, s.chunk_id)::int as rank from {source} s join docs d on d.doc_id = s.chunk_id join basket q on q.query_id = s.query_id where {_PIT}) where rank <= {k})"


def _vec(column: str) -> str:
    return "[" + ", ".join(f"(length(lower({column})) - length(replace(lower({column}), '{c}', '')))::double" for c in LETTERS) + "]"


_DEN = f"dvec as (select doc_id, {_vec('text')} as v from documents), qvec as (select query_id, {_vec('query')} as v from basket), dscored as (select query_id, doc_id as chunk_id, round(list_cosine_similarity(d.v, q.v), 6) as score from dvec d, qvec q)"
_BOTH = f"{_V}, {_LEX}, {_DEN}, {_leg('dense', 30, 'dscored')}, {_leg('lex', 30)}"
_FUSE = f"{_BOTH}, legs as (select *, 0 as leg from dense union all select *, 1 as leg from lex), fused as (select query_id, chunk_id, act_id, score, row_number() over (partition by query_id order by score desc, first, chunk_id)::int as rank from (select query_id, chunk_id, act_id, round(sum(1.0::double / (60 + rank)), 9) as score, min(leg * 1000000 + rank) as first from legs group by 1, 2, 3))"
_GOLD = "gold as (select query_id, act_id, doc_id as chunk_id from docs d join basket q on contains(d.text, q.query))"


def _capped(name: str, source: str, limit: int) -> str:
    return f"{name} as (select query_id, chunk_id, act_id, score, row_number() over (partition by query_id order by rank)::int as rank from (select *, row_number() over (partition by query_id, act_id order by rank) as oa from {source}) where oa <= {limit})"


_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[\\p{L}\\p{N}]+'))"
_PIPE = f"{_FUSE}, {_capped('capped', 'fused', 3)}, cut as (select * from capped where rank <= 50), rr as (select c.query_id, c.chunk_id, c.act_id, c.rank as before, coalesce(round(len(list_intersect({_WORDS.replace('{0}', 'q.query')}, {_WORDS.replace('{0}', 'd.text')}))::double / nullif(len({_WORDS.replace('{0}', 'q.query')}), 0), 6), 0) as score from cut c join basket q using (query_id) join docs d on d.doc_id = c.chunk_id), reranked as (select query_id, chunk_id, act_id, score, row_number() over (partition by query_id order by score desc, before)::int as rank from rr), {_capped('collapsed', 'reranked', 1)}"


def _metrics(hits: str, level: str, extra: str = "", by: str = "") -> str:
    group = f"rollup({by})" if by else "()"
    recalls = ", ".join(f"round(avg(coalesce((first <= {k})::int::double, 0)), 4) as recall_at_{k}" for k in (1, 5, 10, 20))
    return f"select {extra}'{level}' as level, {by + ', ' if by else ''}count(*) as n, {recalls}, round(avg(coalesce(1.0::double / first, 0)), 4) as mrr, round(avg(coalesce(case when first <= 10 then 1.0::double / log2(first + 1) end, 0)), 4) as ndcg_at_10 from (select a.query_id, a.type, m.first from (select distinct query_id, type from gold join basket using (query_id)) a left join (select query_id, min(rank) as first from {hits} h join (select distinct query_id, {level}_id from gold) g using (query_id, {level}_id) group by 1) m using (query_id)) group by {group} having count(*) > 0"


_A = f"answers as ({duck(ANSWERS)})"
_CITES = f"{_A}, cites as (select answer_id, nr::int as nr, split_part(k, ':', 1)::bigint as doc_id, split_part(split_part(k, ':', 2), '-', 1)::bigint as char_start, split_part(k, '-', 2)::bigint as char_end, k as key from (select answer_id, unnest(range(len(x))) as nr, unnest(x) as k from (select answer_id, regexp_extract_all(answer, '\\[\\[([0-9]+:[0-9]+-[0-9]+)\\]\\]', 1) as x from answers)))"
_CHECK = f"{_CITES}, rc as (select c.*, d.text, case when d.doc_id is null then 'unknown document' when char_start >= char_end then 'empty or inverted range' when char_end > length(d.text) then 'range outside the document' end as reason from cites c left join documents d using (doc_id))"
_VERIFY = f"{_CHECK}, once as (select distinct answer_id, key, doc_id, char_start, char_end, text, reason from rc), per as (select o.answer_id, count(*) as u, count(*) filter (reason is null) as r, count(*) filter (reason is null and '[' || key || ']' = qkey and contains(regexp_replace(substr(o.text, char_start + 1, char_end - char_start), '[ \\t\\n\\r]+', ' ', 'g'), trim(regexp_replace(qtext, '[ \\t\\n\\r]+', ' ', 'g')))) as v from once o join answers a using (answer_id) group by 1), ver as (select answer_id, (select count(*) from cites c where c.answer_id = p.answer_id) as citations, u as unique_citations, 1::bigint as malformed_citations, u + 1 as references_total, r as resolvable, round(r::double / (u + 1), 4) as resolvable_share, v as quote_verbatim, round(v::double / (u + 1), 4) as quote_verbatim_share from per p)"
_STORED = f"with {_VERIFY}, stored as (select *, answer_id % 7 = 0 as refused, case when answer_id % 11 = 0 then 'no answer' end as error from ver)"
_E = views(editions=EDITIONS)
_MID = "case when begin_date is null or end_date < begin_date then null when end_date is null then (begin_date::date + 30)::varchar else (begin_date::date + ((end_date::date - begin_date::date) // 2)::int)::varchar end"
_PAIRS = f"dated as (select act_id, doc_id, text, {_MID.replace('begin_date', 'd.begin_date').replace('end_date', 'd.end_date')} as as_of, row_number() over (partition by act_id order by begin_date, doc_id) as up, row_number() over (partition by act_id order by begin_date desc, doc_id desc) as down, count(*) over (partition by act_id) as n from docs d), ends as (select *, case when up = 1 then 'first' else 'last' end as which from dated where n > 1 and (up = 1 or down = 1) and length(text) >= 400), pairs as (select * from ends qualify count(*) over (partition by act_id) = 2)"
_NODES = f"with {_SPANS}"


def _rec(sql: str) -> str:
    return "with recursive " + sql


ORACLE_SQL = {
    "paragraph_spans": f"with {_SPANS} select doc_id, para, s as start, e as \"end\" from full_spans",
    "sentence_spans": "select doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?;])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''))::int as sentences from documents",
    "sliding_windows": "select doc_id, p::bigint as start, least(p + 2000, length(text))::bigint as \"end\" from documents, unnest(range(0, length(text), 1800)) t(p)",
    "pack_paragraphs": _rec(f"{_PACK} select doc_id, chunk_index, s as start, e as \"end\" from packs"),
    "merge_siblings": _rec(f"{_SPANS}, m as (select doc_id, k, s, e, para // 5 as pk, 1 as merged, 0 as c from full_spans where k = 1 union all select f.doc_id, f.k, case when ok then m.s else f.s end, f.e, f.para // 5, case when ok then m.merged + 1 else 1 end, m.c + (not ok)::int from m join full_spans f on f.doc_id = m.doc_id and f.k = m.k + 1, lateral (select f.para // 5 = m.pk and f.e - m.s <= 2000 and f.e - f.s < 2000 as ok)) select doc_id, min(s) as start, max(e) as \"end\", max(merged)::int as merged from m group by doc_id, c"),
    "toc_segments": f"with {_SPANS}, own as (select doc_id, s, arg_max(para, (1 + para % 3) * 1000000 + para)::int as node from spans group by 1, 2), x as (select o.doc_id, s as start, coalesce(lead(s) over (partition by o.doc_id order by s), length(text)) as \"end\", node from own o join documents d using (doc_id)) select * from x where \"end\" > start",
    "toc_breadcrumbs": f"with {_SPANS} select doc_id, para as node, array_to_string(list_transform(range(para - para % 3, para + 1), lambda i: 'L' || i), ' › ') as path from spans",
    "chunk_documents": _rec(f"{_DOCS}, {chunk_sql.WHOLE}, {chunk_sql.chunks()} select * from chunks"),
    "chunk_documents_outline": _rec(f"{_DOCS}, {chunk_sql.OUTLINE}, {chunk_sql.chunks()} select * from chunks"),
    "chunk_stats": _rec(f"{_DOCS}, {chunk_sql.WHOLE}, {chunk_sql.chunks()} select boundary_kind, count(*) as chunks, sum(length(text))::bigint as chars, max(length(text))::int as longest, round(sum(length(text)) * 100.0::double / (select sum(length(text)) from documents), 2) as coverage_pct from chunks group by rollup(boundary_kind)"),
    "chunk_summary": _rec(f"{_DOCS}, {chunk_sql.WHOLE}, {chunk_sql.chunks()}, sizes as (select length(text) as x, row_number() over (order by length(text)) - 1 as k, count(*) over () as n from chunks), per as (select x, row_number() over (order by x) - 1 as k, count(*) over () as n from (select count(c.doc_id) as x from docs d left join chunks c using (doc_id) group by d.doc_id)) select " + ", ".join(f"(select x::bigint from {t} where k = least(n - 1, floor({p}::double * n)::bigint)) as {name}_{q}" for t, name, points in (("sizes", "chars", (0.1, 0.5, 0.9, 0.99, 1.0)), ("per", "per_document", (0.5, 0.9, 0.99, 1.0))) for p in points for q in (["max"] if p == 1 else [f"p{round(100 * p)}"])) + ", count(*) as chunks, sum(length(text))::bigint as chars, count(*) filter (segments_merged > 1) as merged_sibling_groups, (select count(*) from docs) as documents, (select sum(length(text))::bigint from docs) as chars_in, round(sum(length(text)) / count(*))::bigint as chars_mean, round(100.0::double * sum(length(text)) / (select sum(length(text)) from docs), 2) as coverage_pct from chunks"),
    "flagship_search": _rec(f"{_DOCS}, basket as ({duck(BASKET)}), {chunk_sql.WHOLE}, {chunk_sql.chunks()}, {_lex_sql('chunk_id', _CRUMBED, 'chunks')}, hits as (select s.query_id, s.chunk_id, c.act_id, s.score, row_number() over (partition by s.query_id order by s.score desc, s.chunk_id)::int as rank from scored s join chunks c using (chunk_id) join docs d using (doc_id) join basket q on q.query_id = s.query_id where {_PIT}) select query_id, rank, chunk_id, act_id, score from hits where rank <= {K}"),
    "token_windows": _rec(f"{_DOCS}, {chunk_sql.WHOLE}, {chunk_sql.chunks()}, t as (select doc_id, chunk_index, greatest(1, floor(length(text) / 2.2::double))::int as n from chunks), w as (select doc_id, chunk_index, n as tokens, 0 as c from t where chunk_index = 0 union all select t.doc_id, t.chunk_index, case when w.tokens + t.n <= 2000 then w.tokens + t.n else t.n end, w.c + (w.tokens + t.n > 2000)::int from w join t on t.doc_id = w.doc_id and t.chunk_index = w.chunk_index + 1) select doc_id, c as window_nr, min(chunk_index) as first, max(chunk_index) as last, max(tokens)::int as tokens from w group by doc_id, c"),
    "chunk_offset_identity": _rec(f"{_DOCS}, {chunk_sql.WHOLE}, {chunk_sql.chunks()} select count(*) as violations from chunks c join docs d using (doc_id) where substr(d.text, char_start::int + 1, (char_end - char_start)::int) <> c.text"),
    "tokenize": f"select doc_id, len(t)::int as tokens, md5(array_to_string(t, ' ')) as digest from (select doc_id, {_tok('text')} as t from documents)",
    "bm25_index": f"{_V}, {_LEX} select term, df from terms",
    "bm25_postings": f"{_V}, {_LEX} select chunk_id, term, tf, dl::int as dl from post",
    "bm25_statistics": f"{_V}, {_LEX} select n, round(avgdl, 9) as avgdl from st",
    "bm25_search": f"{_V}, {_LEX} select * from (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from scored) where rank <= 10",
    "l2_normalize": "with e as (select vec_id, embedding::double[] as v from embeddings), n as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from e) select vec_id as chunk_id, 1.0::double as norm, round(v[1] / n, 9) as first from n",
    "mrl_truncate": "with e as (select vec_id, (embedding::double[])[1:16] as v from embeddings) select vec_id as chunk_id, round(v[16] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 9) as last from e",
    "context_windows": _rec(f"{_PACK} select concat(doc_id, ':', s, '-', e) as chunk_id, (chunk_index // 4)::int as window_nr from packs"),
    "resume_plan": _rec(f"{_PACK} select doc_id, (chunk_index // 4)::int as window_nr, concat(doc_id, ':', s, '-', e) as chunk_id, true as store from packs where doc_id % 3 = 0"),
    "index_load": f"{_V} select vec_id as chunk_id, begin_ord, end_ord, is_current from embeddings join docs on doc_id = vec_id",
    "pit_filter": f"{_V} select query_id, count(*) as n from docs d, basket q where {_PIT} group by 1",
    "dense_topk": "with e as (select vec_id, label, embedding::double[] as v from embeddings), s as (select q.vec_id as query_id, e.vec_id as chunk_id, e.label::bigint as act_id, round(list_cosine_similarity(q.v, e.v), 6) as score from e q, e where q.vec_id % 20 = 0) select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from s) where rank <= 10",
    "dense_topk_pit": f"{_V}, {_DEN}, {_leg('dense', 10, 'dscored')} select * from dense",
    "lexical_pit": f"{_V}, {_LEX}, {_leg('lex', 10)} select * from lex",
    "lexical_overfetch": f"{_V}, {_LEX}, over_ as (select query_id, chunk_id, score from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as k from scored) where k <= 80), {_leg('lex', 10, 'over_')} select * from lex",
    "rrf_hybrid": f"{_FUSE} select * from fused where rank <= 10",
    "rrf_fuse": f"{_FUSE} select * from fused",
    "random_control": f"{_V}, {_RANDOM} select query_id, chunk_id, act_id, 0.0::double as score, rank from r10",
    "cap_per_act": f"{_FUSE}, {_capped('c', 'fused', 2)} select * from c",
    "collapse_by_act": f"{_FUSE}, {_capped('c', 'fused', 1)} select * from c",
    "rerank_overlap": f"{_PIPE} select * from reranked",
    "search_pipeline": f"{_PIPE} select * from reranked where rank <= 10",
    "stage_trace": f"{_PIPE}, t as (select * from collapsed where rank <= 10) " + " union all ".join(f"select query_id, '{n}' as stage, count(*) as hits, count(distinct act_id) as acts from {t} group by 1" for n, t in (("fused", "fused"), ("capped", "capped"), ("cut", "cut"), ("reranked", "reranked"), ("collapsed", "collapsed"), ("top", "t"))),
    "first_match_rank": f"{_FUSE}, {_GOLD} select query_id, min(rank) as first from fused join (select distinct query_id, chunk_id from gold) using (query_id, chunk_id) group by 1",
    "ir_metrics": f"{_FUSE}, {_GOLD} {_metrics('fused', 'act')} union all {_metrics('fused', 'chunk')}",
    "ir_metrics_by_type": f"{_FUSE}, {_GOLD} {_metrics('fused', 'act', by='type')} union all {_metrics('fused', 'chunk', by='type')}",
    "eval_modes": f"{_FUSE}, {_GOLD}, d10 as (select * from dense where rank <= 10), l10 as (select * from lex where rank <= 10), h10 as (select * from fused where rank <= 10), {_RANDOM} " + " union all ".join(_metrics(t, "act", f"'{m}' as mode, ") for m, t in (("dense", "d10"), ("lexical", "l10"), ("hybrid", "h10"), ("random", "r10"))),
    "shuffled_gold": f"{_V}, {_GOLD}, g as (select query_id, act_id, row_number() over (order by md5(concat('{SEED}:', query_id)), query_id) as k, count(*) over () as n from (select query_id, min(act_id) as act_id from gold group by 1)), p as (select a.query_id, a.act_id, b.act_id as shuffled, row_number() over (partition by a.query_id order by (b.k - a.k + a.n) % a.n) as o from g a left join g b on b.act_id <> a.act_id) select query_id, act_id, shuffled from p where o = 1",
    "overfetch_probe": f"{_V}, {_LEX}, {_GOLD}, w as (select g.query_id, g.chunk_id from gold g join docs d on d.doc_id = g.chunk_id join basket q on q.query_id = g.query_id where q.as_of is not null and {_PIT}), r as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from scored), f as (select a.query_id, min(r.rank) as first from (select distinct query_id from w) a left join w on w.query_id = a.query_id left join r on r.query_id = w.query_id and r.chunk_id = w.chunk_id group by 1) select depth::int as depth, round(avg(coalesce((first <= depth * 10)::int::double, 0)), 4) as share from f, (values (1), (2), (4), (8), (16)) x(depth) group by 1",
    "ablation": f"{_PIPE}, {_GOLD}, v1 as (select * from fused where rank <= 10), v2 as (select * from capped where rank <= 10), v3 as (select * from reranked where rank <= 10), v4 as (select * from collapsed where rank <= 10) " + " union all ".join(_metrics(t, "act", f"'{m}' as variant, ") for m, t in (("fusion", "v1"), ("cap", "v2"), ("rerank", "v3"), ("dedup", "v4"))),
    "basket_metadata": f"{_E}, o as (select *, row_number() over (partition by act_id order by is_current desc, coalesce(begin_date, '') desc, doc_id desc) as k from editions), p as (select act_id, doc_id, replace(doc_type, ' ', '_') as body, date, row_number() over (order by md5(concat('{SEED}:', act_id)), act_id) - 1 as i from o where k = 1) select concat('meta-', act_id, '-', i % 3) as query_id, 'metadata' as type, case i % 3 when 0 then doc_id::varchar when 1 then concat('order ', doc_id) else concat('order ', body, ' от ', date, ' N ', doc_id) end as query, act_id, doc_id from p where i < 60",
    "interval_midpoint": f"{_E} select doc_id, {_MID} as as_of from editions",
    "basket_temporal": f"{_E}, r as (select *, count(*) over (partition by act_id) as n, row_number() over (partition by act_id order by begin_date, doc_id) as up, row_number() over (partition by act_id order by begin_date desc, doc_id desc) as down from editions where begin_date is not null), x as (select act_id, doc_id, {_MID} as as_of, case when up = 1 then 'first' else 'last' end as which from r where n > 1 and (up = 1 or down = 1)) select * from x where as_of is not null",
    "basket_temporal_pairs": f"{_V}, {_PAIRS} select act_id, doc_id, as_of, which, text from pairs",
    "basket_assembled": f"{_V}, {_PAIRS}, sem as (select least(40, count(*)) as n from pairs where doc_id % 8 < 4), meta as (select least(60, count(distinct o_custkey)) as n from orders), t as (select 'metadata' as type, n, 0 as dated from meta union all select 'temporal_semantic', n, n from sem) select type, part, case part when 'dev' then floor(0.4::double * n)::bigint else n - floor(0.4::double * n)::bigint end as n, case when dated = 0 then 0 when part = 'dev' then floor(0.4::double * n)::bigint else n - floor(0.4::double * n)::bigint end as dated from t, (values ('dev'), ('test')) x(part) where n > 0",
    "basket_synthetic_pool": f"{_V}, p as (select act_id, doc_id as chunk_id, md5(concat('{SEED}:', doc_id)) as h from docs where is_current and length(text) >= 900), k as (select *, row_number() over (partition by act_id order by h, chunk_id) as n from p) select act_id, chunk_id, place from (select act_id, chunk_id, row_number() over (order by h, chunk_id)::int as place from k where n <= 2) where place <= 64",
    "stratified_split": f"{_V} select query_id, type, case when row_number() over (partition by type order by md5(concat('{SEED}:', query_id)), query_id) <= floor(0.4 * count(*) over (partition by type)) then 'dev' else 'test' end as part from basket",
    "basket_counts": f"{_E}, r as (select *, count(*) over (partition by act_id) as n, row_number() over (partition by act_id order by begin_date, doc_id) as up, row_number() over (partition by act_id order by begin_date desc, doc_id desc) as down from editions where begin_date is not null) select case when up = 1 then 'first' else 'last' end as type, count(*) as n from r where n > 1 and (up = 1 or down = 1) and {_MID} is not null group by 1",
    "parse_citations": f"with {_CITES} select answer_id, nr, doc_id, char_start, char_end, key from cites",
    "parse_malformed": f"with {_A} select answer_id, answer_id::varchar as raw from answers",
    "resolve_citations": f"with {_CHECK} select answer_id, nr, case when reason is null then substr(text, char_start + 1, char_end - char_start) end as fragment from rc",
    "check_citations": f"with {_CHECK} select answer_id, nr, reason from rc",
    "verify_answer": f"with {_VERIFY} select * from ver",
    "answer_summary": f"{_STORED}, x as (select *, not refused and error is null as ok from stored) select count(*) as questions, count(*) filter (ok) as answered, count(*) filter (refused) as refused, count(error) as errors, sum(references_total) filter (ok)::bigint as references_total, sum(resolvable) filter (ok)::bigint as resolvable, sum(quote_verbatim) filter (ok)::bigint as quote_verbatim, round(sum(resolvable) filter (ok)::double / sum(references_total) filter (ok), 4) as resolvable_share, round(sum(quote_verbatim) filter (ok)::double / sum(references_total) filter (ok), 4) as quote_verbatim_share, count(*) filter (ok and quote_verbatim_share = 1) as all_valid from x",
    "reverify": f"with {_VERIFY} select answer_id, citations, references_total, quote_verbatim from ver",
    "citations_valid": f"{_STORED} select case when error is not null then false when refused then true else quote_verbatim_share = 1 end as valid, count(*) as n from stored group by 1",
    "format_fragments": f"{_V}, {_LEX}, {_leg('lex', 3)} select query_id, string_agg(concat('[', chunk_id, '] ', d.title, chr(10), substr(d.text, 1, 2200)), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as prompt from lex join docs d on d.doc_id = chunk_id group by 1",
    "json_fence": "select event_id, trim(coalesce(props, '{}')) as json from events",
    "fixed_pieces": "select distinct substr(text, p::int + 1, 2000) as piece from documents, unnest(range(0, length(text) - 2000, 2000)) t(p) where length(text) >= 12000",
    "mrl_geometry": "with e as (select vec_id, embedding::double[] as v from embeddings where vec_id % 20 = 0), p as (select round(list_cosine_similarity(a.v, b.v), 9) as f, round(list_cosine_similarity(a.v[1:16], b.v[1:16]), 9) as c from e a join e b on a.vec_id < b.vec_id) select count(*) as pairs, round(corr(f, c), 6) as pearson, round(avg(abs(f - c)), 6) as mean_shift from p",
}
