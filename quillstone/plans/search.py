"""Lexical and hybrid search over documents and chunks (Q10, Q12, Q14 to Q23, Q31 and the composed templates)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import tables
from quillstone.functions import text as X
from quillstone.operators import fusion, lexical
from quillstone.operators import predicates as P
from quillstone.operators.postings import Postings
from quillstone.operators.vector import nearest
from quillstone.plans import indexes
from quillstone.plans import sql as S
from quillstone.plans.sql import QUERY
from quillstone.runtime import maybe_broadcast

TEXT_QUERY = "negligence insurer premium"
FIELDS = {"content": 2.0, "title": 4.0}
#: Fields of production search and of search over both tables, with their boosts; buckets by name.
PRODUCTION = {"title": 4.0, "citations": 3.0, "content": 2.0, "text_preview": 2.0, "chunk_metadata_text": 1.0}
OF_DOCUMENTS, OF_CHUNKS = {"content": 2.0}, {"content": 1.0, "text_preview": 1.0, "chunk_metadata_text": 1.0}
BUCKETS = ("hca", "cases", "legislation", "journals", "treaties")


def ilike_hits(documents: DataFrame, query: str, top_k: int, escape: bool = True) -> DataFrame:
    """(doc_id, score): documents that contain the query; score 1; the least ids, as there is no other order."""
    return documents.where(X.contains(F.col("content"), query, escape)).orderBy("doc_id").limit(top_k).select("doc_id", F.lit(1.0).alias("score"))


def hybrid_minmax(chunks: DataFrame, documents: DataFrame, vector: Sequence[float], query: str, top_k: int, alpha: float = 0.5) -> DataFrame:
    """Vector hits (2 x top_k chunks) and containment hits (2 x top_k documents) joined by document; distances become
    1 to 0 by least and greatest; a hit without a distance has 0 for it."""
    v = nearest(chunks, vector, 2 * top_k, ["id", "doc_id", "chunk_index"]).where("doc_id is not null").select("doc_id", "chunk_index", F.round("distance", 6).alias("vector_score"))
    b = ilike_hits(documents, query, 2 * top_k).withColumnRenamed("score", "bm25_score")
    merged = fusion.merge(v, b, ["doc_id"])
    norm = F.coalesce(fusion.min_max(F.col("vector_score"), inverse=True), F.lit(0.0))
    out = merged.select("doc_id", F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), "vector_score", F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), norm.alias("vector_score_norm"))
    out = out.withColumn("hybrid_score", F.round(fusion.blend(F.col("vector_score_norm"), F.col("bm25_score"), alpha), 6)).withColumn("vector_score_norm", F.round("vector_score_norm", 6))
    top = out.orderBy(F.desc("hybrid_score"), "doc_id", "chunk_index").limit(top_k)
    return top.join(documents.select("doc_id", "source"), "doc_id", "left").withColumn("citation", X.citation_tag(F.coalesce("source", F.lit("")), F.col("chunk_index"))).drop("source")


def hybrid_percentile(index: Postings, chunks: DataFrame, vector: Sequence[float], query: str, top_k: int, alpha: float = 0.5) -> DataFrame:
    """As above with BM25 instead of containment, similarities instead of distances, and both lists scaled between
    their 5th and 95th percentiles; a missing score counts 0."""
    v = nearest(chunks, vector, 2 * top_k, ["id", "doc_id", "chunk_index"]).where("doc_id is not null").select("doc_id", "chunk_index", (1 - F.col("distance") / 2).alias("v"))
    v = v.withColumn("vector_norm", fusion.percentile_scaled(F.col("v")))
    b = by_document(index.bm25({"content": 1.0}, query)).orderBy(F.desc("score"), "doc_id").limit(2 * top_k)
    b = b.withColumn("bm25_norm", fusion.percentile_scaled(F.col("score"))).select("doc_id", "bm25_norm")
    out = fusion.merge(v.select("doc_id", "chunk_index", "vector_norm"), b, ["doc_id"]).select("doc_id", F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), F.round(F.coalesce("vector_norm", F.lit(0.0)), 6).alias("vector_norm"), F.round(F.coalesce("bm25_norm", F.lit(0.0)), 6).alias("bm25_norm"))
    return out.withColumn("hybrid_score", F.round(fusion.blend(F.col("vector_norm"), F.col("bm25_norm"), alpha), 6)).orderBy(F.desc("hybrid_score"), "doc_id", "chunk_index").limit(top_k)


def best_chunk_rerank(index: Postings, chunks: DataFrame, vector: Sequence[float], query: str, top_k: int, alpha: float = 0.5, candidates: int = 50) -> DataFrame:
    """(doc_id, chunk_index, score): full-text ranks and vector distances, both scaled to [0, 1]; the best chunk of each
    document; alpha of one, the rest of the other."""
    v = nearest(chunks, vector, candidates, ["id", "doc_id", "chunk_index"]).where("doc_id is not null")
    v = v.withColumn("v", fusion.min_max(F.col("distance"), inverse=True))
    v = fusion.best_per(v, ["doc_id"], [F.desc("v"), F.asc("id")]).select("doc_id", "chunk_index", "v")
    f = index.full_text("content", query).select(F.col("key").alias("doc_id"), F.round("rank", 9).alias("rank")).orderBy(F.desc("rank"), "doc_id").limit(candidates)
    f = f.withColumn("f", fusion.min_max(F.col("rank"))).select("doc_id", "f")
    score = fusion.blend(F.coalesce("v", F.lit(0.0)), F.coalesce("f", F.lit(0.0)), alpha)
    return fusion.merge(v, f, ["doc_id"]).select("doc_id", "chunk_index", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(top_k)


def by_document(hits: DataFrame, digits: int = 9) -> DataFrame:
    """(doc_id, score) of hits by key, rounded so that equal scores tie."""
    return hits.select(F.col("key").alias("doc_id"), F.round("score", digits).alias("score"))


def production_search(index: Postings, hits: DataFrame, vectors: DataFrame, documents: DataFrame, vector: Sequence[float] | None, query: str, buckets: Sequence[str] | None = None, top_k: int = 10, rrf_k: int = 60) -> DataFrame:
    """Reciprocal ranks of a lexical list of chunks (PRODUCTION fields) and a vector list, each of max(5 x top_k, 25) of
    the chosen buckets; unknown bucket names are dropped, and none left means all. Statistics are over all chunks; buckets
    only filter. `hits`: tables.hits, `vectors`: (id, vector)."""
    known = [t for t in dict.fromkeys(map(str.lower, buckets or ())) if t in BUCKETS] or list(BUCKETS)
    size = max(5 * top_k, 25)
    inside = hits.where(F.col("prod_bucket").isin(known))
    lex = index.bm25(PRODUCTION, query).select(F.col("key").alias("id"), F.round("score", 9).alias("s"))
    lex = lex.join(inside.select("id"), "id", "left_semi") if len(known) < len(BUCKETS) else lex
    lex = fusion.ranked(lex.orderBy(F.desc("s"), "id").limit(size), [F.desc("s"), F.asc("id")], "lex_rank").select("id", "lex_rank")
    if vector is None:
        fused = fusion.reciprocal_ranks([(lex, "lex_rank")], ["id"], rrf_k).withColumn("vec_rank", F.lit(None).cast("int"))
    else:
        rows = vectors.join(inside.select("id"), "id", "left_semi") if len(known) < len(BUCKETS) else vectors
        vec = fusion.ranked(nearest(rows, vector, size, ["id"]), [F.asc("distance"), F.asc("id")], "vec_rank").select("id", "vec_rank")
        fused = fusion.reciprocal_ranks([(lex, "lex_rank"), (vec, "vec_rank")], ["id"], rrf_k)
    top = fused.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), F.asc_nulls_last("lex_rank"), "id").limit(top_k)
    out = top.join(hits.select("id", "doc_id", "chunk_index", "title", "citations", "prod_bucket", "text_preview"), "id").join(documents.select("doc_id", "url", "source", F.col("content").alias("_c")), "doc_id", "left")
    preview = F.coalesce(F.nullif("text_preview", F.lit("")), F.substring("_c", 1, 500))
    return out.select("id", "doc_id", "chunk_index", "score", "lex_rank", "vec_rank", "title", F.coalesce(F.array_join("citations", "; "), F.lit("")).alias("citations"), "prod_bucket", "url", "source", preview.alias("text_preview"))


def search_both(of_documents: Postings, of_chunks: Postings, hits: DataFrame, documents: DataFrame, query: str, top_k: int = 10) -> DataFrame:
    """(table, key, doc_id, chunk_index, score, text, source, format): the best hits of documents and chunks together, each
    scored in its own table. A chunk without a text of its own is filled from its document."""
    a = of_documents.bm25(OF_DOCUMENTS, query).select(F.lit("documents").alias("table"), "key", F.round("score", 9).alias("score"))
    b = of_chunks.bm25(OF_CHUNKS, query).select(F.lit("chunks").alias("table"), "key", F.round("score", 9).alias("score"))
    top = a.unionByName(b).orderBy(F.desc("score"), F.desc("table"), "key").limit(top_k)
    mine = hits.select(F.lit("chunks").alias("table"), F.col("id").alias("key"), F.col("doc_id").alias("of"), "chunk_index", F.col("content").alias("own"))
    top = top.join(mine, ["table", "key"], "left").withColumn("doc_id", F.when(F.col("table") == "documents", F.col("key")).otherwise(F.col("of")))
    filled = top.join(documents.select("doc_id", "content", "source", "format"), "doc_id", "left")
    return filled.select("table", "key", "doc_id", F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), "score", F.coalesce(F.nullif("own", F.lit("")), "content").alias("text"), "source", "format")


def search_fts(of_documents: Postings, of_chunks: Postings, chunks: DataFrame, documents: DataFrame, query: str, top_k: int = 10, mode: str = "both") -> DataFrame:
    """(dedup_key, doc_id, chunk_index, search_area, snippet): full-text hits in texts (`documents`) and chunk metadata
    (`metadata`), at most 8 x top_k each; one per url of the chunk, or per document without one; in metadata the lowest
    chunk counts; texts come first. Texts are read for the hits only."""
    words = lexical.query_words(query)
    parts = []
    if mode in ("documents", "both"):
        found = of_documents.full_text("content", query).select(F.col("key").alias("doc_id"), F.round("rank", 9).alias("rank")).orderBy(F.desc("rank"), "doc_id").limit(8 * top_k)
        found = documents.select("doc_id", "content").join(F.broadcast(found), "doc_id")
        parts.append(found.select("doc_id", F.lit(0).alias("chunk_index"), F.lit("documents").alias("search_area"), X.highlight(F.col("content"), words).alias("snippet"), F.lit(None).cast("string").alias("url"), F.lit(0).alias("area"), (-F.col("rank")).alias("o")))
    if mode in ("metadata", "both"):
        found = of_chunks.match("chunk_metadata_text", query).select(F.col("key").alias("id"))
        found = chunks.join(found, "id", "left_semi").orderBy("chunk_index", "id").limit(8 * top_k)
        parts.append(found.select("doc_id", "chunk_index", F.lit("metadata").alias("search_area"), X.highlight(F.col("chunk_metadata"), words).alias("snippet"), F.col("md_url").alias("url"), F.lit(1).alias("area"), F.col("chunk_index").cast("double").alias("o")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = out.withColumn("dedup_key", F.coalesce("url", F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.lit("doc")))
    return fusion.best_per(out, ["dedup_key"], [F.asc("area"), F.asc("o"), F.asc("doc_id")]).orderBy("area", "o", "doc_id").limit(top_k).select("dedup_key", "doc_id", "chunk_index", "search_area", "snippet")


def search_fts_index(of_documents: Postings, of_chunks: Postings, chunks: DataFrame, query: str, top_k: int = 10, mode: str = "both") -> DataFrame:
    """(dedup_key, doc_id, chunk_index, search_area, score): the scored variant. The mode chooses the fields: content of
    documents, and chunk_metadata_text, content and text_preview of chunks; 8 x top_k hits of both tables together; of
    each url, or document without one, the best."""
    parts = []
    if mode in ("documents", "both"):
        parts.append(of_documents.bm25({"content": 1.0}, query).select(F.lit("documents").alias("search_area"), "key", F.round("score", 9).alias("score")))
    fields = {"chunk_metadata_text": 1.0, "content": 1.0, "text_preview": 1.0} if mode in ("metadata", "both") else {"content": 1.0}
    if mode in ("metadata", "both"):
        parts.append(of_chunks.bm25(fields, query).select(F.lit("metadata").alias("search_area"), "key", F.round("score", 9).alias("score")))
    top = (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).orderBy(F.desc("score"), F.desc("search_area"), "key").limit(8 * top_k)
    mine = chunks.select(F.lit("metadata").alias("search_area"), F.col("id").alias("key"), F.col("doc_id").alias("of"), "chunk_index", "md_url")
    top = top.join(mine, ["search_area", "key"], "left").withColumn("doc_id", F.when(F.col("search_area") == "documents", F.col("key")).otherwise(F.col("of")))
    top = top.withColumn("dedup_key", F.coalesce("md_url", F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.lit("doc")))
    best = fusion.best_per(top, ["dedup_key"], [F.desc("score"), F.desc("search_area"), F.asc("key")])
    return best.orderBy(F.desc("score"), F.desc("search_area"), "key").limit(top_k).select("dedup_key", "doc_id", "chunk_index", "search_area", "score")


#: Kinds of use cases and the shape of query that each takes.
SHAPES = {"keyword": "all words", "citation": "all words", "legislation": "all words", "case_name": "any word", "natural_language": "any word", "boolean": "boolean", "conceptual": "best of", "semantic": "best of", "precedent": "best of", "fact_pattern": "best of", "argument_based": "best of", "related": "best of", "metadata_filter": "filtered"}
WIDE = {"content": 3.0, "text_preview": 1.0, "chunk_metadata_text": 1.0}


def use_case(index: Postings, chunks: DataFrame, kind: str, query: str, filters: dict[str, object] | None = None, size: int = 10) -> DataFrame:
    """(id, score) of chunks for one use case: its kind gives the shape of the query; unknown kinds take any word.
    `filters`: metadata fields that must have a value, at the top level or inside the metadata; they don't score."""
    shape = SHAPES.get(kind.strip().lower(), "default")
    if shape in ("all words", "any word"):
        out = index.bm25(WIDE, query, "and" if shape == "all words" else "or")
    elif shape == "boolean":
        positive = " ".join(w for w in lexical.Boolean(query).positive())
        met = index.boolean("content", query)
        out = met.join(index.bm25(WIDE, positive), "key", "left").select("key", F.coalesce("score", F.lit(0.0)).alias("score"))
    elif shape == "best of":
        most = index.bm25(WIDE, query, tie=1.0)  # the sum over the fields
        near = index.phrase("content", query, 2).join(index.bm25({"content": 4.0}, query), "key").withColumnRenamed("score", "y")
        both = fusion.merge(most.withColumnRenamed("score", "x"), near, ["key"])
        out = both.select("key", lexical.dis_max([F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))]).alias("score"))
    else:
        out = index.bm25({"content": 2.0, "text_preview": 1.0, "chunk_metadata_text": 1.0}, query)
    out = out.select(F.col("key").alias("id"), F.round("score", 6).alias("score"))
    if filters:
        met = [P.located(k, F.col("chunk_metadata"), chunks.columns) == str(v) for k, v in filters.items()]
        out = out.join(chunks.where(reduce(Column.__and__, met)).select("id"), "id", "left_semi")
    return out.orderBy(F.desc("score"), "id").limit(size)


# queries over the test tables


def q_bm25_ilike(spark, d):
    return ilike_hits(tables.documents(spark, d), "credible easement", 50)


def q_bm25_ranked(spark, d):
    return by_document(indexes.documents(spark, d).bm25({"content": 1.0}, TEXT_QUERY), 5)


def q_multi_match(spark, d):
    return by_document(indexes.documents(spark, d).bm25(FIELDS, "harbour guarantee wharf"), 5)


def q_multi_index(spark, d):
    """Search over documents and chunks together, with texts filled in (Q15, J12)."""
    out = search_both(indexes.documents(spark, d), indexes.chunks(spark, d), tables.hits(spark, d), tables.documents(spark, d), "harbour guarantee wharf", 40)
    return out.select("table", "key", "doc_id", "chunk_index", F.round("score", 5).alias("score"), F.md5("text").alias("text"), "source", "format")


def q_dsl_and_match(spark, d):
    return by_document(indexes.documents(spark, d).bm25({"content": 1.0}, TEXT_QUERY, "and"), 5)


def q_dsl_dis_max(spark, d):
    return by_document(indexes.documents(spark, d).bm25(FIELDS, "harbour guarantee wharf", tie=0.2), 5)


BOOLEAN_QUERY = '(wharf OR "formal dam") AND guarantee NOT railway'
USE_CASES = (("keyword", "harbour wharf", {}), ("case_name", "Re Wharf", {"type": "case"}), ("citation", "BNDT 153", {}), ("boolean", BOOLEAN_QUERY, {}), ("conceptual", "balance probabilities", {}), ("metadata_filter", "levy", {"type": "legislation", "subjurisdiction": "qld"}), ("other", "insurer", {}))


def q_dsl_boolean(spark, d):
    return indexes.documents(spark, d).boolean("content", BOOLEAN_QUERY).select(F.col("key").alias("doc_id"))


def q_dsl_use_cases(spark, d):
    """One case of each shape of query, with its metadata filters (Q31)."""
    index, chunks, out = indexes.chunks(spark, d), tables.embeddings(spark, d), None
    for kind, query, filters in USE_CASES:
        one = use_case(index, chunks, kind, query, filters, 15).select(F.lit(kind).alias("kind"), "id", F.round("score", 5).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def q_phrase_slop(spark, d):
    return indexes.documents(spark, d).phrase("content", "balance probabilities", slop=1).select(F.col("key").alias("doc_id"))


def q_fts_match(spark, d):
    return indexes.documents(spark, d).full_text("content", "the dismissing of appeals").select(F.col("key").alias("doc_id"), F.round("rank", 5).alias("rank"))


def q_fts_single(spark, d):
    return indexes.documents(spark, d).full_text("content", "appeals").select(F.col("key").alias("doc_id"), F.round("rank", 5).alias("rank"))


def q_fts_dedup(spark, d):
    return search_fts(indexes.documents(spark, d), indexes.chunks(spark, d), tables.embeddings(spark, d), tables.documents(spark, d), "harbour wharf", 25).drop("snippet")


def q_fts_index(spark, d):
    return search_fts_index(indexes.documents(spark, d), indexes.chunks(spark, d), tables.embeddings(spark, d), "harbour wharf", 25).withColumn("score", F.round("score", 5))


def q_hybrid_minmax(spark, d):
    return hybrid_minmax(tables.embeddings(spark, d), tables.documents(spark, d), QUERY, "credible easement", 20)


def q_hybrid_percentile(spark, d):
    return hybrid_percentile(indexes.documents(spark, d), tables.embeddings(spark, d), QUERY, TEXT_QUERY, 20)


def q_hybrid_doc_rerank(spark, d):
    return best_chunk_rerank(indexes.documents(spark, d), tables.embeddings(spark, d), QUERY, "negligence insurer", 20)


def q_rrf_fusion(spark, d):
    return production_search(indexes.chunks(spark, d), tables.hits(spark, d), tables.embeddings(spark, d).select("id", "vector"), tables.documents(spark, d), QUERY, "harbour guarantee wharf", ["cases", "Legislation", "nonsense"], 20)


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = tables.documents(spark, d)
    v = nearest(tables.embeddings(spark, d), QUERY, 30, ["id", "doc_id"]).where("doc_id is not null").groupBy("doc_id").agg(F.max(1 - F.col("distance")).alias("score"))
    return v.select("doc_id", F.round("score", 6).alias("score")), ilike_hits(documents, "credible easement", 30)


def q_chat_union_avg(spark, d):
    v, b = _lists(spark, d)
    return fusion.union_mean(v, b, ["doc_id"]).select("doc_id", F.round("score", 6).alias("score"))


def q_chat_union_first(spark, d):
    v, b = _lists(spark, d)
    return fusion.union_first([b, v], ["doc_id"], [F.desc("score")])


def q_rerank_topn(spark, d):
    top = nearest(tables.embeddings(spark, d), QUERY, 20, ["id", "doc_id", "chunk_index"])
    return top.select("id", "doc_id", F.round(1 - F.col("distance"), 6).alias("score"), F.lit("none").alias("reranker")).orderBy(F.desc("score"), "id").limit(5)


def q_related_terms(spark, d):
    """Documents that share citations with the chunks of one document, most shared first."""
    chunks = tables.embeddings(spark, d).where("doc_id is not null").select("doc_id", F.explode("md_citations").alias("c")).select("doc_id", F.lower("c").alias("c")).distinct()
    anchor = chunks.agg(F.min("doc_id").alias("a"))
    own = chunks.join(F.broadcast(anchor), F.col("doc_id") == F.col("a"), "left_semi").select("c")
    return chunks.join(maybe_broadcast(own), "c", "left_semi").join(F.broadcast(anchor), F.col("doc_id") == F.col("a"), "left_anti").groupBy("doc_id").agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), "doc_id")


def q_filtered_boolean_query(spark, d):
    """must, filter, must_not and should in one condition over chunks."""
    chunks = tables.embeddings(spark, d)
    c = P.boolean(must=[F.col("md_type") == "case"], should=[F.col("md_title_lc").contains("wharf"), F.col("md_title_lc").contains("estate")], must_not=[F.col("md_subjurisdiction") == "nsw"], filters=[F.col("md_date") >= F.to_date(F.lit("2000-01-01"))], minimum_should_match=1)
    return chunks.where(c).select("id", "doc_id", "md_title")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__[2:]: f for f in (q_bm25_ilike, q_bm25_ranked, q_multi_match, q_multi_index, q_dsl_and_match, q_dsl_dis_max, q_dsl_boolean, q_dsl_use_cases, q_phrase_slop, q_fts_match, q_fts_single, q_fts_dedup, q_fts_index, q_hybrid_minmax, q_hybrid_percentile, q_hybrid_doc_rerank, q_rrf_fusion, q_chat_union_avg, q_chat_union_first, q_rerank_topn, q_related_terms, q_filtered_boolean_query)}


_bm25_sql = S.bm25
_DIST = f"1 - list_cosine_similarity(cast(vector as double[]), {S.QUERY_SQL})"
_NEAR = f"near as (select id, doc_id, chunk_index, {_DIST} as dist from emb where {S.USABLE})"
_HITS = "hits as (select doc_id, 1.0::double as score from documents where text ilike '%credible easement%' order by doc_id limit {n})"
_PERCENTILE = "case when count({v}) over () < 3 or quantile_cont({v}, 0.95) over () <= quantile_cont({v}, 0.05) over () then (case when max({v}) over () > min({v}) over () then ({v} - min({v}) over ()) / (max({v}) over () - min({v}) over ()) when {v} > 0 then 1.0 else 0.0 end) else (least(greatest({v}, quantile_cont({v}, 0.05) over ()), quantile_cont({v}, 0.95) over ()) - quantile_cont({v}, 0.05) over ()) / (quantile_cont({v}, 0.95) over () - quantile_cont({v}, 0.05) over ()) end"
_CHAT = f"with {S.EMB}, {_NEAR}, v as (select doc_id, round(max(1 - dist), 6) as score from (select * from near order by dist, id limit 30) where doc_id is not null group by doc_id), {_HITS.format(n=30)}"
_DOC_WORDS = f"with w as (select doc_id, {S.words(chr(99) + 'oalesce(text, chr(32))')} as w from documents)"


_APPEAL = S.forms("appeal", "appeals", "appealed", "appealing")
_DISMISS = S.forms("dismiss", "dismisses", "dismissed", "dismissing", "dismissal", "dismissals")
_FTS = S.full_text("text", "documents", "doc_id", _DISMISS, _APPEAL)
_RERANK_FTS = S.full_text("text", "documents", "doc_id", S.forms("negligence", "neglig", "negligent", "negligently"), S.forms("insurer", "insurers", "insure", "insured", "insures", "insuring"))
_HARBOUR, _WHARF = S.forms("harbour", "harbours", "harboured", "harbouring"), S.forms("wharf", "wharfs")
_WIDE = {"content": 3.0, "text_preview": 1.0, "chunk_metadata_text": 1.0}


def _cases_sql() -> str:
    """One SELECT for each of USE_CASES, as shapes demand."""
    kept = "(select h.*, json_extract_string(chunk_metadata_text, '$.type') as m_type, json_extract_string(chunk_metadata_text, '$.subjurisdiction') as m_sub from hits h)"
    parts, ctes = [], [S.EMB, S.HITS]
    best = "select '{k}' as kind, id, round(score, 5) as score from (select id, round(score, 6) as score from {n} order by round(score, 6) desc, id limit 15)"
    words = "(select id, " + S.words("coalesce(content, '')") + " as w from hits)"
    ctes.append(_bm25_sql(_WIDE, "harbour wharf", "and", name="c0", table="hits", key="id"))
    ctes.append(_bm25_sql(_WIDE, "Re Wharf", name="c1", table=kept, key="id", where="m_type = 'case'"))
    ctes.append(_bm25_sql(_WIDE, "BNDT 153", "and", name="c2", table="hits", key="id"))
    ctes.append(_bm25_sql(_WIDE, "wharf formal dam guarantee", name="b3", table="hits", key="id"))
    ctes.append(f"c3 as (select w.id, coalesce(score, 0) as score from {words} w left join b3 using (id) where (list_contains(w, 'wharf') or {S.in_order('w', 'formal', 'dam')}) and list_contains(w, 'guarantee') and not list_contains(w, 'railway'))")
    ctes.append(_bm25_sql(_WIDE, "balance probabilities", tie=1.0, name="x4", table="hits", key="id"))
    ctes.append(_bm25_sql({"content": 4.0}, "balance probabilities", name="y4", table="hits", key="id"))
    ctes.append(f"z4 as (select id, score as y from y4 where id in (select id from {words} where {S.in_order('w', 'balance', 'probabilities', slop=2)}))")
    ctes.append("c4 as (select id, greatest(coalesce(x, 0), coalesce(y, 0)) + 0.2 * least(coalesce(x, 0), coalesce(y, 0)) as score from (select id, score as x from x4) full join z4 using (id))")
    ctes.append(_bm25_sql({"content": 2.0, "text_preview": 1.0, "chunk_metadata_text": 1.0}, "levy", name="c5", table=kept, key="id", where="m_type = 'legislation' and m_sub = 'qld'"))
    ctes.append(_bm25_sql({"content": 2.0, "text_preview": 1.0, "chunk_metadata_text": 1.0}, "insurer", name="c6", table="hits", key="id"))
    parts = [best.format(k=kind, n=f"c{i}") for i, (kind, _, _) in enumerate(USE_CASES)]
    return "with " + ", ".join(ctes) + " " + " union all ".join(parts)


ORACLES: dict[str, str] = {
    "bm25_ilike": f"with {_HITS.format(n=50)} select * from hits",
    "bm25_ranked": f"with {_bm25_sql({'content': 1.0}, TEXT_QUERY)} select doc_id, round(score, 5) as score from bm25",
    "multi_match": f"with {_bm25_sql(FIELDS, 'harbour guarantee wharf')} select doc_id, round(score, 5) as score from bm25",
    "dsl_and_match": f"with {_bm25_sql({'content': 1.0}, TEXT_QUERY, 'and')} select doc_id, round(score, 5) as score from bm25",
    "dsl_dis_max": f"with {_bm25_sql(FIELDS, 'harbour guarantee wharf', tie=0.2)} select doc_id, round(score, 5) as score from bm25",
    "dsl_boolean": _DOC_WORDS + " select doc_id from w where (list_contains(w, 'wharf') or contains(' ' || array_to_string(w, ' ') || ' ', ' formal dam ')) and list_contains(w, 'guarantee') and not list_contains(w, 'railway')",
    "phrase_slop": _DOC_WORDS + " select doc_id from w where regexp_matches(' ' || array_to_string(w, ' ') || ' ', ' balance (?:[^ ]+ )?probabilities ')",
    "fts_match": f"with {_FTS} select doc_id, round(rank, 5) as rank from fts",
    "fts_single": f"with {S.full_text('text', 'documents', 'doc_id', _APPEAL)} select doc_id, round(rank, 5) as rank from fts",
    "fts_dedup": f"""with {S.EMB}, {S.full_text('text', 'documents', 'doc_id', _HARBOUR, _WHARF, name='f')}, {S.full_text('chunk_metadata', 'chunk_embeddings', 'id', _HARBOUR, _WHARF, name='g')},
a as (select 'doc' || doc_id as dedup_key, doc_id, 0 as chunk_index, 'documents' as search_area, 0 as area, -round(rank, 9) as o from f order by o, doc_id limit 200),
b as (select coalesce(md_url, 'doc' || doc_id, 'doc') as dedup_key, doc_id, chunk_index, 'metadata' as search_area, 1 as area, cast(chunk_index as double) as o, id from g join emb using (id) order by chunk_index, id limit 200),
u as (select * from a union all select * exclude (id) from b)
select dedup_key, doc_id, chunk_index, search_area from u qualify row_number() over (partition by dedup_key order by area, o, doc_id) = 1 order by area, o, doc_id limit 25""",
    "fts_index": f"""with {S.EMB}, {S.HITS}, {_bm25_sql({'content': 1.0}, 'harbour wharf', name='a')}, {_bm25_sql({'chunk_metadata_text': 1.0, 'content': 1.0, 'text_preview': 1.0}, 'harbour wharf', name='b', table='hits', key='id')},
top as (select * from (select 'documents' as search_area, doc_id as key, round(score, 9) as score from a union all select 'metadata', id, round(score, 9) from b) order by score desc, search_area desc, key limit 200),
named as (select top.*, e.chunk_index, case when search_area = 'documents' then key else e.doc_id end as doc_id, e.md_url from top left join emb e on search_area = 'metadata' and e.id = key)
select coalesce(md_url, 'doc' || doc_id, 'doc') as dedup_key, doc_id, chunk_index, search_area, round(score, 5) as score from named qualify row_number() over (partition by coalesce(md_url, 'doc' || doc_id, 'doc') order by score desc, search_area desc, key) = 1 order by named.score desc, search_area desc, key limit 25""",
    "multi_index": f"""with {S.EMB}, {S.HITS}, {_bm25_sql({'content': 2.0}, 'harbour guarantee wharf', name='a')}, {_bm25_sql({'content': 1.0, 'text_preview': 1.0, 'chunk_metadata_text': 1.0}, 'harbour guarantee wharf', name='b', table='hits', key='id')},
top as (select * from (select 'documents' as "table", doc_id as key, round(score, 9) as score from a union all select 'chunks', id, round(score, 9) from b) order by score desc, "table" desc, key limit 40),
named as (select top.*, case when "table" = 'documents' then key else h.doc_id end as doc_id, coalesce(h.chunk_index, 0) as chunk_index, h.content as own from top left join hits h on "table" = 'chunks' and h.id = key)
select "table", key, named.doc_id, chunk_index, round(score, 5) as score, md5(coalesce(nullif(own, ''), text)) as text, source, format from named left join documents using (doc_id)""",
    "dsl_use_cases": _cases_sql(),
    "hybrid_minmax": f"""with {S.EMB}, {_NEAR}, v as (select doc_id, chunk_index, round(dist, 6) as vector_score from (select * from near order by dist, id limit 40) where doc_id is not null), {_HITS.format(n=40)},
merged as (select coalesce(v.doc_id, h.doc_id) as doc_id, coalesce(chunk_index, 0) as chunk_index, vector_score, coalesce(h.score, 0.0) as bm25_score from v full join hits h on v.doc_id = h.doc_id),
normed as (select *, coalesce(case when vector_score is null then null when max(vector_score) over () = min(vector_score) over () then 1.0 else (max(vector_score) over () - vector_score) / (max(vector_score) over () - min(vector_score) over ()) end, 0.0) as n from merged),
scored as (select doc_id, chunk_index, vector_score, bm25_score, round(n, 6) as vector_score_norm, round(0.5 * n + 0.5 * bm25_score, 6) as hybrid_score from normed order by hybrid_score desc, doc_id, chunk_index limit 20)
select scored.*, coalesce(source, '') || '#chunk' || chunk_index as citation from scored left join documents using (doc_id)""",
    "hybrid_percentile": f"""with {S.EMB}, {_NEAR}, {_bm25_sql({'content': 1.0}, TEXT_QUERY)},
v as (select doc_id, chunk_index, 1 - dist / 2 as s from (select * from near order by dist, id limit 40) where doc_id is not null), vn as (select doc_id, chunk_index, {_PERCENTILE.format(v='s')} as vector_norm from v),
b as (select doc_id, round(score, 9) as s from bm25 order by round(score, 9) desc, doc_id limit 40), bn as (select doc_id, {_PERCENTILE.format(v='s')} as bm25_norm from b),
merged as (select coalesce(vn.doc_id, bn.doc_id) as doc_id, coalesce(chunk_index, 0) as chunk_index, round(coalesce(vector_norm, 0.0), 6) as vector_norm, round(coalesce(bm25_norm, 0.0), 6) as bm25_norm from vn full join bn on vn.doc_id = bn.doc_id)
select *, round(0.5 * vector_norm + 0.5 * bm25_norm, 6) as hybrid_score from merged order by hybrid_score desc, doc_id, chunk_index limit 20""",
    "hybrid_doc_rerank": f"""with {S.EMB}, {_NEAR}, {_RERANK_FTS},
v as (select *, case when max(dist) over () = min(dist) over () then 1.0 else (max(dist) over () - dist) / (max(dist) over () - min(dist) over ()) end as v from (select * from near order by dist, id limit 50) where doc_id is not null),
vb as (select doc_id, chunk_index, v from (select *, row_number() over (partition by doc_id order by v desc, id) as r from v) where r = 1),
f as (select doc_id, round(rank, 9) as rank from fts order by round(rank, 9) desc, doc_id limit 50),
fn as (select doc_id, case when max(rank) over () = min(rank) over () then 1.0 else (rank - min(rank) over ()) / (max(rank) over () - min(rank) over ()) end as f from f)
select coalesce(vb.doc_id, fn.doc_id) as doc_id, chunk_index, round(0.5 * coalesce(v, 0) + 0.5 * coalesce(f, 0), 6) as score from vb full join fn on vb.doc_id = fn.doc_id order by score desc, 1 limit 20""",
    "rrf_fusion": f"""with {S.EMB}, {S.HITS}, {_bm25_sql({'title': 4.0, 'cited': 3.0, 'content': 2.0, 'text_preview': 2.0, 'chunk_metadata_text': 1.0}, 'harbour guarantee wharf', table='hits', key='id', where="prod_bucket in ('cases', 'legislation')")},
lex as (select id, row_number() over (order by round(score, 9) desc, id) as lex_rank from bm25 qualify lex_rank <= 100),
vec as (select id, row_number() over (order by dist, id) as vec_rank from (select id, {_DIST} as dist from emb join (select id as i, prod_bucket from hits) on i = id where {S.USABLE} and prod_bucket in ('cases', 'legislation')) qualify vec_rank <= 100),
fused as (select id, lex_rank, vec_rank, round(coalesce(1 / (60 + lex_rank), 0) + coalesce(1 / (60 + vec_rank), 0), 9) as score from lex full join vec using (id) order by score desc, lex_rank nulls last, id limit 20)
select id, doc_id, chunk_index, score, cast(lex_rank as integer) as lex_rank, cast(vec_rank as integer) as vec_rank, title, coalesce(array_to_string(citations, '; '), '') as citations, prod_bucket, url, source, coalesce(nullif(text_preview, ''), substr(whole, 1, 500)) as text_preview from fused join hits using (id)""",
    "chat_union_avg": _CHAT + " select coalesce(v.doc_id, hits.doc_id) as doc_id, round(case when v.score is not null and hits.score is not null then (v.score + hits.score) / 2 else coalesce(v.score, hits.score) end, 6) as score from v full join hits on v.doc_id = hits.doc_id",
    "chat_union_first": _CHAT + " select doc_id, score from hits union all select doc_id, score from v where doc_id not in (select doc_id from hits)",
    "rerank_topn": f"with {S.EMB}, {_NEAR} select id, doc_id, round(1 - dist, 6) as score, 'none' as reranker from (select * from near order by dist, id limit 20) order by round(1 - dist, 6) desc, id limit 5",
    "related_terms": f"with {S.EMB}, c as (select distinct doc_id, lower(unnest(md_citations)) as c from emb where doc_id is not null), a as (select min(doc_id) as a from c) select doc_id, count(*) as shared from c where c in (select c from c where doc_id = (select a from a)) and doc_id <> (select a from a) group by doc_id",
    "filtered_boolean_query": f"with {S.EMB} select id, doc_id, md_title from emb where md_type = 'case' and md_date >= date '2000-01-01' and (contains(md_title_lc, 'wharf') or contains(md_title_lc, 'estate')) and not coalesce(md_subjurisdiction = 'nsw', false)",
}
