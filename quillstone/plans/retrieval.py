"""Metadata, fuzzy and vector search over chunks (templates Q1 to Q13 and Q24), with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone import tables
from quillstone.functions import text as X
from quillstone.functions import vectors as V
from quillstone.operators import predicates as P
from quillstone.operators.fusion import best_per
from quillstone.operators.vector import nearest, nearest_two_phase
from quillstone.plans import indexes
from quillstone.plans import sql as S
from quillstone.plans.sql import QUERY
from quillstone.runtime import table

NEWEST = F.desc_nulls_first


def cases_by_citation(chunks: DataFrame, documents: DataFrame, citations: Sequence[str]) -> DataFrame:
    """Documents of type case that carry one of the citations (compared in lower case), newest first; dates that are
    null come first. case_name joins all distinct titles of the document's chunks."""
    wanted = [c.lower() for c in citations]
    hit = F.coalesce(F.exists("md_citations", lambda c: F.lower(c).isin(wanted)), F.lit(False)) | F.coalesce(F.lower("md_citation").isin(wanted), F.lit(False))
    matched = chunks.where((F.col("md_type") == "case") & hit).select("doc_id").distinct()
    per = chunks.join(matched, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.max("md_jurisdiction").alias("jurisdiction"), F.max("md_date").alias("case_date"), F.max("md_database").alias("court"),
        F.min(F.coalesce("md_citation", F.array_min("md_citations"))).alias("citation"),
        F.array_join(F.array_sort(F.collect_set("md_title")), "; ").alias("case_name"),
    )
    out = per.join(documents.select("doc_id", "url"), "doc_id").select("doc_id", "url", "jurisdiction", "case_date", "court", "citation", "case_name")
    return out.orderBy(NEWEST("case_date"), "doc_id")


def by_title(chunks: DataFrame, documents: DataFrame, query: str, types: Sequence[str] | None = None, jurisdiction: str | None = None, database: str | None = None, year: int | None = None, shortlist: int | None = 1000, limit: int | None = None, per_document: bool = True, threshold: float = P.TRIGRAM_LIMIT) -> DataFrame:
    """(doc_id, url, md_type, md_jurisdiction, md_database, md_year, md_date, title, score): chunks whose title is similar
    to the query by trigrams; at most `shortlist` chunks by score, then newest; then the best chunk of each document."""
    f = P.Filters(types=types, jurisdiction=jurisdiction, database=database, year=year)
    rows = P.where(chunks, f).select("id", "doc_id", "md_type", "md_jurisdiction", "md_database", "md_year", "md_date", F.col("md_title").alias("title"), F.round(X.similarity(F.col("md_title_lc"), query), 6).alias("score")).where(F.col("score") >= threshold)
    order = [F.desc("score"), NEWEST("md_date"), F.asc("id")]
    if shortlist is not None:
        rows = rows.orderBy(*order).limit(shortlist)
    if per_document:
        rows = best_per(rows, ["doc_id"], order)
    out = rows.join(documents.select("doc_id", "url"), "doc_id").orderBy(*order)
    out = out if limit is None else out.limit(limit)
    return out.select("doc_id", "url", "md_type", "md_jurisdiction", "md_database", "md_year", "md_date", "title", "score")


def cases_by_name_lev(chunks: DataFrame, documents: DataFrame, name: str, max_dist: int = 3, jurisdiction: str | None = None, year: int | None = None, court: str | None = None) -> DataFrame:
    """Cases with a title at an edit distance below `max_dist` from the name, or equal to it but for case, with all
    distinct titles of the document; nearest first, then newest."""
    f = P.Filters(type="case", jurisdiction=jurisdiction, year=year, database=court)
    near = P.where(chunks, f).withColumn("distance", F.levenshtein(F.col("md_title_lc"), F.lit(name.lower()))).where((F.col("distance") < max_dist) | (F.col("md_title_lc") == name.lower()))
    per = near.groupBy("doc_id", "md_jurisdiction", "md_date", "md_database").agg(F.min("distance").alias("distance"))
    titles = chunks.join(near.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("md_title")), "; ").alias("case_name"))
    out = per.join(titles, "doc_id").join(documents.select("doc_id", "url"), "doc_id")
    return out.select("doc_id", "url", F.col("md_jurisdiction").alias("jurisdiction"), F.col("md_date").alias("case_date"), F.col("md_database").alias("court"), "case_name", "distance").orderBy("distance", NEWEST("case_date"), "doc_id")


def ann_filters_postfilter(chunks: DataFrame, documents: DataFrame, query: Sequence[float], top_k: int, before: P.Filters, title: str | None = None, source: str | None = None) -> DataFrame:
    """The top_k nearest chunks of those that meet `before`; of these, those whose title and source are similar. So
    fewer than top_k may come out; put title_approx and source_approx into `before` for the other order."""
    keep = ["id", "doc_id", "chunk_index", "md_type", "md_database", "md_jurisdiction", "md_date", "md_year", "md_title", "md_title_lc"]
    top = nearest(P.where(chunks, before, documents), query, top_k, keep).join(documents.select("doc_id", "url", "source"), "doc_id")
    if title is not None:
        top = top.where(P.approx(F.col("md_title_lc"), title))
    if source is not None:
        top = top.where(P.approx(F.lower("source"), source))
    return top.select("id", "doc_id", "chunk_index", F.round("distance", 6).alias("distance"), "url", "md_type", F.col("md_database").alias("court"), "md_jurisdiction", "md_date", "md_year", F.col("md_title").alias("title"))


def source_approx(documents: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Documents whose source is similar to the query. Each distinct source is compared once."""
    scores = documents.select("source").distinct().withColumn("score", F.round(X.similarity(F.lower("source"), query.lower()), 6)).where(F.col("score") >= P.TRIGRAM_LIMIT)
    return documents.join(scores, "source").select("doc_id", "url", "source", "score").orderBy(F.desc("score"), "doc_id").limit(limit)


# queries over the test tables

NAME, ACT, CITATIONS = "re quillethwenn", "wharf levy act", ("[2010] bndt 153", "[1988] HBRT 1183", "[2014] MLTA 215")


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tables.embeddings(spark, d), tables.documents(spark, d)


def q_cases_by_citation(spark, d):
    return cases_by_citation(*_both(spark, d), CITATIONS)


def q_cases_by_name_trgm(spark, d):
    return by_title(*_both(spark, d), NAME, types=["case"], jurisdiction="au")


def q_cases_by_name_lev(spark, d):
    chunks, documents = _both(spark, d)
    ascii_only = chunks.withColumn("md_title_lc", F.regexp_replace("md_title_lc", "[^ -~]", ""))
    return cases_by_name_lev(ascii_only, documents, "Sulritro v Nimburburro", max_dist=9)


def q_legislation_title_trgm(spark, d):
    return by_title(*_both(spark, d), ACT, types=["legislation"], shortlist=None, limit=50, per_document=False)


def q_types_title_trgm(spark, d):
    return by_title(*_both(spark, d), ACT, types=["legislation", "treaty", "journal"], shortlist=None, limit=20)


def q_title_search_doc_group(spark, d):
    return by_title(*_both(spark, d), "harbour", shortlist=500, limit=20, threshold=0.2)


def q_source_approx(spark, d):
    return source_approx(tables.documents(spark, d), "Harbour Ruling", 100)


def q_vector_topk(spark, d):
    chunks, documents = _both(spark, d)
    top = nearest(chunks, QUERY, 25, ["id", "doc_id", "chunk_index"])
    return top.join(documents, "doc_id").select("id", "doc_id", "chunk_index", F.round("distance", 6).alias("distance"), "source", X.preview(F.col("content"), 80).alias("text"), "format")


def q_vector_filtered(spark, d):
    chunks, documents = _both(spark, d)
    f = P.Filters(type="case", jurisdiction="au", date_from="1985-01-01", date_to="2015-12-31", both_dates=True, source_approx="harbour rulings")
    return nearest(P.where(chunks, f, documents), QUERY, 20, ["id", "doc_id", "chunk_index"]).withColumn("distance", F.round("distance", 6))


def q_metadata_filter(spark, d):
    chunks, _ = _both(spark, d)
    f = P.Filters(type="legislation", subjurisdiction="qld", title_approx="levy act")
    return P.where(chunks, f).orderBy("id").limit(100).select("id", "doc_id", "chunk_index", "md_title")


def q_metadata_filter_json(spark, d):
    """Equalities in the column or in the metadata; a third of the rows lose their columns first."""
    chunks, _ = _both(spark, d)
    for c in ("md_type", "md_database", "md_year"):
        chunks = chunks.withColumn(c, F.when(F.col("id") % 3 != 0, F.col(c)))
    f = P.Filters(type="case", database="HCVR", year=1993, in_json=True)
    return P.where(chunks, f).orderBy("id").limit(100).select("id", "doc_id", "chunk_index")


def q_citation_member(spark, d):
    chunks, _ = _both(spark, d)
    return P.where(chunks, P.Filters(citation_member="[2018] hbrt 402")).select("id", "doc_id", "md_type")


def q_ann_filters_postfilter(spark, d):
    chunks, documents = _both(spark, d)
    return ann_filters_postfilter(chunks, documents, QUERY, 200, P.Filters(types=["case", "journal"], date_from="1990-01-01"), title="re wharf pty ltd", source=None)


def q_ann_source_postfilter(spark, d):
    chunks, documents = _both(spark, d)
    return ann_filters_postfilter(chunks, documents, QUERY, 200, P.Filters(date_from="1990-01-01"), title=None, source="harbour rulings")


def q_all_predicates(spark, d):
    """Each of the fifteen predicates by itself, over chunks that carry all fields: how many rows meet it."""
    e = table(spark, d, "chunk_embeddings")
    more = F.concat(F.lit(', "author": "Author '), F.col("id") % 5, F.lit('", "citation": "C '), F.col("id") % 7, F.lit('", "countries": ["Land '), F.col("id") % 3, F.lit('"], "titles": ["Name '), F.col("id") % 4, F.lit('", "x"]}'))
    full = F.concat(F.expr("substring(chunk_metadata, 1, length(chunk_metadata) - 1)"), more)
    chunks = tables.with_metadata(e.where("chunk_metadata is not null").withColumn("chunk_metadata", full))
    documents = tables.documents(spark, d)
    one = {"type": "case", "jurisdiction": "au", "subjurisdiction": "nsw", "database": "HCVR", "year": 1993, "title": "Minor dismissal", "author": "Author 2", "citation": "C 3", "country_member": "LAND 1", "title_member": "name 2", "citation_member": "[2018] hbrt 402", "author_approx": "author 2", "title_approx": "re wharf", "source_approx": "harbour rulings"}
    out = None
    for name, f in {**{k: P.Filters(**{k: v}) for k, v in one.items()}, "dates": P.Filters(date_from="1990-01-01", date_to="1999-12-31", both_dates=True), "one_date": P.Filters(date_from="1990-01-01", both_dates=True)}.items():
        n = P.where(chunks, f, documents).agg(F.lit(name).alias("predicate"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


def q_two_phase_refine(spark, d):
    """Candidates from the lists of the vector index, joined back and ranked exactly."""
    chunks, _ = _both(spark, d)
    return nearest_two_phase(indexes.vectors(spark, d), chunks, QUERY, 20, ["id", "doc_id", "chunk_index"]).withColumn("distance", F.round("distance", 6))


def q_ann_exact_lists(spark, d):
    """The same over all lists."""
    index, (chunks, _) = indexes.vectors(spark, d), _both(spark, d)
    return nearest_two_phase(index, chunks, QUERY, 20, ["id", "doc_id", "chunk_index"], probes=len(index.centroids)).withColumn("distance", F.round("distance", 6))


def q_knn_score(spark, d):
    """The score of every usable chunk."""
    chunks, _ = _both(spark, d)
    rows = chunks.where(V.usable(F.col("vector"), 64))
    return rows.select("id", F.round(V.knn_score(F.col("vector"), V.literal(QUERY)), 6).alias("score"), F.round(V.negative_inner_product(F.col("vector"), V.literal(QUERY)), 4).alias("neg_dot"))


def q_latest_chunk_per_document(spark, d):
    """The newest stored version of each chunk; of equal times the largest id."""
    chunks, _ = _both(spark, d)
    newest = Window.partitionBy("doc_id", "chunk_index").orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
    return chunks.where("doc_id is not null").select("id", "doc_id", "chunk_index", F.row_number().over(newest).alias("r")).where("r = 1").select("id", "doc_id", "chunk_index")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__[2:]: f for f in (q_vector_topk, q_vector_filtered, q_metadata_filter, q_metadata_filter_json, q_citation_member, q_cases_by_citation, q_cases_by_name_trgm, q_cases_by_name_lev, q_legislation_title_trgm, q_types_title_trgm, q_title_search_doc_group, q_source_approx, q_ann_filters_postfilter, q_ann_source_postfilter, q_all_predicates, q_two_phase_refine, q_ann_exact_lists, q_knn_score, q_latest_chunk_per_document)}


def _title_sql(query: str, condition: str, shortlist: int | None, limit: int | None, per_document: bool, threshold: float = 0.3) -> str:
    short = f"order by score desc, md_date desc nulls first, id limit {shortlist}" if shortlist else ""
    one = "where r = 1" if per_document else ""
    return f"""with {S.EMB},
scored as (select id, doc_id, md_type, md_jurisdiction, md_database, md_year, md_date, md_title as title, round({S.similarity("md_title_lc", query)}, 6) as score from emb where {condition}),
short as (select * from scored where score >= {threshold} {short}),
best as (select * from (select *, row_number() over (partition by doc_id order by score desc, md_date desc nulls first, id) as r from short) {one})
select doc_id, url, md_type, md_jurisdiction, md_database, md_year, md_date, best.title, score from best join documents using (doc_id)
order by score desc, md_date desc nulls first, id {f"limit {limit}" if limit else ""}"""


_CITED = "[" + ", ".join(f"'{c.lower()}'" for c in CITATIONS) + "]"
_TITLES = "string_agg(distinct md_title, '; ' order by md_title)"
_NEAREST = f"with {S.EMB}, {S.VEC} select id, doc_id, chunk_index, distance from vec order by 1 - list_cosine_similarity(cast(vector as double[]), {S.QUERY_SQL}), id limit 20"
_PREDICATES = {
    "type": "md_type = 'case'", "jurisdiction": "md_jurisdiction = 'au'", "subjurisdiction": "md_subjurisdiction = 'nsw'", "database": "md_database = 'HCVR'", "year": "md_year = 1993",
    "title": "md_title = 'Minor dismissal'", "author": "id % 5 = 2", "citation": "id % 7 = 3", "country_member": "id % 3 = 1", "title_member": "id % 4 = 2",
    "citation_member": "list_contains(list_transform(md_citations, lambda c: lower(c)), '[2018] hbrt 402')", "author_approx": S.similarity("'author ' || (id % 5)", "author 2") + " >= 0.3", "title_approx": S.similarity("md_title_lc", "re wharf") + " >= 0.3",
    "source_approx": f"doc_id in (select doc_id from documents where {S.similarity('lower(source)', 'harbour rulings')} >= 0.3)", "dates": "md_date between date '1990-01-01' and date '1999-12-31'", "one_date": "true",
}
ORACLES: dict[str, str] = {
    "all_predicates": f"with {S.EMB}, e as (select * from emb where chunk_metadata is not null) " + " union all ".join(f"select '{k}' as predicate, count(*) as n from e where {c}" for k, c in _PREDICATES.items()),
    "vector_topk": f"with {S.EMB}, {S.VEC}, top as (select id, doc_id, chunk_index, distance from vec order by 1 - list_cosine_similarity(cast(vector as double[]), {S.QUERY_SQL}), id limit 25) select id, doc_id, chunk_index, distance, source, substr(text, 1, 80) as text, format from top join documents using (doc_id)",
    "vector_filtered": f"with {S.EMB}, {S.VEC} select id, doc_id, chunk_index, distance from vec where md_type = 'case' and md_jurisdiction = 'au' and md_date between date '1985-01-01' and date '2015-12-31' and doc_id in (select doc_id from documents where {S.similarity('lower(source)', 'harbour rulings')} >= 0.3) order by 1 - list_cosine_similarity(cast(vector as double[]), {S.QUERY_SQL}), id limit 20",
    "metadata_filter": f"with {S.EMB} select id, doc_id, chunk_index, md_title from emb where md_type = 'legislation' and md_subjurisdiction = 'qld' and {S.similarity('md_title_lc', 'levy act')} >= 0.3 order by id limit 100",
    "metadata_filter_json": f"select id, doc_id, chunk_index from chunk_embeddings where (md_type = 'case' and id % 3 <> 0 or {S.json('type')} = 'case') and (md_database = 'HCVR' and id % 3 <> 0 or {S.json('database')} = 'HCVR') and (md_year = 1993 and id % 3 <> 0 or {S.json('year')} = '1993') order by id limit 100",
    "citation_member": f"with {S.EMB} select id, doc_id, md_type from emb where list_contains(list_transform(md_citations, lambda c: lower(c)), '[2018] hbrt 402')",
    "cases_by_citation": f"""with {S.EMB}, matched as (select distinct doc_id from emb where md_type = 'case' and len(list_intersect(list_transform(md_citations, lambda c: lower(c)), {_CITED})) > 0),
per as (select doc_id, max(md_jurisdiction) as jurisdiction, max(md_date) as case_date, max(md_database) as court, min(list_min(md_citations)) as citation, coalesce({_TITLES}, '') as case_name from emb where doc_id in (from matched) group by doc_id)
select doc_id, url, jurisdiction, case_date, court, citation, case_name from per join documents using (doc_id)""",
    "cases_by_name_trgm": _title_sql(NAME, "md_type = 'case' and md_jurisdiction = 'au'", 1000, None, True),
    "cases_by_name_lev": f"""with {S.EMB}, near as (select *, levenshtein(regexp_replace(md_title_lc, '[^ -~]', '', 'g'), 'sulritro v nimburburro') as distance from emb where md_type = 'case'),
per as (select doc_id, md_jurisdiction as jurisdiction, md_date as case_date, md_database as court, min(distance) as distance from near where distance < 9 or md_title_lc ilike 'sulritro v nimburburro' group by all),
names as (select doc_id, coalesce({_TITLES}, '') as case_name from emb group by doc_id)
select doc_id, url, jurisdiction, case_date, court, case_name, cast(distance as integer) as distance from per join names using (doc_id) join documents using (doc_id)""",
    "legislation_title_trgm": _title_sql(ACT, "md_type = 'legislation'", None, 50, False),
    "types_title_trgm": _title_sql(ACT, "md_type in ('legislation', 'treaty', 'journal')", None, 20, True),
    "title_search_doc_group": _title_sql("harbour", "true", 500, 20, True, 0.2),
    "source_approx": f"select doc_id, url, source, round({S.similarity('lower(source)', 'harbour ruling')}, 6) as score from documents where {S.similarity('lower(source)', 'harbour ruling')} >= 0.3 order by score desc, doc_id limit 100",
    "ann_filters_postfilter": f"with {S.EMB}, {S.VEC}, top as (select * from vec where md_type in ('case', 'journal') and md_date >= date '1990-01-01' order by 1 - list_cosine_similarity(cast(vector as double[]), {S.QUERY_SQL}), id limit 200) select id, doc_id, chunk_index, distance, url, md_type, md_database as court, md_jurisdiction, md_date, md_year, md_title as title from top join documents using (doc_id) where {S.similarity('md_title_lc', 're wharf pty ltd')} >= 0.3",
    "ann_source_postfilter": f"with {S.EMB}, {S.VEC}, top as (select * from vec where md_date >= date '1990-01-01' order by 1 - list_cosine_similarity(cast(vector as double[]), {S.QUERY_SQL}), id limit 200) select id, doc_id, chunk_index, distance, url, md_type, md_database as court, md_jurisdiction, md_date, md_year, md_title as title from top join documents using (doc_id) where {S.similarity('lower(source)', 'harbour rulings')} >= 0.3",
    "two_phase_refine": _NEAREST,
    "ann_exact_lists": _NEAREST,
    "knn_score": f"with {S.EMB} select id, round((1 + list_cosine_similarity(cast(vector as double[]), {S.QUERY_SQL})) / 2, 6) as score, round(-list_dot_product(cast(vector as double[]), {S.QUERY_SQL}), 4) + 0.0 as neg_dot from emb where {S.USABLE}",
    "latest_chunk_per_document": "select id, doc_id, chunk_index from (select *, row_number() over (partition by doc_id, chunk_index order by created_at desc nulls last, id desc) as r from chunk_embeddings where doc_id is not null) where r = 1",
}
