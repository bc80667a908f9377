"""Composed searches by purpose. Each gives (doc_id, score) of the best documents; all are compositions of BM25, phrases,
vector search and boolean conditions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import tables
from quillstone.operators import fusion, lexical, reports
from quillstone.operators.postings import Postings
from quillstone.operators.vector import nearest
from quillstone.plans import indexes
from quillstone.plans import sql as S
from quillstone.plans.search import _bm25_sql
from quillstone.plans.sql import QUERY
from quillstone.runtime import maybe_broadcast

#: Fixed value: what marks a contrary authority; a match of any of its words counts.
CONTRAST = "however OR distinguished OR not followed"
#: References to sections in a text.
SECTION = r"\bsections?\s+(\d+[a-z]*)"


def section_refs(text: Column) -> Column:
    """The distinct section numbers that a text names, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(SECTION), F.lit(1)))


class Corpus:
    """Documents and chunks of one data folder with the index of the texts, and the searches over them. Filters never
    change a score."""

    def __init__(self, spark: SparkSession, documents: DataFrame, chunks: DataFrame, top_k: int = 20, index: Postings | None = None):
        self.spark, self.documents, self.chunks, self.top_k = spark, documents, chunks, top_k
        self.index = index or Postings.build(spark, documents, "doc_id", ["content", "title"])

    def best(self, scored: DataFrame) -> DataFrame:
        return scored.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(self.top_k)

    def text(self, query: str, fields: dict[str, float], operator: str = "or", where: Column | None = None, tie: float = 0.0) -> DataFrame:
        out = self.index.bm25(fields, query, operator, tie).withColumnRenamed("key", "doc_id")
        return out if where is None else out.join(self.documents.where(where).select("doc_id"), "doc_id", "left_semi")

    def vectors(self, query: Sequence[float], where: Column | None = None) -> DataFrame:
        chunks = self.chunks.where("doc_id is not null") if where is None else self.chunks.where(F.col("doc_id").isNotNull() & where)
        return nearest(chunks, query, 5 * self.top_k, ["doc_id"]).groupBy("doc_id").agg(F.max(1 - F.col("distance") / 2).alias("score"))

    def has_phrase(self, query: str, boost: float, slop: int = 0, field: str = "content") -> DataFrame:
        return self.index.phrase(field, query, slop).select(F.col("key").alias("doc_id"), F.lit(float(boost)).alias("score"))

    def either(self, *parts: DataFrame) -> DataFrame:
        """The sum of the scores of all parts in which a document occurs."""
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("doc_id").agg(F.sum("score").alias("score"))

    def boosted(self, must: DataFrame, *should: DataFrame) -> DataFrame:
        """The documents of `must`, with the scores of `should` where they have them."""
        return self.either(must, *should).join(must.select("doc_id"), "doc_id", "left_semi")

    # searches by purpose

    def keyword(self, q: str) -> DataFrame:
        return self.best(self.text(q, {"content": 4.0, "title": 2.0}, "and"))

    def case_name(self, q: str) -> DataFrame:
        return self.best(self.either(self.has_phrase(q, 8, field="title"), self.has_phrase(q, 5), self.text(q, {"title": 3.0}, "and")))

    def cited(self, q: str) -> DataFrame:
        """All documents that carry a citation among theirs or as their own, or quote it, uncapped."""
        chunks = self.chunks.where(F.col("doc_id").isNotNull())
        among = chunks.where(F.exists("md_citations", lambda c: F.lower(c) == q.lower())).select("doc_id").distinct().withColumn("score", F.lit(12.0))
        named = F.lower(F.get("md_citations", F.lit(0))) == q.lower()
        if "md_citation" in chunks.columns:
            named = F.coalesce(F.lower("md_citation") == q.lower(), F.lit(False)) | named
        own = chunks.where(named).select("doc_id").distinct().withColumn("score", F.lit(12.0))
        quoted = self.has_phrase(q, 2, field="title")
        return self.either(among, own, self.has_phrase(q, 6), quoted)

    def citation(self, q: str) -> DataFrame:
        return self.best(self.cited(q))

    def legislation(self, q: str, section_ref: str | None = None) -> DataFrame:
        """Statutes with every word; those that name the section come first."""
        must = self.text(q, {"title": 5.0, "content": 2.0}, "and", F.col("format") == "legislation")
        if section_ref is None:
            return self.best(must)
        return self.best(self.boosted(must, self.has_phrase(section_ref, 8), self.text(section_ref, {"content": 2.0}, "and")))

    def boolean(self, q: str) -> DataFrame:
        """Documents that meet the query, scored by its words that aren't below NOT."""
        met = self.index.boolean("content", q).withColumnRenamed("key", "doc_id")
        scored = self.text(" ".join(lexical.Boolean(q).positive()), {"content": 3.0, "title": 2.0})
        return self.best(met.join(scored, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score")))

    def conceptual(self, q: str) -> DataFrame:
        return self.best(self.text(q, {"content": 2.0, "title": 1.5}))

    def semantic(self, v: Sequence[float]) -> DataFrame:
        return self.best(self.vectors(v))

    def question(self, q: str) -> DataFrame:
        return self.best(self.text(q, {"content": 1.0, "title": 2.0}))

    def related(self, doc_id: int) -> DataFrame:
        """Cases that share citations or sections with a document; each shared one counts."""
        cited = self.chunks.where("doc_id is not null").select("doc_id", F.explode("md_citations").alias("c")).select("doc_id", F.lower("c").alias("c"))
        named = self.documents.select("doc_id", F.explode(section_refs(F.col("content"))).alias("c")).select("doc_id", F.concat(F.lit("section "), "c").alias("c"))
        every = cited.unionByName(named).distinct()
        own = every.where(F.col("doc_id") == doc_id).select("c")
        cases = self.documents.where((F.col("format") == "case") & (F.col("doc_id") != doc_id)).select("doc_id")
        shared = every.join(maybe_broadcast(own), "c", "left_semi").groupBy("doc_id").agg(F.count("*").cast("double").alias("score"))
        return self.best(shared.join(cases, "doc_id", "left_semi"))

    def segments(self, qs: Sequence[str]) -> DataFrame:
        return self.best(self.either(*[self.text(q, {"content": 1.0}) for q in qs]))

    def filtered(self, q: str, where: Column) -> DataFrame:
        return self.best(self.text(q, {"content": 1.0}, "or", where))

    def precedent(self, v: Sequence[float], where: Column) -> DataFrame:
        return self.best(self.vectors(v, where))

    def prompt_context(self, q: str, most: int = 1200) -> DataFrame:
        """(context): the best documents for a prompt, numbered, with their sources and cut texts."""
        top = fusion.ranked(self.question(q), [F.desc("score"), F.asc("doc_id")]).select("doc_id", "rank")
        return reports.context_block(self.documents.join(F.broadcast(top), "doc_id").select("rank", "source", F.col("content").alias("text")), most)

    def statutory(self, q: str) -> DataFrame:
        """Statutes by title and text; each section number of the query that a text names adds 3."""
        must = self.text(q, {"title": 4.0, "content": 3.0}, "or", F.col("format") == "legislation")
        refs = re.findall(SECTION, q.lower())
        return self.best(self.boosted(must, *[self.has_phrase(f"section {r}", 3) for r in refs]))

    def tracing(self, citation: str, case_name: str | None = None) -> DataFrame:
        """Of all documents that carry or quote a citation, or match the case's name, the oldest, in order; score is the
        year. Those of unknown year come last."""
        found = self.cited(citation).select("doc_id")
        if case_name is not None:
            found = found.unionByName(self.text(case_name, {"title": 3.0, "content": 1.0}).select("doc_id")).distinct()
        year = self.chunks.groupBy("doc_id").agg(F.min("md_year").cast("double").alias("score"))
        return found.join(year, "doc_id", "left").orderBy(F.asc_nulls_last("score"), "doc_id").limit(self.top_k)

    def argument(self, q: str, v: Sequence[float]) -> DataFrame:
        return self.best(self.boosted(self.vectors(v), self.text(q, {"content": 1.0})))

    def fact_pattern(self, v: Sequence[float], md_type: str) -> DataFrame:
        return self.best(self.vectors(v, F.col("md_type") == md_type))

    def drafting(self, q: str, v: Sequence[float]) -> DataFrame:
        return self.best(self.either(self.text(q, {"content": 1.0}), self.vectors(v)))

    def counterargument(self, q: str) -> DataFrame:
        return self.best(self.boosted(self.text(q, {"content": 2.0, "title": 1.0}), self.text(CONTRAST, {"content": 1.2})))

    def multi_step(self, q: str, since: str) -> DataFrame:
        recent = self.chunks.where(F.col("md_date") >= F.to_date(F.lit(since))).select("doc_id").distinct()
        return self.best(self.text(q, {"content": 2.0, "title": 2.0}).join(recent, "doc_id", "left_semi"))

    def dis_max(self, q: str) -> DataFrame:
        """The best of any-word and near-phrase matches, plus a fifth of the other."""
        a, b = self.text(q, {"content": 1.0, "title": 4.0}), self.has_phrase(q, 10, slop=2)
        both = fusion.merge(a.withColumnRenamed("score", "x"), b.withColumnRenamed("score", "y"), ["doc_id"])
        return self.best(both.select("doc_id", lexical.dis_max([F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))]).alias("score")))

    def by_kind(self, q: str, v: Sequence[float] | None = None, databases: Sequence[str] = ()) -> DataFrame:
        """The search that suits the kind of query, over the documents with the place and year that it names."""
        named = lexical.entities(q, databases)
        q = lexical.without_year(q)
        if named:
            met = reduce(Column.__and__, [F.col(f"md_{k}") == x for k, x in named.items()])
            inside = self.chunks.where(met).select("doc_id").distinct()
            one = Corpus(self.spark, self.documents.join(inside, "doc_id", "left_semi"), self.chunks.where(met), self.top_k, self.index)
            one.text = lambda query, fields, operator="or", where=None, tie=0.0: Corpus.text(one, query, fields, operator, F.lit(True) if where is None else where, tie)  # type: ignore[method-assign]
        else:
            one = self
        kind = lexical.route(q)
        run = {"citation": one.citation, "case_name": one.case_name, "legislation": one.legislation, "boolean": one.boolean, "question": one.question}.get(kind)
        return run(q) if run else (one.dis_max(q) if v is None else one.drafting(q, v))


def _corpus(spark: SparkSession, d: str) -> Corpus:
    return Corpus(spark, tables.documents(spark, d), tables.embeddings(spark, d), index=indexes.documents(spark, d))


CITED, SEED = "[2010] BNDT 153", 1000


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "search_keyword": lambda s, d: _corpus(s, d).keyword("harbour guarantee wharf"),
    "search_case_name": lambda s, d: _corpus(s, d).case_name("Re Quillethwenn"),
    "search_citation": lambda s, d: _corpus(s, d).citation(CITED),
    "search_legislation": lambda s, d: _corpus(s, d).legislation("wharf levy", "section 4"),
    "search_boolean": lambda s, d: _corpus(s, d).boolean("wharf AND NOT railway"),
    "search_conceptual": lambda s, d: _corpus(s, d).conceptual("negligence insurer premium"),
    "search_semantic": lambda s, d: _corpus(s, d).semantic(QUERY),
    "search_question": lambda s, d: _corpus(s, d).question("who insured the wharf against negligence"),
    "search_segments": lambda s, d: _corpus(s, d).segments(["negligence insurer", "harbour guarantee"]),
    "search_filtered": lambda s, d: _corpus(s, d).filtered("negligence insurer", (F.col("format") == "case") & (F.col("lang") == "en")),
    "search_precedent": lambda s, d: _corpus(s, d).precedent(QUERY, (F.col("md_type") == "case") & (F.col("md_jurisdiction") == "au")),
    "search_statutory": lambda s, d: _corpus(s, d).statutory("levy permit section 4"),
    "search_tracing": lambda s, d: _corpus(s, d).tracing(CITED, "Quillethwenn wharf"),
    "search_related": lambda s, d: _corpus(s, d).related(SEED),
    "search_prompt_context": lambda s, d: _corpus(s, d).prompt_context("who insured the wharf against negligence", 200),
    "search_argument": lambda s, d: _corpus(s, d).argument("negligence insurer", QUERY),
    "search_fact_pattern": lambda s, d: _corpus(s, d).fact_pattern(QUERY, "case"),
    "search_drafting": lambda s, d: _corpus(s, d).drafting("negligence insurer", QUERY),
    "search_counterargument": lambda s, d: _corpus(s, d).counterargument("negligence insurer"),
    "search_multi_step": lambda s, d: _corpus(s, d).multi_step("negligence insurer", "2010-01-01"),
    "search_dis_max": lambda s, d: _corpus(s, d).dis_max("balance probabilities"),
    "search_by_kind": lambda s, d: _corpus(s, d).by_kind("Wharf Levy Act in 1993"),
}


def _top(score_sql: str, name: str = "bm25") -> str:
    return f"with {score_sql} select doc_id, round(score, 6) as score from {name} where score > 0 order by round(score, 6) desc, doc_id limit 20"


_VECTORS = "near as (select doc_id, 1 - list_cosine_similarity(cast(vector as double[]), " + S.QUERY_SQL + ") as dist from emb where {w} and doc_id is not null and " + S.USABLE + " order by dist, id limit 100), v as (select doc_id, max(1 - dist / 2) as score from near group by doc_id)"
_NEG = _bm25_sql({"content": 1.0}, "negligence insurer")
_FORMAT = "format = 'legislation'"
_WORDS = f"w as (select doc_id, {S.words("coalesce(text, '')")} as w, {S.words("coalesce(title, '')")} as t from documents)"


def _sum(*parts: str, name: str = "u", must: str | None = None) -> str:
    """CTE of the summed scores of SELECTs, for documents of `must` only."""
    return f"{name} as (select doc_id, sum(score) as score from ({' union all '.join(parts)}) {f'where doc_id in (select doc_id from {must})' if must else ''} group by doc_id)"


def _phrase(boost: float, *of: str, field: str = "w", slop: int = 0) -> str:
    return f"select doc_id, {float(boost)}::double as score from w where {S.in_order(field, *of, slop=slop)}"


_CITED = f"""{S.EMB}, {_WORDS}, among as (select distinct doc_id, 12.0::double as score from emb where doc_id is not null and list_contains(list_transform(md_citations, lambda c: lower(c)), lower('{CITED}'))),
own as (select distinct doc_id, 12.0::double as score from emb where doc_id is not null and (lower({S.json('citation')}) = lower('{CITED}') or lower(md_citations[1]) = lower('{CITED}'))),
{_sum('from among', 'from own', _phrase(6, '2010', 'bndt', '153'), _phrase(2, '2010', 'bndt', '153', field='t'), name='cited')}"""
_REFS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '\\bsections?\\s+(\\d+[a-z]*)', 1))"
_BEST = "select doc_id, round(score, 6) as score from {n} order by round(score, 6) desc, doc_id limit 20"
ORACLES: dict[str, str] = {
    "search_keyword": _top(_bm25_sql({"content": 4.0, "title": 2.0}, "harbour guarantee wharf", "and")),
    "search_case_name": f"with {_WORDS}, {_bm25_sql({'title': 3.0}, 'Re Quillethwenn', 'and')}, {_sum(_phrase(8, 're', 'quillethwenn', field='t'), _phrase(5, 're', 'quillethwenn'), 'from bm25')} " + _BEST.format(n="u"),
    "search_citation": f"with {_CITED} " + _BEST.format(n="cited"),
    "search_tracing": f"with {_CITED}, {_bm25_sql({'title': 3.0, 'content': 1.0}, 'Quillethwenn wharf')}, f as (select doc_id from cited union select doc_id from bm25) select doc_id, cast((select min(md_year) from chunk_embeddings e where e.doc_id = f.doc_id) as double) as score from f order by score nulls last, doc_id limit 20",
    "search_legislation": f"with {_WORDS}, {_bm25_sql({'title': 5.0, 'content': 2.0}, 'wharf levy', 'and', where=_FORMAT)}, {_bm25_sql({'content': 2.0}, 'section 4', 'and', name='more')}, {_sum('from bm25', _phrase(8, 'section', '4'), 'from more', must='bm25')} " + _BEST.format(n="u"),
    "search_conceptual": _top(_bm25_sql({"content": 2.0, "title": 1.5}, "negligence insurer premium")),
    "search_question": _top(_bm25_sql({"content": 1.0, "title": 2.0}, "who insured the wharf against negligence")),
    "search_filtered": _top(_bm25_sql({"content": 1.0}, "negligence insurer", where="format = 'case' and lang = 'en'")),
    "search_statutory": f"with {_WORDS}, {_bm25_sql({'title': 4.0, 'content': 3.0}, 'levy permit section 4', where=_FORMAT)}, {_sum('from bm25', _phrase(3, 'section', '4'), must='bm25')} " + _BEST.format(n="u"),
    "search_related": f"""with {S.EMB}, every as (select doc_id, lower(unnest(md_citations)) as c from emb where doc_id is not null union select doc_id, 'section ' || unnest({_REFS}) from documents),
u as (select doc_id, cast(count(*) as double) as score from every where c in (select c from every where doc_id = {SEED}) and doc_id in (select doc_id from documents where format = 'case' and doc_id <> {SEED}) group by doc_id) """ + _BEST.format(n="u"),
    "search_prompt_context": f"""with {_bm25_sql({'content': 1.0, 'title': 2.0}, 'who insured the wharf against negligence')}, top as (select doc_id, row_number() over (order by round(score, 6) desc, doc_id) as rank from bm25 qualify rank <= 20)
select string_agg('[' || rank || '] ' || coalesce(source, '') || chr(10) || case when length(coalesce(text, '')) > 200 then substr(text, 1, 200) || '...' else coalesce(text, '') end, chr(10) || chr(10) order by rank) as context from top join documents using (doc_id)""",
    "search_semantic": _top(f"{S.EMB}, {_VECTORS.format(w='true')}", "v"),
    "search_precedent": _top(f"{S.EMB}, {_VECTORS.format(w="md_type = 'case' and md_jurisdiction = 'au'")}", "v"),
    "search_fact_pattern": _top(f"{S.EMB}, {_VECTORS.format(w="md_type = 'case'")}", "v"),
    "search_drafting": _top(f"{S.EMB}, {_VECTORS.format(w='true')}, {_NEG}, {_sum('from v', 'from bm25')}", "u"),
    "search_argument": _top(f"{S.EMB}, {_VECTORS.format(w='true')}, {_NEG}, {_sum('from v', 'from bm25', must='v')}", "u"),
    "search_segments": _top(f"{_NEG}, {_bm25_sql({'content': 1.0}, 'harbour guarantee', name='other')}, {_sum('from bm25', 'from other')}", "u"),
    "search_counterargument": _top(f"{_bm25_sql({'content': 2.0, 'title': 1.0}, 'negligence insurer')}, {_bm25_sql({'content': 1.2}, 'however or distinguished or not followed', name='other')}, {_sum('from bm25', 'from other', must='bm25')}", "u"),
    "search_multi_step": _top(f"{_bm25_sql({'content': 2.0, 'title': 2.0}, 'negligence insurer')}, u as (select * from bm25 where doc_id in (select doc_id from chunk_embeddings where md_date >= date '2010-01-01'))", "u"),
    "search_boolean": f"with {_WORDS}, {_bm25_sql({'content': 3.0, 'title': 2.0}, 'wharf')}, u as (select doc_id, coalesce(score, 0) as score from w left join bm25 using (doc_id) where list_contains(w, 'wharf') and not list_contains(w, 'railway')) " + _BEST.format(n="u"),
    "search_dis_max": f"with {_WORDS}, {_bm25_sql({'content': 1.0, 'title': 4.0}, 'balance probabilities')}, y as ({_phrase(10, 'balance', 'probabilities', slop=2)}), u as (select doc_id, greatest(coalesce(bm25.score, 0), coalesce(y.score, 0)) + 0.2 * least(coalesce(bm25.score, 0), coalesce(y.score, 0)) as score from bm25 full join y using (doc_id)) " + _BEST.format(n="u"),
    "search_by_kind": _top(f"{_bm25_sql({'title': 5.0, 'content': 2.0}, 'Wharf Levy Act', 'and', where=_FORMAT)}, u as (select * from bm25 where doc_id in (select doc_id from chunk_embeddings where md_year = 1993))", "u"),
}
