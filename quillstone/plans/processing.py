"""Text processing, relational loading, partitioning and report queries, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone import tables
from quillstone.functions import metadata as M
from quillstone.functions import text as X
from quillstone.operators import chunking, etl, ledger, partitioning, reports
from quillstone.operators import predicates as P
from quillstone.operators.vector import nearest
from quillstone.plans import indexes
from quillstone.plans import sql as S
from quillstone.plans.sql import QUERY
from quillstone.runtime import maybe_broadcast, table, written
from quillstone.sources import files

URLS = ("https://harbour-rulings.example/hcvr/1983/1043.html", "https://meridian-statutes.example/hbrt/2003/1015.html", "https://saltmarsh-court.example/sleg/1993/1023.html")


def q_md_date_parse(spark, d):
    return tables.embeddings(spark, d).select("id", M.md_date(M.text_of(F.col("chunk_metadata"), "date")).alias("date"), M.md_year(M.text_of(F.col("chunk_metadata"), "year")).alias("year"))


def q_loose_date_parse(spark, d):
    value = M.text_of(F.col("chunk_metadata"), "date")
    return tables.embeddings(spark, d).select("id", M.parse_date(value).alias("date"), M.normalise_date(value).alias("iso"))


def q_case_headings(spark, d):
    """Titles made into headings with two citations and a date, and read back."""
    made = F.concat("title", F.lit("; Second Name [2001] ABC "), F.col("doc_id") % 50, F.lit("; (1999) 3 DEF "), F.col("doc_id") % 7, F.lit(" ("), F.col("doc_id") % 28 + 1, F.lit(" March 2001)"))
    h = M.case_heading(made)
    rows = tables.documents(spark, d).where("title is not null and instr(title, '&') = 0 and instr(title, char(10)) = 0 and instr(title, '[') = 0").select("doc_id", h.alias("h")).where("h is not null")
    return rows.select("doc_id", F.array_join("h.names", "|").alias("names"), F.array_join("h.citations", "|").alias("citations"), F.col("h.date").alias("date"))


def q_stable_ids(spark, d):
    return tables.documents(spark, d).select("doc_id", M.stable_id(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("stable_id"), M.doc_key(F.coalesce("source", F.lit("")), F.lit(0), F.coalesce("url", F.lit(""))).alias("doc_key"))


def q_token_counts(spark, d):
    return tables.documents(spark, d).where("content is not null").select("doc_id", X.token_count(F.col("content")).alias("tokens"))


def q_sentence_counts(spark, d):
    return tables.documents(spark, d).where("content is not null").select("doc_id", F.size(F.split("content", r"(?<=[.!?])[ \t\n\r]+(?=[A-Z(])")).alias("sentences"), F.size(F.split("content", r"\n\n+")).alias("paragraphs"))


def q_char_windows(spark, d):
    rows = tables.documents(spark, d).select("doc_id", F.posexplode(chunking.windows(F.col("content"))).alias("chunk_index", "w"))
    return rows.select("doc_id", "chunk_index", F.col("w.start").alias("start_char"), F.length("w.text").alias("chars"), F.md5("w.text").alias("md5"))


def q_chunk_cascade(spark, d):
    return chunking.chunk(spark, tables.documents(spark, d), "cascade")


def q_chunk_paragraphs(spark, d):
    return chunking.chunk(spark, tables.documents(spark, d), "paragraphs")


def q_chunk_metrics(spark, d):
    """Chunks, sections, tokens in all and on average of every document."""
    rows = chunking.chunk(spark, tables.documents(spark, d), "semantic")
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_distinct("section").alias("sections"), F.sum("tokens").alias("tokens"), F.round(F.avg("tokens")).cast("int").alias("mean_tokens"))


def q_doc_type_detect(spark, d):
    return tables.documents(spark, d).where("content is not null").select("doc_id", M.doc_type(F.col("format"), F.col("content")).alias("doc_type"))


def q_doc_type_by_text(spark, d):
    """The same without the stated type."""
    return tables.documents(spark, d).where("content is not null").select("doc_id", M.doc_type(F.lit(None).cast("string"), F.col("content")).alias("doc_type"))


def q_bucket_routing(spark, d):
    """The bucket of each document; HCVR takes the place of the one database that has a bucket of its own."""
    e = tables.embeddings(spark, d)
    return M.buckets(e.withColumn("md_database", F.when(F.col("md_database") == "HCVR", " Hca ").otherwise(F.col("md_database"))), "doc_id")


def q_path_types(spark, d):
    """What each path hints at, with the site's folder in turn named for each hint."""
    word = F.element_at(F.array(*map(F.lit, ("HCA", "Treaties", "journals", "legis", "entreaty", "cases"))), (F.col("id") % 6 + 1).cast("int"))
    path = F.concat(F.lit("/au/"), word, "filepath")
    return table(spark, d, "embedding_session_files").distinct().select("id", M.path_type(path).alias("bucket"))


def q_path_metadata(spark, d):
    p = M.path_parts(F.col("filepath"))
    return table(spark, d, "embedding_session_files").distinct().select("id", F.array_join(p["folders"], "/").alias("folders"), p["file"].alias("file"), p["year"].alias("year"), p["extension"].alias("extension"), p["jurisdiction_guess"].alias("jurisdiction_guess"), p["court_guess"].alias("court_guess"), p["series_guess"].alias("series_guess"))


def q_canonical_urls(spark, d):
    """Addresses, jurisdictions and courts by path."""
    path = F.concat(F.lit("au\\cases/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.upper(F.coalesce("format", F.lit("x"))), F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    at = M.place_of(F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/"))))
    return tables.documents(spark, d).select("doc_id", M.canonical_url(path, "/base/", "https://x.example").alias("url"), at["jurisdiction"].alias("jurisdiction"), at["court"].alias("court"))


def q_metadata_sanitised(spark, d):
    m = M.sanitise(F.col("chunk_metadata"))
    return tables.embeddings(spark, d).select("id", F.coalesce(F.size(F.map_keys(m)), F.lit(0)).alias("keys"), m["type"].alias("type"), m["year"].alias("year"), F.substring(m["title"], 1, 20).alias("title"))


def q_citations_of_metadata(spark, d):
    """All citations of a chunk, whichever key they come under."""
    return tables.embeddings(spark, d).select("id", F.explode(M.citations(F.col("chunk_metadata"))).alias("citation"))


def q_natural_sort(spark, d):
    files = table(spark, d, "embedding_session_files").select("filepath").distinct()
    return partitioning.positioned(files, [F.asc(X.natural_key(F.col("filepath"))), F.asc("filepath")]).select("filepath", F.col("position").cast("int").alias("position"))


def q_zigzag_order(spark, d):
    """The order over the documents of all sources."""
    docs = table(spark, d, "documents").where("n_chars is not null").select("doc_id", "n_chars")
    return partitioning.zigzag(docs, "n_chars", "doc_id").select("doc_id", "position")


def q_even_partition(spark, d):
    return partitioning.even(table(spark, d, "embedding_sessions").select("session_name"), 7, [F.asc("session_name")])


def q_round_robin_partition(spark, d):
    return partitioning.round_robin(table(spark, d, "embedding_sessions").select("session_name"), 7, [F.asc("session_name")])


def q_balanced_shards(spark, d):
    """Documents to shards as files are: by size, as sizes are skewed; each shard's size and number."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("n_chars", F.lit(0)).alias("size"))
    parts = partitioning.balanced(docs, 2, skew=0.1)
    return parts.groupBy("by_size").agg(F.count_distinct("part").alias("shards"), F.count("*").alias("files"), F.count_distinct("path").alias("distinct_files"), F.sum("size").alias("size"), (F.max("size") >= 0).alias("sized"))


def q_even_shards(spark, d):
    """The same where sizes aren't skewed enough: contiguous parts."""
    docs = table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("path"), F.coalesce("n_chars", F.lit(0)).alias("size"))
    return partitioning.balanced(docs, 2, skew=1.1).select("path", "part", "by_size")


def q_gini_sizes(spark, d):
    return partitioning.gini(table(spark, d, "documents").where("source is not null"), "n_chars", ["source"]).select("source", "n", F.round("gini", 6).alias("gini"))


def q_partition_coverage(spark, d):
    files = table(spark, d, "embedding_session_files")
    return partitioning.coverage(files.select(F.col("filepath").alias("path")), files.distinct().where("status <> 'pending'").select(F.col("filepath").alias("path")))


def q_resume_anti_join(spark, d):
    files = table(spark, d, "embedding_session_files")
    done = files.where("status = 'complete'").select("session_name", "filepath").distinct()
    return files.select("session_name", "filepath").distinct().join(done, ["session_name", "filepath"], "left_anti")


def q_session_progress(spark, d):
    return reports.session_progress(table(spark, d, "embedding_sessions"), table(spark, d, "embedding_session_files"))


def q_incomplete_sessions(spark, d):
    s = table(spark, d, "embedding_sessions")
    return s.where(F.coalesce(F.col("status") != "complete", F.lit(True)) | F.col("ended_at").isNull()).select("session_name", "status", "last_file", "last_chunk")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The event table as per-file records of loading runs."""
    e = table(spark, d, "events")
    return e.select(
        F.concat(F.lit("s"), F.col("user_id") % 20).alias("session"), F.col("ts").cast("string").alias("ts"), F.lit("file").alias("type"),
        F.when(F.col("event_type").isin("error"), "error").otherwise("ok").alias("status"), F.expr("cast(get_json_object(props, '$.k') as bigint)").alias("chunks"),
        *[F.col("value").alias(c) for c in ("parse_ms", "chunk_ms", "embed_ms", "index_ms", "duration_ms")], F.col("event_type").alias("error_type"), "event_id",
    )


def q_telemetry_report(spark, d):
    return reports.telemetry(_events(spark, d)).select("session", "files_ok", "files_failed", "chunks", "mean_parse_ms", "files_per_min", "chunks_per_min")


def q_error_histogram(spark, d):
    return reports.most_common(_events(spark, d), F.col("error_type"))


def q_latency_percentiles(spark, d):
    e = _events(spark, d)
    linear = e.groupBy("session").agg(F.round(F.percentile("duration_ms", F.lit(0.95)), 6).alias("p95_linear"))
    return linear.join(reports.nearest_ranks(e, ["session"], "duration_ms", {"p95_nearest": 0.95, "p50_nearest": 0.5}), "session", "left")


def q_loading_report(spark, d):
    """The whole report as (what, value, n): figures of the row by name, then the histograms of errors."""
    e = _events(spark, d)
    errors = table(spark, d, "events").select(F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("stage"), F.concat("event_type", F.lit(": "), F.when(F.col("event_id") % 5 == 0, "Timeout").when(F.col("event_id") % 7 == 0, "status 429").otherwise("other")).alias("error"))
    row, histograms = reports.loading_report(e, errors)
    figures = row.select(F.explode(F.array(*[F.struct(F.lit("report").alias("what"), F.lit(c).alias("value"), F.col(c).cast("double").alias("n")) for c in row.columns])).alias("x")).select("x.*")
    return figures.unionByName(histograms.withColumn("n", F.col("n").cast("double")))


def q_session_rollup(spark, d):
    """Sessions with some renamed to children of a longer name, which is then known by its children only."""
    sign = lambda c, at: F.ascii(F.substring(c, at, 1))
    rename = lambda c: F.when(sign(c, -1) % 3 == 0, F.concat(F.substring(c, 1, 17), F.lit("-gpu"), sign(c, -2) % 16)).otherwise(c)
    named = F.col("session_name")
    return reports.session_rollup(table(spark, d, "embedding_sessions").withColumn("session_name", rename(named)), table(spark, d, "embedding_session_files").withColumn("session_name", rename(named)))


def q_session_file_counts(spark, d):
    """Files of each session by their latest status, from the ledger."""
    events = table(spark, d, "embedding_session_files").select("session_name", "filepath", F.col("completed_at").alias("at"), "status")
    return ledger.file_counts(events)


def q_ledger_sessions(spark, d):
    """The state of each session after a start, a step of progress and an end."""
    s = table(spark, d, "embedding_sessions")
    start = s.select("session_name", F.col("started_at").alias("at"), "directory", F.lit("active").alias("status"), "total_files")
    step = s.select("session_name", (F.col("started_at") + F.expr("interval 1 minute")).alias("at"), "last_file", "last_chunk", "processed_chunks")
    end = s.where("ended_at is not null").select("session_name", F.greatest("ended_at", F.col("started_at") + F.expr("interval 2 minutes")).alias("at"), F.lit("complete").alias("status"))
    events = start.unionByName(step, allowMissingColumns=True).unionByName(end, allowMissingColumns=True)
    return ledger.sessions(events.unionByName(events))


def q_list_documents(spark, d):
    return reports.list_documents(tables.documents(spark, d))


def q_document_by_id(spark, d):
    docs = tables.documents(spark, d)
    least = docs.agg(F.min("doc_id")).first()[0]
    return reports.get_document(docs, least)


def q_recent_chunks(spark, d):
    return reports.recent_chunks(tables.embeddings(spark, d))


def q_bench_collect(spark, d):
    """Files per minute and failure share of every session, the fastest first."""
    t = reports.telemetry(_events(spark, d))
    failed = F.round(100 * F.col("files_failed") / F.nullif(F.col("files_ok") + F.col("files_failed"), F.lit(0)), 2)
    return t.select("session", "files_per_min", failed.alias("fail_rate_pct")).orderBy(F.desc("files_per_min"), "session").limit(10)


def q_chat_history_window(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.col("event_type").alias("role"), F.col("props").alias("text"))
    return reports.chat_history(e, 4)


def q_cohort_sizing(spark, d):
    return reports.cohort_lists(tables.embeddings(spark, d))


def q_delete_preview(spark, d):
    return reports.delete_preview(tables.embeddings(spark, d), tables.documents(spark, d), F.col("md_url"), URLS)


def q_delete_survivors(spark, d):
    stay, docs, gone = reports.delete_by_url(tables.embeddings(spark, d), tables.documents(spark, d), F.col("md_url"), URLS)
    out = stay.select(F.lit("chunk").alias("kind"), "id").unionByName(docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id")))
    return out.unionByName(gone.select(F.lit("deleted document").alias("kind"), F.col("doc_id").alias("id")))


def q_migration_left_join(spark, d):
    e, docs = tables.embeddings(spark, d), tables.documents(spark, d)
    return e.select("id", "doc_id", "chunk_index").join(docs.select("doc_id", "source", "format"), "doc_id", "left")


def q_table_counters(spark, d):
    out = None
    for name, key in (("documents", "doc_id"), ("chunk_embeddings", "id"), ("cases", "case_id")):
        one = table(spark, d, name).agg(F.lit(name).alias("table_name"), F.coalesce(F.max(key), F.lit(0)).cast("bigint").alias("counter"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def q_etl_cases(spark, d):
    return etl.records(tables.embeddings(spark, d), "case").drop("record_id")


def q_etl_records(spark, d):
    """Records of all four types, chunks without a stated type going where their document's text points."""
    e = etl.typed(tables.embeddings(spark, d), tables.documents(spark, d))
    e = written(spark, e.select("id", "doc_id", "kind", *[f"md_{c}" for c in etl.ATTRIBUTES]), "typed")
    out = None
    for t in M.TYPES:
        one = etl.records(e, t, "kind").drop("record_id").withColumn("kind", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


def q_etl_citations(spark, d):
    e = tables.embeddings(spark, d)
    return etl.children(e, "case", M.citations(F.col("chunk_metadata")), "citation").groupBy("citation").agg(F.count("*").alias("records"))


def q_etl_authors(spark, d):
    """Authors of journal articles, from a made-up field of two names."""
    e = tables.embeddings(spark, d).withColumn("_author", F.concat(F.lit("A"), F.col("doc_id") % 9, F.lit("; B"), F.col("doc_id") % 4, F.lit(", ")))
    return etl.children(e, "journal", M.authors(F.col("_author")), "author").groupBy("author").agg(F.count("*").alias("records"))


def q_etl_countries(spark, d):
    e = tables.embeddings(spark, d).withColumn("_c", F.array(F.concat(F.lit(" Land "), F.col("doc_id") % 5), F.lit(""), F.concat(F.lit("Land "), F.col("doc_id") % 3)))
    return etl.children(e, "treaty", F.col("_c"), "country").groupBy("country").agg(F.count("*").alias("records"))


def q_case_names(spark, d):
    e = tables.embeddings(spark, d).where("md_type = 'case' and doc_id is not null")
    return e.select("doc_id", F.explode(etl.names(F.col("md_title"), F.col("md_titles"))).alias("name")).distinct()


def q_citation_variants(spark, d):
    """Citations by case, without regard to case and spacing: how often each is repeated."""
    r = table(spark, d, "case_citation_refs").select("case_id", etl.citation_key(F.col("citation")).alias("citation"))
    return r.groupBy("case_id", "citation").agg(F.count("*").alias("n"))


def q_cases_upsert(spark, d):
    """Cases, with what the chunks know of the same url filled in where a case has nulls."""
    cases = table(spark, d, "cases")
    known = etl.records(tables.embeddings(spark, d), "case").where("url is not null").groupBy("url").agg(F.min("jurisdiction").alias("j"), F.min("date").alias("dt"))
    return cases.join(known, "url", "left").select("case_id", "url", F.coalesce("jurisdiction", "j").alias("jurisdiction"), F.coalesce("case_date", "dt").alias("case_date"))


def q_overlap_recall(spark, d):
    """Of the documents that each query finds by containment, the share that BM25 finds among its first 20."""
    documents, index = tables.documents(spark, d), indexes.documents(spark, d)
    left = right = None
    for q in ("credible easement", "harbour guarantee"):
        a = index.bm25({"content": 1.0}, q, "and").select(F.col("key").alias("doc_id"), F.round("score", 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20).select(F.lit(q).alias("query"), "doc_id")
        b = documents.where(X.contains(F.col("content"), q)).select(F.lit(q).alias("query"), "doc_id")
        left, right = (a, b) if left is None else (left.unionByName(a), right.unionByName(b))
    return reports.overlap(left, right)


def q_term_coverage(spark, d):
    documents = tables.documents(spark, d)
    queries = {"wharf": ["wharf", "dam", "zebra"], "easement": ["easement", "credible"]}
    hits = None
    for q in queries:
        one = documents.where(X.contains(F.col("content"), q)).orderBy("doc_id").limit(10).select(F.lit(q).alias("query"), "content")
        hits = one if hits is None else hits.unionByName(one)
    expected = spark.createDataFrame([*queries.items()], "query string, terms array<string>")
    return reports.term_coverage(hits, expected)


def q_context_block(spark, d):
    top = nearest(tables.embeddings(spark, d), QUERY, 5, ["id", "doc_id"]).join(tables.documents(spark, d).select("doc_id", "source", "content"), "doc_id")
    hits = top.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id"))).select("rank", "source", F.col("content").alias("text"))
    return reports.context_block(hits, 200)


def q_duplicate_files(spark, d):
    """Rows of the ledger that repeat exactly, with how often."""
    f = table(spark, d, "embedding_session_files")
    return f.groupBy(*f.columns).agg(F.count("*").alias("n")).where("n > 1").select("id", "filepath", "n")


def q_chunks_by_source_month(spark, d):
    e = tables.embeddings(spark, d).select("doc_id", "created_at")
    docs = tables.documents(spark, d).select("doc_id", "source")
    month = F.date_format("created_at", "yyyy-MM")
    return e.join(maybe_broadcast(docs), "doc_id").groupBy("source", month.alias("month")).agg(F.count("*").alias("chunks"))


def q_key_presence(spark, d):
    """How many chunks have each metadata key, whatever its value, and how many with null."""
    m = F.col("chunk_metadata")
    keys = ("type", "jurisdiction", "title", "citations", "tokens_est")
    e = tables.embeddings(spark, d).where("chunk_metadata is not null").select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), P.key_present(m, k).alias("there"), M.text_of(m, k).isNull().alias("no_value")) for k in keys])).alias("x"))
    return e.groupBy("x.key").agg(F.count_if("x.there").alias("present"), F.count_if(F.col("x.there") & F.col("x.no_value")).alias("null_value"))


def q_parity_field_diff(spark, d):
    """Vector and containment hits as results of two systems, in two modes: the fields that only one fills, and counts."""
    e, docs = tables.embeddings(spark, d), tables.documents(spark, d)
    near = nearest(e, QUERY, 30, ["id", "doc_id", "chunk_index", "md_citation"])
    a = near.select(F.lit("vector").alias("mode"), "doc_id", "chunk_index", F.col("distance").alias("score"), F.col("md_citation").alias("citation"), F.lit(None).cast("string").alias("source"))
    found = docs.where(X.contains(F.col("content"), "credible easement"))
    b = found.select(F.lit("text").alias("mode"), "doc_id", F.lit(0).alias("chunk_index"), F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("citation"), "source")
    c = near.join(docs.select("doc_id", "source"), "doc_id").select(F.lit("vector").alias("mode"), "doc_id", F.lit(None).cast("int").alias("chunk_index"), F.col("distance").alias("score"), F.lit(None).cast("string").alias("citation"), "source")
    return reports.parity(a.unionByName(b), c)


def q_html_text(spark, d):
    """The whole texts, escaped, put into pages under their titles and read back."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><script>var a = 1;</script></head><nav>menu</nav><h1>"), escaped("title"), F.lit("</h1><p>"), escaped("content"), F.lit("</p><style>p {}</style></html>"))
    return files.html_texts(tables.documents(spark, d).select("doc_id", page.alias("html")), "html").select("doc_id", "text")


def q_etl_sections(spark, d):
    """Sections of statutes with dashed headers, made of titles and whole texts."""
    text = F.concat(F.lit("---\ntitle: "), F.coalesce("title", F.lit("none")), F.lit("\nsection: "), F.col("doc_id") % 7, F.lit("\n---\n"), F.translate("content", "-\r", "  "))
    docs = tables.documents(spark, d).where("format = 'legislation' and content is not null").select("doc_id", text.alias("content"))
    return etl.sections(spark, docs).select("doc_id", "identifier", "section_type", "content")


def q_legacy_chunks(spark, d):
    """Chunks by the kind of document: sections, headed parts or paragraphs."""
    docs = tables.documents(spark, d).withColumn("kind", F.coalesce("format", F.lit("txt")))
    return chunking.chunk_by_kind(spark, docs).select("doc_id", "chunk_index", "section", F.length("text").alias("chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_DATE = S.json("date")
_KEY = "coalesce(md_url, 'doc' || doc_id)"
_FILES = "(select distinct * from embedding_session_files)"
_EV = "ev as (select 's' || (user_id % 20) as session, ts, case when event_type = 'error' then 'error' else 'ok' end as status, cast(json_extract_string(props, '$.k') as bigint) as chunks, value, event_type from events)"
_TELEMETRY = f"""with {_EV}, t as (select session, count(*) filter (where status = 'ok') as files_ok, count(*) filter (where status = 'error') as files_failed, coalesce(cast(sum(chunks) filter (where status = 'ok') as bigint), 0) as chunks,
round(avg(value) filter (where status = 'ok'), 2) as mean_parse_ms, (epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000) / 60 as minutes from ev group by session),
r as (select session, files_ok, files_failed, chunks, mean_parse_ms, round(files_ok / nullif(minutes, 0), 2) as files_per_min, round(chunks / nullif(minutes, 0), 2) as chunks_per_min from t)"""
_URLS = "(" + ", ".join(f"'{u}'" for u in URLS) + ")"
_TYPED = "case when lower(md_type) = 'case' then 'cases' when lower(md_type) = 'legislation' then 'legislation' when lower(md_type) = 'journal' then 'journals' when lower(md_type) = 'treaty' then 'treaties'"

_CHILD = "case when ascii(substr(session_name, length(session_name), 1)) % 3 = 0 then substr(session_name, 1, 17) || '-gpu' || (ascii(substr(session_name, length(session_name) - 1, 1)) % 16) else session_name end"
_AS_HCA = "case when md_database = 'HCVR' then ' Hca ' else md_database end"
_DOC_TYPE = r"select doc_id, {known} when contains(lower(substr(text, 1, 1000)), ' v ') or contains(lower(substr(text, 1, 1000)), ' appellant') or contains(lower(substr(text, 1, 1000)), ' respondent') then 'case' when contains(lower(substr(text, 1, 1000)), ' section ') or regexp_matches(lower(substr(text, 1, 1000)), '\bs\.\s*\d') then 'legislation' when regexp_matches(lower(regexp_replace(text, '^\s+', '')), '(?m)^(?:[ivxlcdm]+\.|\d+\.)') then 'journal' else 'txt' end as doc_type from documents where text is not null"
_RECORDS = "select {names}" + ", ".join(f"arg_min({c}, id) filter (where {c} is not null) as {c[3:]}" for c in ("md_url", "md_jurisdiction", "md_subjurisdiction", "md_database", "md_date", "md_year", "md_title")) + " from {rows} group by {key}"
_CHILDREN = "with {E}, k as (select *, " + _KEY + " as key from emb where md_type = '{t}' and doc_id is not null), heads as (select key, min(id) as head, " + ", ".join(f"arg_min({c}, id) filter (where {c} is not null) as {c}" for c in ("md_title", "md_jurisdiction", "md_subjurisdiction", "md_year")) + " from k group by key), owners as (select key, case when coalesce(md_title, md_jurisdiction, md_subjurisdiction, cast(md_year as varchar)) is null then head else min(head) over (partition by md_title, md_jurisdiction, md_subjurisdiction, md_year) end as record from heads), c as (select distinct record, unnest({values}) as x from k join owners using (key)) select x as {name}, count(*) as records from c group by x"
_ERRORS = "errors as (select case when event_id % 4 > 0 then event_type end as stage, event_type || ': ' || case when event_id % 5 = 0 then 'Timeout' when event_id % 7 = 0 then 'status 429' else 'other' end as error from events)"
_SUMS = {"files_total": "count(*)", "files_complete": "count(*) filter (where status = 'ok')", "files_error": "count(*) filter (where status = 'error')", "chunks_total": "coalesce(sum(chunks), 0)", "files_per_min": "round(count(*) filter (where status = 'ok') / (sum(value) / 60000), 2)", "chunks_per_min": "round(coalesce(sum(chunks), 0) / (sum(value) / 60000), 2)", **{f"avg_{c}_ms": "round(avg(value), 2)" for c in ("file_duration", "parse", "chunk", "embed", "insert")}, "retry_like_errors": "max((select count(*) from errors where contains(lower(error), 'timeout') or contains(error, '429') or contains(lower(error), 'retry')))"}
ORACLES: dict[str, str] = {
    "loading_report": f"with {_EV}, {_ERRORS} " + " union all ".join(f"select 'report' as what, '{k}' as value, cast({x} as double) as n from ev" for k, x in _SUMS.items()) + " union all select 'stage', coalesce(stage, 'unknown'), cast(count(*) as double) from errors group by 2 union all (select 'type', split_part(error, ':', 1), cast(count(*) as double) as n from errors group by 2 order by n desc, 2 limit 10)",
    "session_file_counts": "with l as (select session_name, filepath, coalesce(arg_max(status, struct_pack(t := coalesce(completed_at, timestamptz '1600-01-01'), s := status)) filter (where status is not null), 'pending') as status from embedding_session_files group by session_name, filepath) select session_name, status, count(*) as n from l group by session_name, status",
    "ledger_sessions": "select session_name, started_at, case when ended_at is not null then greatest(ended_at, started_at + interval 2 minutes) end as ended_at, directory, case when ended_at is not null then 'complete' else 'active' end as status, total_files, last_file, last_chunk, processed_chunks from embedding_sessions",
    "session_rollup": f"""with s as (select {_CHILD} as session_name, total_files, processed_chunks, status from embedding_sessions), f as (select {_CHILD} as session_name, count(*) as done from {_FILES} where status = 'complete' group by 1),
r as (select s.*, coalesce(done, 0) as done, nullif(regexp_extract(session_name, '^(.*)-gpu([0-9]|1[0-5])$', 1), '') as parent from s left join f using (session_name)),
o as (select session_name as session, true as own, 0 as children, coalesce(sum(total_files), 0) as t, sum(done) as c, coalesce(sum(processed_chunks), 0) as p, max(status) as status from r group by 1),
k as (select parent as session, false as own, count(*) as children, coalesce(sum(total_files), 0) as t, sum(done) as c, coalesce(sum(processed_chunks), 0) as p, null::varchar as status from r where parent is not null and parent not in (select session from o) group by 1)
select session, own, cast(children as bigint) as children, cast(t as bigint) as total_files, cast(c as bigint) as completed_files, cast(p as bigint) as processed_chunks, status, case when t > 0 then least(1.0, round(c / t, 4)) else 0.0 end as file_ratio from (from o union all from k)""",
    "list_documents": "select doc_id, source, format from documents order by doc_id limit 100",
    "document_by_id": "select doc_id, source, text as content, format from documents where doc_id = (select min(doc_id) from documents)",
    "recent_chunks": f"select id, doc_id, chunk_index, coalesce(list_contains(json_keys(chunk_metadata), 'title'), false) as has_title, try_cast({S.json('tokens_est')} as integer) as tokens from chunk_embeddings order by created_at desc nulls last, id desc limit 20",
    "md_date_parse": f"select id, cast(try_strptime(case when regexp_matches(split_part({_DATE}, ' ', 1), '^\\d{{4}}-\\d{{2}}-\\d{{2}}') then substr({_DATE}, 1, 10) end, '%Y-%m-%d') as date) as date, case when regexp_full_match({S.json('year')}, '[0-9]{{1,6}}') then cast({S.json('year')} as integer) end as year from chunk_embeddings",
    "loose_date_parse": f"""with v as (select id, trim({_DATE}) as v from chunk_embeddings), p as (select id, v, cast(case when regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') then try_strptime(substr(v, 1, 10), '%Y-%m-%d') when regexp_matches(v, '^\\d{{2}}-\\d{{2}}-\\d{{4}}') then try_strptime(substr(v, 1, 10), '%d-%m-%Y') when regexp_matches(v, '^\\d{{4}}$') then try_strptime(v || '-01-01', '%Y-%m-%d') end as date) as date from v)
select id, date, strftime(date, '%Y-%m-%dT00:00:00Z') as iso from p""",
    "case_headings": """select doc_id, list_aggregate(list_transform(string_split(title || '; Second Name', ';'), lambda x: trim(x)), 'string_agg', '|') as names,
'[2001] ABC ' || (doc_id % 50) || '|ABC ' || (doc_id % 50) || '|(1999) 3 DEF ' || (doc_id % 7) || '|3 DEF ' || (doc_id % 7) as citations, '2001-03-' || lpad(cast(doc_id % 28 + 1 as varchar), 2, '0') || ' 00:00:00' as date
from documents where title is not null and not contains(title, '&') and not contains(title, chr(10)) and not contains(title, '[')""",
    "stable_ids": "select doc_id, cast('0x' || substr(sha1('doc:' || doc_id), 1, 15) as bigint) as stable_id, sha1(coalesce(source, '') || '|0|' || coalesce(url, '')) as doc_key from documents",
    "token_counts": r"select doc_id, cast(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b]')) as integer) as tokens from documents where text is not null",
    "sentence_counts": r"select doc_id, cast(len(string_split(regexp_replace(text, '([.!?])[ \t\n\r]+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1))) as integer) as sentences, cast(len(regexp_split_to_array(text, '\n\n+')) as integer) as paragraphs from documents where text is not null",
    "char_windows": "with w as (select doc_id, text, unnest(range(0, greatest(0, length(text) - 201) + 1, 3800)) as start_char from documents where length(text) > 0) select doc_id, cast(start_char / 3800 as integer) as chunk_index, cast(start_char as integer) as start_char, cast(length(substr(text, start_char + 1, 4000)) as integer) as chars, md5(substr(text, start_char + 1, 4000)) as md5 from w",
    "doc_type_detect": _DOC_TYPE.format(known="case when lower(format) in ('case', 'legislation', 'journal') then lower(format)"),
    "doc_type_by_text": _DOC_TYPE.format(known="case when false then ''"),
    "bucket_routing": f"with {S.EMB}, {S.bucket_sql(_AS_HCA)} select doc_id, bucket from bk",
    "path_types": f"with p as (select id, lower('/au/' || (['HCA', 'Treaties', 'journals', 'legis', 'entreaty', 'cases'])[id % 6 + 1] || filepath) as p from {_FILES}) select id, case when contains(p, '/hca/') then 'hca' when contains(p, '/treat') then 'treaties' when contains(p, '/journal') then 'journals' when contains(p, '/legis') then 'legislation' else 'cases' end as bucket from p",
    "path_metadata": rf"""with p as (select id, list_filter(string_split(filepath, '/'), lambda x: x <> '') as p from {_FILES}), f as (select id, p[1:len(p) - 1] as d, p[-1] as file, list_filter(p, lambda x: not regexp_full_match(x, '(19|20)\d\d')) as q from p)
select id, coalesce(array_to_string(list_filter(d, lambda x: not regexp_full_match(x, '(19|20)\d\d')), '/'), '') as folders, file, cast(list_filter(d, lambda x: regexp_full_match(x, '(19|20)\d\d'))[-1] as integer) as year, lower(nullif(regexp_extract(file, '\.([A-Za-z0-9]+)$', 1), '')) as extension,
lower(q[1]) as jurisdiction_guess, case when len(q) >= 2 then case when contains(q[-1], '.') then q[-2] else q[-1] end end as court_guess, case when len(q) >= 3 then lower(q[2] || '/' || q[3]) end as series_guess from f""",
    "canonical_urls": "select doc_id, 'https://x.example/base/au/cases/' || coalesce(lang, 'none') || '/' || upper(coalesce(format, 'x')) || '/' || doc_id || '.html' as url, coalesce(lang, 'none') as jurisdiction, upper(coalesce(format, 'x')) as court from documents",
    "citations_of_metadata": f"with e as (select id, chunk_metadata from chunk_embeddings), c as (select id, cast(json_extract_string(chunk_metadata, '$.citations[*]') as varchar[]) as many, {S.json('citation')} as one from e), u as (select id, trim(unnest(many)) as citation from c union select id, trim(one) from c) select distinct id, citation from u where citation is not null and citation <> ''",
    "zigzag_order": "with r as (select doc_id, row_number() over (order by n_chars desc, doc_id) as d, row_number() over (order by n_chars, doc_id desc) as u from documents where n_chars is not null) select doc_id, cast(case when d <= u then 2 * d - 1 else 2 * u end as bigint) as position from r",
    "balanced_shards": "select true as by_size, cast(8 as bigint) as shards, count(*) as files, count(distinct doc_id) as distinct_files, cast(sum(coalesce(n_chars, 0)) as bigint) as size, true as sized from documents",
    "even_shards": "with p as (select lpad(cast(doc_id as varchar), 20, '0') as path from documents) select path, cast(ntile(8) over (order by path) - 1 as integer) as part, false as by_size from p",
    "even_partition": "select session_name, cast(ntile(7) over (order by session_name) - 1 as integer) as part from embedding_sessions",
    "round_robin_partition": "select session_name, cast((row_number() over (order by session_name) - 1) % 7 as integer) as part from embedding_sessions",
    "gini_sizes": "with r as (select source, n_chars, row_number() over (partition by source order by n_chars) as i from documents where source is not null and n_chars >= 0) select source, count(*) as n, round(coalesce(2.0 * sum(i * n_chars) / (count(*) * nullif(sum(n_chars), 0)) - (count(*) + 1) / count(*), 0), 6) as gini from r group by source",
    "partition_coverage": f"with f as (select distinct filepath from embedding_session_files), c as (select filepath, count(*) as n from {_FILES} where status <> 'pending' group by filepath), b as (select n from f left join c using (filepath)) select count(*) as files, cast(coalesce(sum(n), 0) as bigint) as assigned, count(n) as distinct_assigned, count(*) filter (where n is null) as missing, count(*) filter (where n > 1) as repeated, count(*) filter (where n is null) = 0 and count(*) filter (where n > 1) = 0 and count(n) = count(*) as complete from b",
    "resume_anti_join": "select distinct session_name, filepath from embedding_session_files f where not exists (select 1 from embedding_session_files g where g.status = 'complete' and g.session_name = f.session_name and g.filepath = f.filepath)",
    "session_progress": f"with c as (select session_name, count(*) filter (where status = 'complete') as complete, count(*) filter (where status = 'error') as error, count(*) filter (where status = 'pending') as pending, max(completed_at) as last_at from {_FILES} group by session_name) select session_name, status, round(processed_chunks / nullif(total_chunks, 0), 4) as share, coalesce(complete, 0) as complete, coalesce(error, 0) as error, coalesce(pending, 0) as pending, last_at from embedding_sessions left join c using (session_name)",
    "incomplete_sessions": "select session_name, status, last_file, last_chunk from embedding_sessions where coalesce(status <> 'complete', true) or ended_at is null",
    "telemetry_report": _TELEMETRY + " select * from r",
    "error_histogram": "select event_type as value, count(*) as n from events group by event_type order by n desc, value limit 10",
    "bench_collect": _TELEMETRY + " select session, files_per_min, round(100 * files_failed / nullif(files_ok + files_failed, 0), 2) as fail_rate_pct from r order by files_per_min desc, session limit 10",
    "latency_percentiles": f"with {_EV}, l as (select session, list_sort(list(value)) as v, round(quantile_cont(value, 0.95), 6) as p95_linear from ev group by session) select session, p95_linear, v[cast(round_even(0.95 * (len(v) - 1), 0) as integer) + 1] as p95_nearest, v[cast(round_even(0.5 * (len(v) - 1), 0) as integer) + 1] as p50_nearest from l",
    "chat_history_window": "with r as (select *, row_number() over (partition by user_id order by event_id desc) as r from events) select user_id as conv_id, string_agg(upper(substr(event_type, 1, 1)) || substr(event_type, 2) || ': ' || coalesce(props, ''), chr(10) order by event_id) as history from r where r <= 4 group by user_id",
    "cohort_sizing": "select md_type, count(*) as n, cast(pow(2, ceil(log2(greatest(1024, ceil(sqrt(count(*))))))) as integer) as lists from chunk_embeddings group by md_type",
    "delete_preview": f"with {S.EMB}, h as (select * from emb where md_url in {_URLS}) select count(*) as chunks, count(distinct doc_id) as doc_ids, (select count(*) from documents where doc_id in (select doc_id from h)) as documents, list_sort(list(distinct doc_id))[1:10] as sample from h",
    "delete_survivors": f"with {S.EMB}, s as (select id, doc_id from emb where not coalesce(md_url in {_URLS}, false)), g as (select doc_id from emb where md_url in {_URLS} and doc_id is not null) select 'chunk' as kind, id from s union all select 'document', doc_id from documents where not (doc_id in (select doc_id from g) and doc_id not in (select doc_id from s where doc_id is not null)) union all select 'deleted document', doc_id from documents where doc_id in (select doc_id from g) and doc_id not in (select doc_id from s where doc_id is not null)",
    "migration_left_join": "select doc_id, id, chunk_index, source, format from chunk_embeddings left join documents using (doc_id)",
    "table_counters": "select 'documents' as table_name, coalesce(max(doc_id), 0) as counter, count(*) as n from documents union all select 'chunk_embeddings', coalesce(max(id), 0), count(*) from chunk_embeddings union all select 'cases', coalesce(max(case_id), 0), count(*) from cases",
    "etl_cases": f"with {S.EMB} " + _RECORDS.format(names="", rows="emb where md_type = 'case' and doc_id is not null", key=_KEY),
    "etl_records": f"""with {S.EMB}, seen as ({_DOC_TYPE.format(known="case when false then ''")}), k as (select emb.*, {_KEY} as key, coalesce(nullif(lower(trim(md_type)), ''), doc_type, 'txt') as kind from emb left join seen using (doc_id) where doc_id is not null),
heads as (select kind, key, min(id) as head, """ + ", ".join(f"arg_min({c}, id) filter (where {c} is not null) as {c}" for c in ("md_title", "md_jurisdiction", "md_subjurisdiction", "md_year")) + """ from k where kind in ('case', 'legislation', 'journal', 'treaty') group by kind, key),
owners as (select kind, key, case when kind = 'case' or coalesce(md_title, md_jurisdiction, md_subjurisdiction, cast(md_year as varchar)) is null then head else min(head) over (partition by kind, md_title, md_jurisdiction, md_subjurisdiction, md_year) end as record from heads),
r as (select k.*, record from k join owners using (kind, key)) """ + _RECORDS.format(names="kind, ", rows="r", key="kind, record"),
    "etl_citations": f"with {S.EMB}, c as (select distinct {_KEY} as k, trim(unnest(list_concat(coalesce(md_citations, []), [{S.json('citation')}]))) as citation from emb where md_type = 'case' and doc_id is not null) select citation, count(*) as records from c where citation <> '' group by citation",
    "etl_authors": _CHILDREN.format(E=S.EMB, t="journal", values="['A' || (doc_id % 9), 'B' || (doc_id % 4)]", name="author"),
    "etl_countries": _CHILDREN.format(E=S.EMB, t="treaty", values="['Land ' || (doc_id % 5), 'Land ' || (doc_id % 3)]", name="country"),
    "case_names": rf"with {S.EMB}, t as (select doc_id, md_title as t from emb where md_type = 'case' and doc_id is not null and md_title is not null), m as (select doc_id, t, regexp_extract(t, '([A-Z][A-Za-z0-9.\-& ]+)\s+v\s+([A-Z][A-Za-z0-9.\-& ]+)', ['a', 'b']) as p from t), n as (select doc_id, trim(t) as name from t union select doc_id, trim(p.a) || ' v ' || trim(p.b) from m where p.a <> '') select distinct doc_id, name from n where name <> ''",
    "citation_variants": r"select case_id, trim(regexp_replace(upper(citation), '\s+', ' ', 'g')) as citation, count(*) as n from case_citation_refs group by 1, 2",
    "cases_upsert": f"with {S.EMB}, r as (select arg_min(md_jurisdiction, id) filter (where md_jurisdiction is not null) as j, arg_min(md_date, id) filter (where md_date is not null) as dt, md_url as url from emb where md_type = 'case' and doc_id is not null and md_url is not null group by md_url) select case_id, url, coalesce(jurisdiction, j) as jurisdiction, coalesce(case_date, dt) as case_date from cases left join r using (url)",
    "duplicate_files": "select id, filepath, count(*) as n from embedding_session_files group by all having count(*) > 1",
    "chunks_by_source_month": "select source, strftime(make_timestamp(epoch_us(created_at)), '%Y-%m') as month, count(*) as chunks from chunk_embeddings join documents using (doc_id) group by 1, 2",
}
_KEYS = ("type", "jurisdiction", "title", "citations", "tokens_est")
ORACLES["key_presence"] = " union all ".join(f"select '{k}' as key, count(*) filter (where list_contains(json_keys(chunk_metadata), '{k}')) as present, count(*) filter (where list_contains(json_keys(chunk_metadata), '{k}') and {S.json(k)} is null) as null_value from chunk_embeddings where chunk_metadata is not null" for k in _KEYS)
ORACLES["parity_field_diff"] = f"""with {S.EMB}, near as (select *, {S.json('citation')} as citation from emb where {S.USABLE} order by 1 - list_cosine_similarity(cast(vector as double[]), {S.QUERY_SQL}), id limit 30),
f as (select count(*) as n, count(source) as s from documents where text ilike '%credible easement%'), c as (select count(*) as n, count(d.source) as s from near join documents d using (doc_id)), a as (select count(*) as n, count(citation) as c from near)
select 'vector' as mode, 'chunk_index' as field, 'left' as side, a.n as count_left, c.n as count_right from a, c union all select 'vector', 'citation', 'left', a.n, c.n from a, c where a.c > 0 union all select 'vector', 'source', 'right', a.n, c.n from a, c where c.s > 0
union all select 'text', unnest(['doc_id', 'chunk_index', 'score']), 'left', f.n, 0 from f where f.n > 0 union all select 'text', 'source', 'left', f.n, 0 from f where f.s > 0"""
ORACLES["natural_sort"] = r"with f as (select distinct filepath from embedding_session_files), k as (select filepath, regexp_replace(regexp_replace(lower(filepath), '(\d+)', '00000000000000000000\1', 'g'), '0*(\d{20})(\D|$)', '\1\2', 'g') as k from f) select filepath, cast(row_number() over (order by k, filepath) as integer) as position from k"
_YEAR = "nullif(regexp_extract(" + S.json("year") + r", '\b((?:18|19|20)\d{2})\b', 1), '')"
_THERE = " + ".join("cast(list_contains(json_keys(chunk_metadata), '" + k + "') as integer)" for k in ("url", "citation", "title", "jurisdiction", "subjurisdiction", "court", "date", "database", "author", "judge", "bench", "section", "chapter", "part", "division", "act", "regulation", "type", "source"))
ORACLES["metadata_sanitised"] = "select id, cast(coalesce(" + _THERE + " + cast(" + _YEAR + " is not null as integer), 0) as integer) as keys, " + S.json("type") + " as type, " + _YEAR + " as year, substr(" + S.json("title") + ", 1, 20) as title from chunk_embeddings"
ORACLES["context_block"] = f"with {S.EMB}, top as (select doc_id, row_number() over (order by 1 - list_cosine_similarity(cast(vector as double[]), {S.QUERY_SQL}), id) as rank from emb where {S.USABLE} qualify rank <= 5), h as (select rank, '[' || row_number() over (order by rank) || '] ' || coalesce(source, '') || chr(10) || case when length(coalesce(text, '')) > 200 then substr(text, 1, 200) || '...' else coalesce(text, '') end as part from top join documents using (doc_id)) select string_agg(part, chr(10) || chr(10) order by rank) as context from h"
_SPACE = "' ' || " + " || ".join(f"chr({c})" for c in (*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
ORACLES["html_text"] = f"select doc_id, concat_ws(chr(10), nullif(trim(title, {_SPACE}), ''), nullif(trim(text, {_SPACE}), '')) as text from documents"
_SECTIONS = "select doc_id, cast(doc_id % 7 as varchar) as identifier, case when contains(lower(coalesce(title, 'none')), 'schedule') then 'schedule' when contains(lower(coalesce(title, 'none')), 'regulation') or contains(lower(coalesce(title, 'none')), 'reg.') then 'regulation' else 'section' end as section_type from documents where format = 'legislation' and text is not null"
_BREAKS = "[" + "".join(rf"\x{{{c:x}}}" for c in (11, 12, 28, 29, 30, 0x85, 0x2028, 0x2029)) + "]"
ORACLES["etl_sections"] = _SECTIONS.replace(" from documents", f", trim(regexp_replace(replace(replace(text, '-', ' '), chr(13), ' '), '{_BREAKS}', chr(10), 'g'), {_SPACE}) as content from documents")
ORACLES["duplicate_files"] = "select id, filepath, n from (select *, count(*) as n from embedding_session_files group by all) where n > 1"
ORACLES["etl_sections"] += f" and trim(text, {_SPACE} || '-') <> ''"
ORACLES["overlap_recall"] = "with " + ", ".join(S.bm25({"content": 1.0}, q, "and", name=f"b{i}") for i, q in enumerate(("credible easement", "harbour guarantee"))) + " " + " union all ".join(f"select '{q}' as query, (select cast(least(count(*), 20) as integer) from b{i}) as left, (select cast(count(*) as integer) from documents where text ilike '%{q}%') as right, (select cast(count(*) as integer) from (select doc_id from b{i} order by round(score, 9) desc, doc_id limit 20) join documents using (doc_id) where text ilike '%{q}%') as common, round((select count(*) from (select doc_id from b{i} order by round(score, 9) desc, doc_id limit 20) join documents using (doc_id) where text ilike '%{q}%') / nullif((select count(*) from documents where text ilike '%{q}%'), 0), 4) as share" for i, q in enumerate(("credible easement", "harbour guarantee")))
_HELD = "with q as (select * from (values ('wharf', ['wharf', 'dam', 'zebra']), ('easement', ['easement', 'credible'])) t(query, terms)), h as (select query, terms, " + S.words("coalesce(text, '')") + " as w from q join documents on text ilike '%' || query || '%' qualify row_number() over (partition by query order by doc_id) <= 10), f as (select query, terms, list_filter(terms, lambda t: list_contains(w, t)) as found from h)"
ORACLES["term_coverage"] = _HELD + " select query, bool_or(len(found) > 0) as hit, round(avg(cast(len(found) > 0 as integer)), 4) as top_match_rate, round(len(list_distinct(flatten(list(found)))) / len(any_value(terms)), 4) as coverage from f group by query"
#: Paragraphs are packed by folding: parts are held in one text, divided by a private character; another closes a part.
_LAST = "split_part(acc, chr(57344), -1)"
_PACK = f"list_reduce({{of}}, lambda acc, x: case when not (ends_with({_LAST}, chr(57345)) or starts_with(x, chr(57345))) and length({_LAST}) + {{glue}} + length(x) <= 1500 then acc || {{by}} || x else acc || chr(57344) || x end)"
_CUT = f"chr(57345) || array_to_string(list_transform(range(0, length(y), 1500), lambda i: trim(substr(y, i + 1, 1500), {_SPACE})), chr(57344)) || chr(57345)"
_BY_SENTENCE = _PACK.format(of=f"list_transform(string_split(regexp_replace(b, '([.?!]) +', '\\1' || chr(57346), 'g'), chr(57346)), lambda y: case when length(y) > 1500 then {_CUT} else y end)", glue=1, by="' '")
_PIECES = f"""p as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '(?:\\r?\\n){{2,}}'), lambda x: trim(x, {_SPACE})), lambda x: x <> '') as ps from documents where text is not null),
b as (select doc_id, string_split({_PACK.format(of='ps', glue=2, by='chr(10) || chr(10)')}, chr(57344)) as bs from p where len(ps) > 0),
c as (select doc_id, flatten(list_transform(bs, lambda b: case when length(b) <= 1500 then [b] else list_transform(string_split({_BY_SENTENCE}, chr(57344)), lambda z: replace(z, chr(57345), '')) end)) as cs from b)"""
ORACLES["chunk_paragraphs"] = f"""with {_PIECES},
k as (select doc_id, case when len(list_filter(cs, lambda z: length(z) >= 50)) > 0 then list_filter(cs, lambda z: length(z) >= 50) else cs[1:1] end as cs from c),
u as (select doc_id, unnest(cs) as text, generate_subscripts(cs, 1) - 1 as i from k)
select doc_id, cast(i as integer) as chunk_index, '' as section, text, cast(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]')) as integer) as tokens, 'paragraphs' as strategy from u"""
#: Headed parts of articles; statutes of the test tables have no dashed sections.
_PARTS = f"""l as (select doc_id, unnest(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: trim(x, {_SPACE}))) as line, generate_subscripts(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), 1) as i from documents where lower(trim(format)) = 'journal' and text is not null),
h as (select *, regexp_matches(line, '^([IVXLCDM]+\\.|[0-9]+\\.|[A-Z]\\.)\\s+.*') as heads from l), g as (select *, sum(cast(heads as integer)) over (partition by doc_id order by i) as part from h),
t as (select doc_id, part, coalesce(max(line) filter (where heads), '') as section, trim(string_agg(line || case when heads then chr(10) else ' ' end, '' order by i), {_SPACE}) as text from g group by doc_id, part),
parts as (select * from t where length(text) >= 150), whole as (select doc_id from parts group by doc_id having max(length(text)) <= 1500)"""
ORACLES["legacy_chunks"] = f"""with {_PIECES}, {_PARTS}, u as (select doc_id, lower(trim(coalesce(format, 'txt'))) as kind, unnest(cs) as text, generate_subscripts(cs, 1) - 1 as i from c join documents using (doc_id)),
k as (select doc_id, section, text, part as i from parts where doc_id in (from whole)
  union all select doc_id, 'para_' || i, text, i from u where kind in ('legislation', 'journal', 'case') and length(text) >= 150 and doc_id not in (from whole)),
every as (select * from k union all select doc_id, '', text, i from u where length(text) >= 50 and doc_id not in (select doc_id from k))
select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as integer) as chunk_index, section, cast(length(text) as integer) as chars from every"""
