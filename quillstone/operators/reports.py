"""Reports on loading runs, searches and cohorts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.runtime import maybe_broadcast

DONE = ("ok", "complete")


def telemetry(events: DataFrame) -> DataFrame:
    """One row per session from per-file records: files by status, chunks, mean times, files and chunks a minute. Both
    spellings of success count; records with another type than file are left out."""
    f = events.where(F.coalesce(F.col("type"), F.lit("file")) == "file")
    ok = F.col("status").isin(*DONE)
    minutes = (F.max("at") - F.min("at")).cast("long") / 60
    timed = [F.round(F.avg(F.when(ok, F.col(c))), 2).alias(f"mean_{c}") for c in ("parse_ms", "chunk_ms", "embed_ms", "index_ms", "duration_ms")]
    out = f.withColumn("at", F.try_to_timestamp("ts")).groupBy("session").agg(F.count_if(ok).alias("files_ok"), F.count_if(F.col("status") == "error").alias("files_failed"), F.coalesce(F.sum(F.when(ok, F.col("chunks"))), F.lit(0)).alias("chunks"), minutes.alias("minutes"), *timed)
    per = [F.round(F.col(c) / F.nullif(F.col("minutes"), F.lit(0.0)), 2).alias(f"{n}_per_min") for c, n in (("files_ok", "files"), ("chunks", "chunks"))]
    return out.select("session", "files_ok", "files_failed", "chunks", *[f"mean_{c}" for c in ("parse_ms", "chunk_ms", "embed_ms", "index_ms", "duration_ms")], *per)


def loading_report(records: DataFrame, errors: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """One row over all sessions, and the histograms of errors.

    The row: files_total, files_complete, files_error, chunks_total, files_per_min and chunks_per_min (by the files' own
    durations), the means avg_file_duration_ms, avg_parse_ms, avg_chunk_ms, avg_embed_ms, avg_insert_ms of what is
    given, retry_like_errors (a retry, a timeout or status 429). Both spellings of success count, and records of any type
    but another than file. (what, value, n): errors by `stage`, and the `top` types, which are what stands before the
    first colon; null and empty are `unknown`."""
    f = records.where(F.coalesce(F.col("type"), F.lit("file")) == "file")
    status = F.lower(F.coalesce("status", F.lit("")))
    spent = F.sum("duration_ms") / 60_000
    mean = lambda c: F.coalesce(F.round(F.avg(c), 2), F.lit(0.0))
    rate = lambda x: F.coalesce(F.round(x / F.nullif(spent, F.lit(0.0)), 2), F.lit(0.0))
    done, chunks = F.count_if(status.isin(*DONE)), F.coalesce(F.sum("chunks"), F.lit(0))
    row = f.agg(
        F.count("*").alias("files_total"), done.alias("files_complete"), F.count_if(status == "error").alias("files_error"), chunks.alias("chunks_total"),
        rate(done).alias("files_per_min"), rate(chunks).alias("chunks_per_min"), mean("duration_ms").alias("avg_file_duration_ms"),
        mean("parse_ms").alias("avg_parse_ms"), mean("chunk_ms").alias("avg_chunk_ms"), mean("embed_ms").alias("avg_embed_ms"), mean("index_ms").alias("avg_insert_ms"),
    )
    text = F.lower(F.coalesce("error", F.lit("")))
    retries = errors.agg(F.count_if(text.contains("retry") | text.contains("timeout") | text.contains("429")).alias("retry_like_errors"))
    stage = F.coalesce(F.nullif("stage", F.lit("")), F.lit("unknown"))
    kind = F.when(F.coalesce("error", F.lit("")) == "", "unknown").otherwise(F.trim(F.split_part("error", F.lit(":"), F.lit(1))))
    stages = errors.groupBy(stage.alias("value")).agg(F.count("*").alias("n")).select(F.lit("stage").alias("what"), "value", "n")
    return row.crossJoin(retries), stages.unionByName(most_common(errors, kind, top).select(F.lit("type").alias("what"), "value", "n"))


def most_common(df: DataFrame, value: Column, n: int = 10) -> DataFrame:
    """(value, n): the n most frequent values, equal counts by value."""
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def nearest_ranks(df: DataFrame, by: Sequence[str], value: str, at: Mapping[str, float]) -> DataFrame:
    """(by..., names of `at`): the value at rank round(p x (n - 1)) of each group, halves rounded to even. Equal values are
    counted first; the rest is a running sum over the distinct values of a group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*by)
    upto = F.sum("_c").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.withColumn("_to", upto).withColumn("_n", F.sum("_c").over(group))
    return rows.groupBy(*by).agg(*[F.min(F.when(F.col("_to") > F.bround(p * (F.col("_n") - 1)), F.col("_v"))).alias(name) for name, p in at.items()])


def cohort_lists(chunks: DataFrame, cohort: str = "md_type") -> DataFrame:
    """(cohort, n, lists): rows of each cohort, and an index size for it: the power of two from max(1024, sqrt n) up."""
    rows = chunks.groupBy(cohort).agg(F.count("*").alias("n"))
    return rows.withColumn("lists", F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1024.0), F.ceil(F.sqrt("n")))))).cast("int"))


def delete_preview(chunks: DataFrame, documents: DataFrame, url: Column, urls: Sequence[str], sample: int = 10) -> DataFrame:
    """One row: chunks and documents with one of the urls, documents that exist, and the least doc_ids as a sample."""
    hit = chunks.where(url.isin(*urls))
    ids = hit.select("doc_id").distinct()
    there = documents.join(ids, "doc_id", "left_semi").agg(F.count("*").alias("documents"))
    first = ids.orderBy("doc_id").limit(sample).agg(F.array_sort(F.collect_list("doc_id")).alias("sample"))
    return hit.agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("doc_ids")).crossJoin(there).crossJoin(first)


def delete_by_url(chunks: DataFrame, documents: DataFrame, url: Column, urls: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks that stay, documents that stay, deleted doc_ids): chunks with the urls go, and then documents that had
    such chunks and have none left."""
    gone = F.coalesce(url.isin(*urls), F.lit(False))
    stay = chunks.where(~gone)
    deleted = chunks.where(gone & F.col("doc_id").isNotNull()).select("doc_id").distinct().join(stay.select("doc_id").distinct(), "doc_id", "left_anti")
    return stay, documents.join(deleted, "doc_id", "left_anti"), documents.join(deleted, "doc_id", "left_semi").select("doc_id")


def overlap(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query, left, right, common, share): of each query's right hits, the share that the left list has, too."""
    a = left.groupBy("query").agg(F.collect_set(key).alias("a"))
    b = right.groupBy("query").agg(F.collect_set(key).alias("b"))
    both = a.join(b, "query", "full_outer")
    common = F.size(F.array_intersect(F.coalesce("a", F.array().cast(both.schema["b"].dataType)), F.coalesce("b", F.array().cast(both.schema["b"].dataType))))
    return both.select("query", F.greatest(F.size("a"), F.lit(0)).alias("left"), F.greatest(F.size("b"), F.lit(0)).alias("right"), common.alias("common"), F.round(common / F.nullif(F.size("b"), F.lit(0)), 4).alias("share"))


def term_coverage(hits: DataFrame, expected: DataFrame, text: str = "content") -> DataFrame:
    """(query, hit, top_match_rate, coverage): whether any hit holds an expected term, the share of hits that do, and the
    share of expected terms that any hit holds. `expected`: query, terms array."""
    rows = hits.join(maybe_broadcast(expected), "query").select("query", "terms", X.words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    found = F.array_intersect("terms", "w")
    per = rows.withColumn("found", found).groupBy("query").agg(F.max(F.size("found") > 0).alias("hit"), F.round(F.avg((F.size("found") > 0).cast("int")), 4).alias("top_match_rate"), F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("n"), F.max(F.size("terms")).alias("m"))
    return per.select("query", "hit", "top_match_rate", F.round(F.col("n") / F.nullif(F.col("m"), F.lit(0)), 4).alias("coverage"))


def parity(left: DataFrame, right: DataFrame, mode: str = "mode", of: Sequence[str] = ()) -> DataFrame:
    """(mode, field, side, count_left, count_right): for each mode of two sets of search results, every field that only one
    side fills there, and the hits of both sides; a mode without such a field has one row with nulls. A field is filled
    if any hit of the mode has a value. `of`: the fields that count, by default all columns but the mode."""

    def filled(df: DataFrame, side: str) -> DataFrame:
        fields = [c for c in (of or df.columns) if c != mode and c in df.columns]
        there = df.groupBy(mode).agg(F.count("*").alias(f"count_{side}"), F.array(*[F.when(F.max(F.col(c).isNotNull()), F.lit(c)) for c in fields]).alias(side))
        return there.withColumn(side, F.array_compact(side))

    both = filled(left, "left").join(filled(right, "right"), mode, "full_outer")
    none = F.array().cast("array<string>")
    a, b = F.coalesce("left", none), F.coalesce("right", none)
    found = F.concat(F.transform(F.array_except(a, b), lambda x: F.struct(x.alias("field"), F.lit("left").alias("side"))), F.transform(F.array_except(b, a), lambda x: F.struct(x.alias("field"), F.lit("right").alias("side"))))
    counts = [F.coalesce(f"count_{s}", F.lit(0)).alias(f"count_{s}") for s in ("left", "right")]
    return both.select(mode, F.explode_outer(found).alias("x"), *counts).select(mode, "x.field", "x.side", "count_left", "count_right")


def session_rollup(sessions: DataFrame, files: DataFrame, child: str = r"^(.*)-gpu(?:[0-9]|1[0-5])$") -> DataFrame:
    """(session, own, children, total_files, completed_files, processed_chunks, status, file_ratio): progress by session. A
    session that has a row of its own counts by it; one that is only known by children (`<name>-gpu0` to `-gpu15`) by
    their sums. Repeated file rows count once."""
    done = files.distinct().where("status = 'complete'").groupBy("session_name").agg(F.count("*").alias("done"))
    rows = sessions.join(done, "session_name", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    sums = [F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("bigint").alias(n) for c, n in (("total_files", "total_files"), ("done", "completed_files"), ("processed_chunks", "processed_chunks"))]
    own = rows.groupBy(F.col("session_name").alias("session")).agg(*sums, F.max("status").alias("status")).withColumns({"own": F.lit(True), "children": F.lit(0).cast("bigint")})
    parent = F.regexp_extract("session_name", child, 1)
    kids = rows.where(F.col("session_name").rlike(child)).groupBy(parent.alias("session")).agg(*sums, F.count("*").alias("children")).withColumns({"own": F.lit(False), "status": F.lit(None).cast("string")})
    only = kids.join(own.select("session"), "session", "left_anti")
    ratio = F.when(F.col("total_files") > 0, F.least(F.lit(1.0), F.round(F.col("completed_files") / F.col("total_files"), 4))).otherwise(0.0)
    return own.unionByName(only).select("session", "own", "children", "total_files", "completed_files", "processed_chunks", "status", ratio.alias("file_ratio"))


def recent_chunks(chunks: DataFrame, n: int = 20) -> DataFrame:
    """(id, doc_id, chunk_index, has_title, tokens) of the chunks stored last; tokens is the estimate in the metadata."""
    m = F.col("chunk_metadata")
    has = F.coalesce(F.array_contains(F.json_object_keys(m), "title"), F.lit(False))
    return chunks.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(n).select("id", "doc_id", "chunk_index", has.alias("has_title"), F.get_json_object(m, "$.tokens_est").try_cast("int").alias("tokens"))


def list_documents(documents: DataFrame, limit: int = 100) -> DataFrame:
    """(doc_id, source, format) of the documents with the least ids."""
    return documents.select("doc_id", "source", "format").orderBy("doc_id").limit(limit)


def get_document(documents: DataFrame, doc_id: int) -> DataFrame:
    """(doc_id, source, content, format) of one document; no row where there is none."""
    return documents.where(F.col("doc_id") == doc_id).select("doc_id", "source", "content", "format")


def session_progress(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """(session_name, status, counts of files by status, share of chunks, last time): repeated file rows count once."""
    f = files.distinct().groupBy("session_name").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("complete", "error", "pending")], F.max("completed_at").alias("last_at"))
    share = F.round(F.col("processed_chunks") / F.nullif(F.col("total_chunks"), F.lit(0)), 4)
    return sessions.select("session_name", "status", share.alias("share")).join(f, "session_name", "left").fillna(0, ["complete", "error", "pending"])


def chat_history(turns: DataFrame, last: int = 6) -> DataFrame:
    """(conv_id, history): the last turns of each conversation, in order. `turns`: conv_id, turn, role, text."""
    recent = turns.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("r") <= last)
    line = F.concat(F.initcap("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    return recent.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("history"))


def context_block(hits: DataFrame, most: int = 1200) -> DataFrame:
    """(context): numbered sources and cut texts of a bounded list of hits, in rank order. `hits`: rank, source, text."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("source", F.lit("")), F.lit("\n"), X.preview(F.coalesce("text", F.lit("")), most, "..."))
    return hits.select("rank", part.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), "\n\n").alias("context"))
