"""The logical tables of the retrieval queries over the stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import metadata as M
from quillstone.runtime import table


def documents(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, content, format, url, title)."""
    return table(spark, d, "documents").select("doc_id", "source", F.col("text").alias("content"), "format", "url", "title", "lang")


def with_metadata(chunks: DataFrame) -> DataFrame:
    """Chunks with the columns that chunk_metadata holds; those that a query doesn't use are never parsed."""
    m = F.col("chunk_metadata")
    one = {f"md_{k}": M.text_of(m, k) for k in ("jurisdiction", "subjurisdiction", "title", "author", "citation", "url", "court")}
    many = {f"md_{k}": M.list_of(m, k) for k in ("countries", "titles", "citations")}
    e = chunks.withColumns(one | many)
    return e.withColumns({"md_title_lc": F.lower(F.coalesce("md_title", F.lit(""))), "md_author_lc": F.lower(F.coalesce("md_author", F.lit("")))})


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return with_metadata(table(spark, d, "chunk_embeddings"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as search sees them: (id, doc_id, chunk_index, md_type, prod_bucket, title, citations, content, text_preview,
    chunk_metadata_text). content is the chunk's part of its document, null where its place isn't known; text_preview its
    first 500 characters; prod_bucket that of its document (see metadata.buckets)."""
    m = F.col("chunk_metadata")
    e = embeddings(spark, d)
    place = {f"_{k}": M.text_of(m, f"{k}_char").try_cast("int") for k in ("start", "end")}
    rows = e.select("id", "doc_id", "chunk_index", "md_type", F.col("md_title").alias("title"), F.col("md_citations").alias("citations"), m.alias("chunk_metadata_text"), *[c.alias(k) for k, c in place.items()])
    docs = documents(spark, d).select("doc_id", F.col("content").alias("_text"))
    rows = rows.join(docs, "doc_id", "left").join(M.buckets(e, "doc_id").withColumnRenamed("bucket", "prod_bucket"), "doc_id", "left")
    content = F.when(F.col("_end") > F.col("_start"), F.substr("_text", F.col("_start") + 1, F.col("_end") - F.col("_start")))
    return rows.withColumn("content", content).select("id", "doc_id", "chunk_index", "md_type", F.coalesce("prod_bucket", F.lit("cases")).alias("prod_bucket"), "title", "citations", "content", F.substring("content", 1, 500).alias("text_preview"), "chunk_metadata_text")
