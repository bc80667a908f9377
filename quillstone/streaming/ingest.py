"""Incremental loading: files arrive in a folder, each batch is chunked and written once, however often it is retried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.functions import metadata as M
from quillstone.operators.chunking import chunk
from quillstone.operators.embedding import embed
from quillstone.operators.etl import upsert
from quillstone.runtime import Scope

DOCUMENTS = "doc_id bigint, source string, text string"


def keyed_chunks(spark: SparkSession, documents: DataFrame, strategy: str = "cascade") -> DataFrame:
    """Chunks with ids that depend on their document, place and text only, so that loading again gives the same rows."""
    rows = chunk(spark, documents, strategy, text_col="text")
    key = M.doc_key(F.col("doc_id").cast("string"), F.col("chunk_index"), F.col("text"))
    return rows.withColumn("doc_key", key).withColumn("chunk_id", M.stable_id(F.concat(F.lit("emb:"), M.emb_key(F.col("doc_key"), F.col("chunk_index"))))).drop("doc_key")


def load(spark: SparkSession, documents: DataFrame, to: str, batch: int = 0, strategy: str = "cascade", dim: int = 64, metadata_col: str | None = None) -> None:
    """Load a batch of documents as two tables below `to`: documents (id, source, content, format), one row per chunk, and
    embeddings (id, doc_id, chunk_index, vector, chunk_metadata), which refers to it. Ids depend on the document, place and
    text only, and a batch overwrites its own partition of both tables, so that loading it again changes nothing. Both
    are read from one written table of chunks, so that a text is cut once. Blank texts give no rows."""
    base = documents.withColumn("_m", F.col(metadata_col) if metadata_col else F.lit("{}"))
    cut = chunk(spark, base, strategy, text_col="text", metadata_col="_m").dropDuplicates(["doc_id", "chunk_index", "text"])
    key = M.doc_key(F.col("doc_id").cast("string"), F.col("chunk_index"), F.col("text"))
    seed = lambda kind, k: M.stable_id(F.concat(F.lit(f"{kind}:"), k))
    cut = cut.withColumns({"id": seed("doc", key), "embedding_id": seed("emb", M.emb_key(key, F.col("chunk_index")))})
    known = documents.select("doc_id", "source").dropDuplicates(["doc_id"])
    kind = F.coalesce(M.text_of(F.col("chunk_metadata"), "type"), F.lit("txt"))
    with Scope(spark) as scope:
        rows = scope.written(cut.join(known, "doc_id", "left").withColumn("format", kind), "load")
        rows.select("id", "source", F.col("text").alias("content"), "format").write.mode("overwrite").parquet(f"{to}/documents/batch={batch}")
        vectors = embed(spark, rows.select("embedding_id", "id", "chunk_index", "chunk_metadata", "text"), "text", dim)
        vectors.select(F.col("embedding_id").alias("id"), F.col("id").alias("doc_id"), "chunk_index", "vector", "chunk_metadata").write.mode("overwrite").parquet(f"{to}/embeddings/batch={batch}")


def ingest(spark: SparkSession, folder: str, to: str, checkpoint: str, files_per_batch: int | None = 100, strategy: str = "cascade", schema: str = DOCUMENTS, bytes_per_batch: int | None = None) -> StreamingQuery:
    """Start loading Parquet files of documents from `folder` into `to`, a table of chunks partitioned by batch. A batch
    that is repeated after a failure overwrites its own partition; files that were loaded are in the checkpoint. Blank
    texts give no chunks and no error. A batch has at most `files_per_batch` files, or, if it is given instead, about
    `bytes_per_batch`, so that few large files and many small ones make batches of one size. Stops when
    all files that are there are loaded."""
    limit = {"maxBytesPerTrigger": bytes_per_batch} if bytes_per_batch else {"maxFilesPerTrigger": files_per_batch}
    stream = spark.readStream.schema(schema).options(**limit).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        keyed_chunks(batch.sparkSession, batch, strategy).dropDuplicates(["chunk_id"]).write.mode("overwrite").parquet(f"{to}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, to: str) -> DataFrame:
    """The loaded chunks, each once, from the newest batch that has it."""
    rows = spark.read.parquet(to)
    none = rows.where("false").drop("batch")
    newest = upsert(none.withColumn("batch", F.lit(0)), rows, ["chunk_id"], [F.desc("batch")])
    return newest.drop("batch")
