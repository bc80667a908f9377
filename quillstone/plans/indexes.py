"""Indexes over the tables of a data folder, built when a query first needs them and kept while the session lasts and the
files are the same. On a cluster, build them once with Postings.build and VectorIndex.build and keep the objects."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillstone import tables
from quillstone.operators.postings import Postings
from quillstone.operators.vector import VectorIndex
from quillstone.runtime import Scope, exists

_kept: dict[tuple, Any] = {}


def _state(spark: SparkSession, d: str, name: str) -> tuple:
    """What tells one state of a table from another: its place, time, files and bytes."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    summary = fs.getContentSummary(path)
    return path.toString(), fs.getFileStatus(path).getModificationTime(), summary.getFileCount(), summary.getLength()


def _keep(spark: SparkSession, d: str, kind: str, names: tuple[str, ...], build: Callable[[], Any]) -> Any:
    key = (spark.sparkContext.applicationId, kind, *(_state(spark, d, n) for n in names))
    if key not in _kept or not exists(spark, _kept[key].path):
        _kept[key] = build()
    return _kept[key]


def documents(spark: SparkSession, d: str) -> Postings:
    """Texts and titles of documents by doc_id."""
    docs = tables.documents(spark, d)
    return _keep(spark, d, "documents", ("documents",), lambda: Postings.build(spark, docs, "doc_id", ["content", "title"]))


def chunks(spark: SparkSession, d: str) -> Postings:
    """Chunks by id: title, citations, content (the chunk's part of its document), text_preview, chunk_metadata_text; the
    join behind them is written first, as the index looks at its rows more than once."""

    def build() -> Postings:
        fields = {"title": "title", "citations": F.array_join("citations", " "), "content": "content", "text_preview": "text_preview", "chunk_metadata_text": "chunk_metadata_text"}
        with Scope(spark) as scope:
            rows = scope.written(tables.hits(spark, d).select("id", *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items()]), "hits")
            return Postings.build(spark, rows, "id", list(fields), places=["content"])

    return _keep(spark, d, "chunks", ("documents", "chunk_embeddings"), build)


def vectors(spark: SparkSession, d: str) -> VectorIndex:
    """The usable vectors of all chunks by id."""
    rows = tables.embeddings(spark, d)
    return _keep(spark, d, "vectors", ("chunk_embeddings",), lambda: VectorIndex.build(spark, rows.select("id", "vector"), "id", "vector", 64))
