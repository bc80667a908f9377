"""Queries on references between tables (p4_...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.operators import references
from quillstone.runtime import table

NAMES = ("chunk_embeddings", "documents", "source_sites", "embedding_session_files", "embedding_sessions")


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in NAMES}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = references.orphans(spark, _tables(spark, d)).where("kind = 'direct'")
    return found.select("table_name", "record_id", "period", "reason")


def p4_cascade(spark: SparkSession, d: str) -> DataFrame:
    return references.orphans(spark, _tables(spark, d))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(references.orphans(spark, _tables(spark, d)))


QUERIES = {f.__name__: f for f in (p4_found, p4_cascade, p4_report)}

_FOUND = """
with refs as (
  select 'chunk_embeddings' as table_name, c.id as record_id, c.created_at as own, p.doc_id is null as missing, p.deleted_at is not null as gone, p.ingested_at as since
  from chunk_embeddings c left join documents p on c.doc_id = p.doc_id where c.doc_id is not null
  union all
  select 'documents', c.doc_id, c.ingested_at, p.source is null, p.deleted_at is not null, p.added_at
  from documents c left join source_sites p on c.source = p.source where c.source is not null
  union all
  select 'embedding_session_files', c.id, c.completed_at, p.session_name is null, false, p.started_at
  from embedding_session_files c left join embedding_sessions p on c.session_name = p.session_name where c.session_name is not null
), direct as (
  select distinct table_name, record_id, coalesce(strftime(make_timestamp(epoch_us(own)), '%Y-%m'), 'none') as period,
    case when missing then 'missing' when gone then 'deleted' when since > own then 'late' end as reason from refs
)
"""
_CASCADE = _FOUND.replace("with refs", "with recursive refs") + """, links as (
  select 'chunk_embeddings' as table_name, id as record_id, created_at as own, 'documents' as parent, doc_id as parent_id from chunk_embeddings where doc_id is not null
), rows as (
  select table_name, record_id, period, reason, 0 as depth from direct where reason is not null
  union
  select l.table_name, l.record_id, coalesce(strftime(make_timestamp(epoch_us(l.own)), '%Y-%m'), 'none'), 'inherited', depth + 1
  from rows r join links l on l.parent = r.table_name and l.parent_id = r.record_id
), every as (
  select table_name, record_id, period, case when depth = 0 then 'direct' else 'inherited' end as kind, reason, depth
  from (select *, min(depth) over (partition by table_name, record_id) as least from rows) where depth = least
)
"""
ORACLES = {
    "p4_found": _FOUND + "select * from direct where reason is not null",
    "p4_cascade": _CASCADE + "select table_name, record_id, period, kind, reason, depth from every",
    "p4_report": _CASCADE + "select table_name, period, kind, reason, count(*) as n from every group by all",
}
