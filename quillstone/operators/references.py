"""References to records that are missing, deleted or late, and what follows from them down the foreign-key graph."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.joins import left_join_unique
from quillstone.runtime import Scope, maybe_broadcast


@dataclass(frozen=True)
class Reference:
    """`child.column` refers to `parent.key`. `own_time` dates the referring row, `since` the record, `deleted` marks
    records that no longer count; `record_id` names the referring row."""

    child: str
    column: str
    record_id: str
    own_time: str
    parent: str
    key: str
    since: str
    deleted: str | None = None


#: The references of this project's tables.
REFERENCES = (
    Reference("chunk_embeddings", "doc_id", "id", "created_at", "documents", "doc_id", "ingested_at", "deleted_at"),
    Reference("documents", "source", "doc_id", "ingested_at", "source_sites", "source", "added_at", "deleted_at"),
    Reference("embedding_session_files", "session_name", "id", "completed_at", "embedding_sessions", "session_name", "started_at"),
)


def month(time: Column) -> Column:
    """yyyy-MM in UTC whatever the session's time zone, `none` for null."""
    return F.coalesce(F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM"), F.lit("none"))


def _direct(tables: Mapping[str, DataFrame], references: Sequence[Reference]) -> DataFrame:
    """(table_name, by, record_id, period, reason); by: the column that names the row."""

    def one(r: Reference) -> DataFrame:
        child = tables[r.child].select(F.col(r.record_id).cast("bigint").alias("record_id"), F.col(r.column).alias("key"), F.col(r.own_time).alias("own")).where("key is not null")
        gone = F.lit(False) if r.deleted is None else F.col(r.deleted).isNotNull()
        parent = tables[r.parent].select(F.col(r.key).alias("key"), F.col(r.since).alias("since"), gone.alias("gone")).where("key is not null").groupBy("key").agg(F.min("since").alias("since"), F.min("gone").alias("gone"))
        reason = F.when(F.col("gone").isNull(), "missing").when(F.col("gone"), "deleted").when(F.col("since") > F.col("own"), "late")
        return left_join_unique(child, parent, "key").select(F.lit(r.child).alias("table_name"), F.lit(r.record_id).alias("by"), "record_id", month(F.col("own")).alias("period"), reason.alias("reason")).where("reason is not null")

    return reduce(DataFrame.unionByName, map(one, references)).distinct()


def direct_orphans(tables: Mapping[str, DataFrame], references: Sequence[Reference] = REFERENCES) -> DataFrame:
    """(table_name, record_id, period, reason) of every row whose reference has no live record at its time.

    reason is the first that holds: `missing`, `deleted`, `late` (the record came after the row's own time). Null
    references, null times and null record ids: a null reference is no case, a null time is never late and gives the
    period `none`, a null record id is kept. Rows that repeat are reported once. A key that several records hold is
    deleted only if all are, and late by the earliest. Empty tables: every reference to them is missing. Only key and
    time columns are read; keys are compared exactly.
    """
    return _direct(tables, references).drop("by").distinct()


def orphans(spark: SparkSession, tables: Mapping[str, DataFrame], references: Sequence[Reference] = REFERENCES) -> DataFrame:
    """(table_name, record_id, period, kind, reason, depth): direct orphans (depth 0) and, to a fixpoint, rows that refer
    to an orphan of any kind: `inherited`, with depth the steps to the nearest direct orphan and reason `inherited`.

    Each round semi-joins the children of the rows found last, down the graph of references, and drops rows known
    already, so that cycles end. A table may be the child of several references that name its rows by different columns;
    each is followed by its own. Every round is a written table of ids, dropped at the end; nothing is collected.
    """
    row = ["table_name", "by", "record_id"]
    with Scope(spark) as scope:
        last = scope.written(_direct(tables, references).withColumns({"kind": F.lit("direct"), "depth": F.lit(0)}), "orphans")
        known, depth = last, 0
        while not last.isEmpty():
            depth += 1
            steps = []
            for r in references:
                # the parent's rows are known by their own references' record_id, children name them by key
                for by in dict.fromkeys(x.record_id for x in references if x.child == r.parent):
                    mine = last.where((F.col("table_name") == r.parent) & (F.col("by") == by)).select("record_id")
                    parents = tables[r.parent].select(F.col(by).cast("bigint").alias("record_id"), F.col(r.key).alias("key"))
                    orphaned = parents.join(maybe_broadcast(mine), "record_id", "left_semi").select("key").distinct()
                    child = tables[r.child].select(F.col(r.record_id).cast("bigint").alias("record_id"), F.col(r.column).alias("key"), F.col(r.own_time).alias("own"))
                    hit = left_join_unique(child, orphaned.where("key is not null").withColumn("hit", F.lit(True)), "key").where("hit")
                    steps.append(hit.select(F.lit(r.child).alias("table_name"), F.lit(r.record_id).alias("by"), "record_id", month(F.col("own")).alias("period")))
            if not steps:
                break
            new = reduce(DataFrame.unionByName, steps).distinct().join(known.select(*row).distinct(), row, "left_anti")
            last = scope.written(new.select(*row, "period", F.lit("inherited").alias("reason"), F.lit("inherited").alias("kind"), F.lit(depth).alias("depth")), "orphans")
            known = known.unionByName(last)
        out = known.select("table_name", "record_id", "period", "kind", "reason", "depth").distinct()
        return scope.written(out, "all-orphans", keep=True)


def orphan_report(found: DataFrame) -> DataFrame:
    """(table_name, period, kind, reason, n) of what `orphans` found."""
    return found.groupBy("table_name", "period", "kind", "reason").agg(F.count("*").alias("n"))
