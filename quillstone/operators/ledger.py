"""Sessions and files of loading runs as a ledger: events are appended, the latest state of each key is a view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION = "session_name string, at timestamp, directory string, status string, last_file string, last_chunk int, total_files int, total_chunks int, processed_chunks int"
FILE = "session_name string, filepath string, at timestamp, status string"


def session_event(spark: SparkSession, session_name: str, at, status: str | None = None, **values) -> DataFrame:
    """One event: `active` to start, `complete` or `error` to end, no status for progress; other values as they change."""
    names = [c.split()[0] for c in SESSION.split(", ")]
    if odd := set(values) - set(names):
        raise ValueError(f"unknown fields {sorted(odd)}")
    return spark.createDataFrame([tuple({"session_name": session_name, "at": at, "status": status, **values}.get(n) for n in names)], SESSION)


def append(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def latest(events: DataFrame, key: Sequence[str], at: str = "at") -> DataFrame:
    """One row of each key: of every field the last value that isn't null, by time; events of one time by value. Null times
    count as the oldest. Combined before the shuffle; a repeated event changes nothing."""
    fields = [c for c in events.columns if c not in (*key, at)]
    when = F.coalesce(F.col(at), F.timestamp_seconds(F.lit(-10_000_000_000)))
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(when.alias("t"), F.col(c).alias("v"))))["v"].alias(c) for c in fields]
    return events.groupBy(*key).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), *last)


def sessions(events: DataFrame) -> DataFrame:
    """(session_name, started_at, ended_at, status, ...): ended_at is that of the last event, once the session is over."""
    out = latest(events, ["session_name"])
    over = F.col("status").isin("complete", "error")
    return out.withColumnRenamed("first_at", "started_at").withColumn("ended_at", F.when(over, F.col("last_at"))).drop("last_at")


def file_counts(files: DataFrame) -> DataFrame:
    """(session_name, status, n): files by their latest status; those without any are `pending`."""
    now = latest(files, ["session_name", "filepath"]).withColumn("status", F.coalesce("status", F.lit("pending")))
    return now.groupBy("session_name", "status").agg(F.count("*").alias("n"))
