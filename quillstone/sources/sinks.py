"""Tables and logs as files: routed tables, idempotent upserts, NDJSON and tab-separated logs, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.etl import upsert


def write_routed(df: DataFrame, path: str, bucket: Column, name: str = "bucket") -> None:
    """Parquet partitioned by bucket; buckets that come in replace their own partition, others stay."""
    df.withColumn(name, bucket).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(name).parquet(path)


def write_upserted(spark: SparkSession, df: DataFrame, path: str, key: Sequence[str], order: Sequence[Column], version: int) -> str:
    """The next version of a table of files: rows of the version before, with the newest incoming row of each key in the
    place of its own. Writing a version again gives the same rows. Returns its folder."""
    before = f"{path}/v={version - 1}"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
    there = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
    old = spark.read.schema(df.schema).parquet(before) if there else df.where("false")
    upsert(old, df, key, order).write.mode("overwrite").parquet(to := f"{path}/v={version}")
    return to


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_success_list(df: DataFrame, path: str, values: Sequence[str]) -> None:
    """One line per file: its path, then tab-separated key=value fields; null values are left out."""
    fields = [F.concat(F.lit(f"{v}="), F.col(v).cast("string")) for v in values]
    df.select(F.concat_ws("\t", "path", *fields).alias("value")).write.mode("append").text(path)


def write_run_logs(records: DataFrame, path: str, values: Sequence[str] = ("chunks", "duration_ms")) -> None:
    """The logs of a loading run below a folder, from its records (path, status, stage, error, ...): `success` (one line
    per loaded file), `errors` (NDJSON of each failure), `failed` (the paths of failures, each once) and `summary` (JSON:
    files by status, and chunks)."""
    done = F.col("status").isin("ok", "complete")
    failed = records.where(F.col("status") == "error")
    write_success_list(records.where(done), f"{path}/success", values)
    write_ndjson(failed, f"{path}/errors")
    failed.select(F.col("path").alias("value")).distinct().write.mode("append").text(f"{path}/failed")
    counts = records.agg(F.count_if(done).alias("files_ok"), F.count_if(F.col("status") == "error").alias("files_failed"), F.count_if(~F.coalesce(done | (F.col("status") == "error"), F.lit(False))).alias("files_other"), F.coalesce(F.sum(F.when(done, F.col("chunks"))), F.lit(0)).alias("chunks"))
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def manifest(assigned: DataFrame) -> DataFrame:
    """(total_files, shards, assigned_total, unique_assigned): one row for a manifest file. `assigned`: path, part."""
    per = assigned.groupBy("part").agg(F.count("*").alias("count"))
    shards = per.agg(F.array_sort(F.collect_list(F.struct(F.col("part").alias("index"), "count"))).alias("shards"), F.coalesce(F.sum("count"), F.lit(0)).alias("assigned_total"))
    total = assigned.agg(F.count_distinct("path").alias("total_files"), F.count_distinct("path").alias("unique_assigned"))
    return total.crossJoin(shards).select("total_files", "shards", "assigned_total", "unique_assigned")


def read_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A database table over JDBC, read in `parts` ranges of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=options)


def run_sql(spark: SparkSession, sql: str, args: dict | None = None, **views: DataFrame) -> DataFrame:
    """A SQL statement with bound parameters over the given tables."""
    return spark.sql(sql, args=args or {}, **views)
