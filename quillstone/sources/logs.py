"""Logs of loading runs: NDJSON, key-value headers, success lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TELEMETRY = "session string, ts string, file string, type string, status string, stage string, chunks bigint, parse_ms double, chunk_ms double, embed_ms double, index_ms double, duration_ms double, error string, error_type string, message string"


def ndjson(spark: SparkSession, path: str, schema: str | T.StructType = TELEMETRY) -> DataFrame:
    """One row per line; lines that aren't JSON are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, values): `# key=value` lines of each log file as a map."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    m = r"^#\s*([A-Za-z_]+)=(.*)$"
    found = lines.where(F.col("value").rlike(m)).select("path", F.regexp_extract("value", m, 1).alias("k"), F.trim(F.regexp_extract("value", m, 2)).alias("v"))
    return found.groupBy("path", "k").agg(F.max("v").alias("v")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("values"))


def succeeded(spark: SparkSession, path: str) -> DataFrame:
    """(path, values) of a success list: the first of tab-separated fields, the others as key=value; # lines are left out."""
    rows = spark.read.text(path).where("value not like '#%' and trim(value) <> ''").select(F.split("value", "\t").alias("f"))
    rest = F.filter(F.slice("f", F.lit(2), F.greatest(F.size("f") - 1, F.lit(0))), lambda x: x.contains("="))
    return rows.select(F.col("f")[0].alias("path"), F.map_from_entries(F.transform(rest, lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)), F.split_part(x, F.lit("="), F.lit(2))))).alias("values"))
