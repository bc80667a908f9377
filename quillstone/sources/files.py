"""Files as tables: recursive scans, partition files, samples, texts with a fallback encoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import metadata as M
from quillstone.functions import text as X
from quillstone.runtime import maybe_broadcast, ship
from quillstone.sources import front_matter, html

EXTENSION = r"(?i)\.(txt|html)$"


def scan(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, length, modified) of all .txt and .html files below the folders, without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
    return files.where(F.col("path").rlike(EXTENSION)).select("path", "length", F.col("modificationTime").alias("modified")).dropDuplicates(["path"])


def listed(spark: SparkSession, partition_file: str) -> DataFrame:
    """(path) of each non-empty line of a partition file."""
    return spark.read.text(partition_file).select(F.trim("value").alias("path")).where("path <> ''")


def listed_files(spark: SparkSession, partition_file: str, *roots: str) -> DataFrame:
    """(path, length, modified) of the files below the folders that a partition file names, with or without a scheme."""
    bare = lambda c: F.regexp_replace(c, "^file:/*", "/")
    wanted = listed(spark, partition_file).select(bare(F.col("path")).alias("_p")).distinct()
    files = scan(spark, *roots).withColumn("_p", bare(F.col("path")))
    return files.join(maybe_broadcast(wanted), "_p", "left_semi").drop("_p")


def sample(files: DataFrame) -> DataFrame:
    """At most one file of each folder, folders named for a year left out: the first .txt by natural order, else .html."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    first = Window.partitionBy("folder").orderBy(F.desc(F.lower("path").endswith(".txt")), X.natural_key(F.col("path")), "path")
    placed = files.withColumn("folder", folder).where(~F.col("folder").rlike(r"/(19|20)\d{2}(/|$)"))
    return placed.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "folder")


def texts(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, content): files decoded as UTF-8, else as Latin-1, which takes any bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots)).where(F.col("path").rlike(EXTENSION))

    @F.pandas_udf("content string")
    def decoded(contents: pd.Series) -> pd.DataFrame:
        def one(b: bytes) -> str:
            try:
                return b.decode("utf-8")
            except UnicodeDecodeError:
                return b.decode("latin-1")

        return pd.DataFrame({"content": contents.map(one)})

    return raw.select("path", decoded("content")["content"].alias("content"))


def parsed(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, metadata, body, format): front matter and body of each file; HTML is reduced to its text first. format is
    the stated type, else txt or html."""
    ship(spark)

    @F.pandas_udf("metadata string, body string")
    def parse(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        plain = [html.to_text(c) if p.lower().endswith(".html") else c for p, c in zip(paths, contents)]
        return pd.DataFrame([front_matter.split(p) for p in plain], columns=["metadata", "body"])

    rows = texts(spark, *roots).withColumn("p", parse("path", "content"))
    kind = F.coalesce(M.text_of(F.col("p.metadata"), "type"), F.lower(F.regexp_extract("path", EXTENSION, 1)))
    return rows.select("path", F.col("p.metadata").alias("metadata"), F.col("p.body").alias("body"), kind.alias("format"))


def case_pages(pages: DataFrame, column: str, path: str, base: str = "", prefix: str = "") -> DataFrame:
    """The table with `status`, `meta` (JSON) and `document` of pages of one case each, by html.case_document; path is the
    page's place below the base. Null for null."""
    ship(pages.sparkSession)

    @F.pandas_udf("status string, meta string, document string")
    def run(values: pd.Series, paths: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([html.case_document(v, p or "", base, prefix) for v, p in zip(values, paths)], columns=["status", "meta", "document"])

    return pages.withColumn("_c", run(column, path)).select("*", "_c.*").drop("_c")


def html_texts(pages: DataFrame, column: str) -> DataFrame:
    """The table with `text`, the text of a column of pages; null for null."""
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(html.to_text)

    return pages.withColumn("text", run(column))


def pending(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files that no completed file names."""
    return files.join(done.select("path"), "path", "left_anti")
