"""Session helpers shared by all operators: table access, the shared work folder, shipping of Python code."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if its rows and their bytes, counted first, are at most so many.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own only where none is set, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.conf.get("quillstone.work.dir", None)
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="quillstone-")
            spark.conf.set("quillstone.work.dir", at)
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


class Written:
    """A DataFrame cut from its lineage by a Parquet table in the shared folder; `drop` removes the files."""

    def __init__(self, spark: SparkSession, df: DataFrame, tag: str, partition_by: list[str] | None = None):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path)
        _written.append((spark, self.path))
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)
        if (self.spark, self.path) in _written:
            _written.remove((self.spark, self.path))


def written(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """`df` read back from a table in the shared folder; the files stay until release() or the end of the session."""
    return Written(spark, df, tag).df


class Scope:
    """Written tables of one operator: on leaving, all but those written with keep=True are dropped. What a lazy result
    still reads must be kept; release() drops it once the result is stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.passing = spark, []

    def __enter__(self) -> Scope:
        return self

    def written(self, df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
        w = Written(self.spark, df, tag)
        if not keep:
            self.passing.append(w)
        return w.df

    def __exit__(self, *_) -> None:
        for w in self.passing:
            w.drop()


def release() -> None:
    """Drop every table written so far. For long sessions, between results that have been stored."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone
            continue


atexit.register(release)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that they need no copy of their own."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(prefix="quillstone-code-"), "quillstone.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"quillstone/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: texts and binaries by their length, other nested values by their JSON."""
    size: Column = F.lit(16)
    for f in df.schema.fields:
        kind = f.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0)) + 8
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            size = size + F.coalesce(8 * F.size(f.name), F.lit(0)) + 8
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(f.name)), F.lit(0)) + 8
        else:
            size = size + 8
    return size


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether `df` has at most so many rows and bytes. Not more than rows + 1 sizes are looked at."""
    n, total = df.select(row_bytes(df).cast("bigint").alias("b")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return n <= rows and total <= size


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if its rows and bytes are within the bounds; else as it is, for a shuffled join."""
    return F.broadcast(df) if fits(df, most) else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` by hash of `key` over all cores, if it is read in fewer partitions than there are; else as it is. For steps
    of much work per row over small inputs; an input of many partitions is never shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
