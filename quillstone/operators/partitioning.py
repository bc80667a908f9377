"""Dividing work by size and order."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.runtime import written

#: Files that are packed one by one on the driver.
FILES = 1_000_000


def positioned(df: DataFrame, order: Sequence[Column], name: str = "position", total: str | None = None) -> DataFrame:
    """With `name` (bigint): the place of each row in order, from 1; and `total`, the number of rows, if it is named. Rows
    are sorted in ranges; the ranges' counts, a number each, are summed on the driver and ranks taken within a range, so
    that a list of any length is no single task. The ranges are written, so that none is drawn twice. Order by columns
    that leave no ties, or rows that tie are in any order."""
    ranged = written(df.sparkSession, df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    ahead = [0]
    for part in range(max(counts, default=0)):
        ahead.append(ahead[-1] + counts.get(part, 0))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = ranged.withColumn(name, F.get(F.lit(ahead), F.col("_part")).cast("bigint") + inside)
    if total is not None:
        out = out.withColumn(total, F.lit(sum(counts.values())).cast("bigint"))
    return out.drop("_part")


def even(df: DataFrame, parts: int, order: Sequence[Column]) -> DataFrame:
    """With `part` from 0: contiguous parts in order, the first ones one row longer where it doesn't divide evenly."""
    out = positioned(df, order, "_p", "_n")
    size, longer = F.floor(F.col("_n") / parts), F.col("_n") % parts
    at, edge = F.col("_p") - 1, (F.col("_n") % parts) * (F.floor(F.col("_n") / parts) + 1)
    part = F.when(at < edge, F.floor(at / (size + 1))).otherwise(longer + F.floor((at - edge) / F.greatest(size, F.lit(1))))
    return out.withColumn("part", part.cast("int")).drop("_p", "_n")


def round_robin(df: DataFrame, parts: int, order: Sequence[Column]) -> DataFrame:
    return positioned(df, order, "_p").withColumn("part", ((F.col("_p") - 1) % parts).cast("int")).drop("_p")


def zigzag(df: DataFrame, size: str, tie: str) -> DataFrame:
    """With `position` (bigint) from 1: largest, smallest, second largest, second smallest, and so on; null sizes count as
    the smallest."""
    ranked = positioned(df, [F.desc(size), F.asc(tie)], "_d", "_all").withColumn("_u", F.col("_all") + 1 - F.col("_d"))
    position = F.when(F.col("_d") <= F.col("_u"), 2 * F.col("_d") - 1).otherwise(2 * F.col("_u"))
    return ranked.withColumn("position", position).select(*df.columns, "position")


def largest_first(sizes: Sequence[tuple[str, int]], bins: int) -> list[list[str]]:
    """Greedy packing on the driver, for lists of files or shards: each item, largest first, to the emptiest bin."""
    heap = [(0, i) for i in range(bins)]
    out: list[list[str]] = [[] for _ in range(bins)]
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        total, i = heapq.heappop(heap)
        out[i].append(name)
        heapq.heappush(heap, (total + size, i))
    return out


def balanced(files: DataFrame, workers: int, path: str = "path", size: str = "size", skew: float = 0.6, shards: int | None = None) -> DataFrame:
    """(path, size, part, by_size): files to shards, four a worker unless `shards` says otherwise, at most one a file. Where
    sizes are skewed (Gini coefficient of at least `skew`) and there are several workers, the largest file goes to the
    emptiest shard first; else contiguous parts in the order of paths.

    Packing goes over the list one by one, so that it is done on the driver: the list is one of files, whose paths and
    sizes the driver holds anyway to plan a scan. Files of more than FILES are packed by rounds of the zigzag order
    instead, which needs no list."""
    n = files.count()
    shards = max(1, min(shards or 4 * workers, n))
    by_size = workers > 1 and n > 0 and gini(files, size).first()["gini"] >= skew
    rows = files.select(path, size)
    if not by_size:
        return even(rows, shards, [F.asc(path)]).withColumn("by_size", F.lit(False))
    if n > FILES:
        snake = positioned(rows, [F.desc(size), F.asc(path)], "_p")
        lap, at = F.floor((F.col("_p") - 1) / shards), (F.col("_p") - 1) % shards
        return snake.withColumn("part", F.when(lap % 2 == 0, at).otherwise(shards - 1 - at).cast("int")).drop("_p").withColumn("by_size", F.lit(True))
    packed = largest_first([(r[0], r[1] or 0) for r in rows.collect()], shards)
    spark = files.sparkSession
    parts = spark.createDataFrame([(x, i) for i, xs in enumerate(packed) for x in xs], f"{path} string, part int")
    return rows.join(parts, path).withColumn("by_size", F.lit(True))


def gini(df: DataFrame, size: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, gini): inequality of sizes that aren't negative, 0 if all are equal; by the sorted ranks of each group.

    Equal sizes are counted first. What remains is sorted in ranges of (by, size): counts of a group ahead of a range are
    summed over ranges, of which there are few, and inside a range by rows, so that a hot group is no single task."""
    df = df.where(F.col(size) >= 0).withColumn("_g", F.lit(0))
    keys = ["_g", *by]
    counts = df.groupBy(*keys, F.col(size).alias("_x")).agg(F.count("*").alias("_c"))
    ranged = written(df.sparkSession, counts.repartitionByRange(*keys, "_x").withColumn("_part", F.spark_partition_id()), "sizes")
    ranges = ranged.groupBy(*keys, "_part").agg(F.sum("_c").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*keys, "_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_far"))
    inside = Window.partitionBy("_part", *keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("_near", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    same = [rows[k].eqNullSafe(ranges[k]) for k in (*keys, "_part")]
    rows = rows.join(F.broadcast(ranges), reduce(Column.__and__, same)).select(*[rows[k] for k in keys], "_x", "_c", (F.col("_near") + F.col("_far")).alias("_ahead"))
    ranks = F.col("_c") * F.col("_ahead") + F.col("_c") * (F.col("_c") + 1) / 2  # the sum of the ranks of equal sizes
    n, total = F.sum("_c"), F.sum(F.col("_c") * F.col("_x"))
    g = 2 * F.sum(ranks * F.col("_x")) / (n * F.nullif(total, F.lit(0))) - (n + 1) / n
    return rows.groupBy(*keys).agg(n.alias("n"), F.coalesce(g, F.lit(0.0)).alias("gini")).drop("_g")


def coverage(files: DataFrame, assigned: DataFrame, key: str = "path") -> DataFrame:
    """One row: files, assignments, distinct assignments, missing and repeated ones, complete (each file exactly once)."""
    counts = assigned.groupBy(key).agg(F.count("*").alias("n"))
    both = files.select(key).distinct().join(counts, key, "full_outer")
    inside = files.select(key).distinct().withColumn("_f", F.lit(1))
    both = both.join(inside, key, "left")
    out = both.agg(F.count("_f").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("assigned"), F.count("n").alias("distinct_assigned"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"))
    return out.withColumn("complete", (F.col("missing") == 0) & (F.col("repeated") == 0) & (F.col("distinct_assigned") == F.col("files")))
