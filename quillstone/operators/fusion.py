"""Fusion of ranked lists. The lists are top-k results: small and bounded by their parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def every() -> WindowSpec:
    """The whole list as one window; for top-k lists only."""
    return Window.partitionBy()


def blend(vector: Column, lexical: Column, alpha: float) -> Column:
    return alpha * vector + (1 - alpha) * lexical


def min_max(value: Column, inverse: bool = False) -> Column:
    """To [0, 1] over the whole list; all equal: 1. Nulls stay null."""
    lo, hi = F.min(value).over(every()), F.max(value).over(every())
    scaled = (hi - value) / (hi - lo) if inverse else (value - lo) / (hi - lo)
    return F.when(value.isNull(), F.lit(None)).when(hi == lo, F.lit(1.0)).otherwise(scaled)


def percentile_scaled(value: Column, lo: float = 0.05, hi: float = 0.95) -> Column:
    """Clipped to percentiles (linear between ranks), then scaled. Under three values, or if the percentiles meet, by
    least and greatest; all equal: 1 above zero, else 0."""
    n, low, high = F.count(value).over(every()), F.min(value).over(every()), F.max(value).over(every())
    a, b = F.percentile(value, F.lit(lo)).over(every()), F.percentile(value, F.lit(hi)).over(every())
    plain = F.when(high > low, (value - low) / (high - low)).otherwise(F.when(value > 0, 1.0).otherwise(0.0))
    clipped = (F.least(F.greatest(value, a), b) - a) / (b - a)
    return F.when(value.isNull(), F.lit(None)).when((n < 3) | (b <= a), plain).otherwise(clipped)


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Position from 1 in a top-k list."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def merge(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both lists by key; columns of either side are null where it lacks the key."""
    return left.join(right, list(keys), "full_outer")


def reciprocal_ranks(lists: Sequence[tuple[DataFrame, str]], keys: Sequence[str], k: int = 60) -> DataFrame:
    """(keys, rank columns, score): the sum of 1 / (k + rank) over the lists; each is a DataFrame and its rank column."""
    out = lists[0][0].select(*keys, lists[0][1])
    for df, rank in lists[1:]:
        out = merge(out, df.select(*keys, rank), keys)
    score = sum((F.coalesce(1 / (k + F.col(rank)), F.lit(0.0)) for _, rank in lists), F.lit(0.0))
    return out.withColumn("score", score)


def union_mean(left: DataFrame, right: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """(keys, score): the mean where both lists have the key, else its own score."""
    a, b = left.select(*keys, F.col(score).alias("_a")), right.select(*keys, F.col(score).alias("_b"))
    mean = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), (F.col("_a") + F.col("_b")) / 2).otherwise(F.coalesce("_a", "_b"))
    return merge(a, b, keys).select(*keys, mean.alias(score))


def union_first(lists: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The lists one after the other; of rows with the same key the first stays."""
    out = lists[0].withColumn("_list", F.lit(0))
    for i, df in enumerate(lists[1:], 1):
        out = out.unionByName(df.withColumn("_list", F.lit(i)))
    first = Window.partitionBy(*keys).orderBy("_list", *order)
    return out.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_list")


def best_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key: the first by `order`. Spark prunes to one row per key before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
