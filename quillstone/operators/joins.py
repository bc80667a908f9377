"""Joins that stay even when a third of all rows share one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.runtime import BROADCAST_ROWS, fits

#: A key is hot if it holds more than this share of the child rows; so there are at most as many as its inverse.
HOT_SHARE = 0.001


def left_join_unique(child: DataFrame, parent: DataFrame, key: str | Sequence[str], rows: int | None = None) -> DataFrame:
    """child left join parent on `key`, one column or several, which is unique in parent.

    A parent within the bounds of a broadcast (counted; `rows` instead of BROADCAST_ROWS, if given) is broadcast. A larger
    one is shuffled, except for the rows of hot child keys: there are at most 1 / HOT_SHARE of them, so that these are
    broadcast and hot child rows stay where they are.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if fits(parent, BROADCAST_ROWS if rows is None else rows):
        return child.join(F.broadcast(parent), keys, "left")
    counts = child.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n"))
    total = child.count()
    hot = counts.where(F.col("_n") > F.lit(max(10_000, int(total * HOT_SHARE)))).select(*keys)
    if hot.isEmpty():
        return child.join(parent, keys, "left")
    few = F.broadcast(parent.join(F.broadcast(hot), keys, "left_semi"))
    often = child.join(F.broadcast(hot), keys, "left_semi").join(few, keys, "left")
    return often.unionByName(child.join(F.broadcast(hot), keys, "left_anti").join(parent, keys, "left"))
