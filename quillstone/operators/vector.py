"""Exact vector search over chunks, and search in lists of an index with exact ranking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import vectors as V
from quillstone.runtime import Written, ship


def nearest(chunks: DataFrame, query: Sequence[float], top_k: int, keep: Sequence[str], vector: str = "vector", tie: Sequence[str] = ("id",)) -> DataFrame:
    """The kept columns with `distance` of the `top_k` chunks nearest by cosine; unusable vectors take no part. A heap
    per task, no sort and no shuffle of the table. Equal distances are ordered by `tie`."""
    out = chunks.where(V.usable(F.col(vector), len(query)))
    columns = list(dict.fromkeys([*keep, *tie]))
    return out.select(*columns, V.cosine_distance(F.col(vector), V.literal(query)).alias("distance")).orderBy("distance", *tie).limit(top_k).select(*keep, "distance")


#: The index is fitted on at most so many vectors; vectors per list aimed at, and the most lists.
SAMPLE, PER_LIST, MOST_LISTS = 60_000, 160, 4096


class VectorIndex:
    """Lists of vectors by their nearest centroid, with one byte a number, in folders by list: a query reads the folders of
    the lists it probes. `centroids`: unit rows; `path`: a table of (list, key, scale, small)."""

    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray, key: str, kind: str):
        self.spark, self.path, self.centroids, self.key = spark, path, centroids, key
        self.table = spark.read.schema(f"{key} {kind}, scale float, small array<tinyint>, list int").parquet(path)

    @staticmethod
    def build(spark: SparkSession, rows: DataFrame, key: str, vector: str, dim: int, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Fit centroids on a sample of at most about `sample` vectors, chosen by hash; then code every usable vector.
        lists: by default one for PER_LIST vectors, at most MOST_LISTS. Lists are spread by a hash of the key over
        tasks, so that no list is one task."""
        ship(spark)
        rows = rows.where(V.usable(F.col(vector), dim) & F.col(key).isNotNull()).select(F.col(key), F.col(vector).alias("vector"))
        n = rows.count()
        take = rows if n <= sample else rows.where(F.pmod(F.xxhash64("vector", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * sample / n))
        x = _unit(take.select("vector").limit(2 * sample).toArrow().column("vector").combine_chunks(), dim) if n else np.zeros((1, dim))
        x = x[np.lexsort(x.T[:4])]  # rows arrive in any order
        centroids = _centroids(x, int(np.clip(lists or n // PER_LIST, 1, min(MOST_LISTS, max(1, len(x) // 8)))))
        shared = spark.sparkContext.broadcast(centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    unit = _unit(batch.column(1), dim)
                    scale = np.abs(unit).max(1) / 127
                    small = np.rint(unit / scale[:, None]).astype(np.int8)
                    lists = np.concatenate([(unit[i : i + 4096] @ shared.value.T).argmax(1) for i in range(0, len(unit), 4096)])
                    offsets = pa.array(np.arange(0, (len(unit) + 1) * dim, dim, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scale.astype(np.float32)), pa.ListArray.from_arrays(offsets, pa.array(small.ravel())), pa.array(lists.astype(np.int32))], names=[key, "scale", "small", "list"])

        kind = rows.schema[key].dataType.simpleString()
        coded = rows.mapInArrow(run, f"{key} {kind}, scale float, small array<tinyint>, list int")
        parts = max(rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
        salts = -(-parts // max(1, len(centroids)))
        coded = coded.repartition(parts, F.col("list"), F.pmod(F.xxhash64(key), F.lit(salts))).sortWithinPartitions("list")
        return VectorIndex(spark, Written(spark, coded, "vectors", ["list"]).path, centroids, key, kind)

    def candidates(self, query: Sequence[float], k: int, probes: int | None = None) -> DataFrame:
        """(key) of about the `k` nearest vectors in the `probes` nearest lists (default: a quarter of them, at least 16);
        all lists: of all vectors."""
        q = np.array([round(float(x), 6) for x in query])
        probes = min(len(self.centroids), probes or max(16, len(self.centroids) // 4))
        near = np.argsort(-(self.centroids @ q), kind="stable")[:probes].tolist()
        inner = F.aggregate(F.zip_with("small", V.literal(query), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) * F.col("scale")
        return self.table.where(F.col("list").isin(near)).select(self.key, inner.alias("_s")).orderBy(F.desc("_s"), self.key).limit(k).select(self.key)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten()).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centroids(x: np.ndarray, k: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


def nearest_two_phase(index: VectorIndex, chunks: DataFrame, query: Sequence[float], top_k: int, keep: Sequence[str], factor: int = 10, probes: int | None = None, vector: str = "vector") -> DataFrame:
    """As nearest(), over `factor` x top_k candidates that the index gives, joined back to the table by its key and ranked
    exactly. What is missed depends on `probes`; README has the measured recall. probes = all lists is exact but for
    vectors whose codes rank beyond the candidates."""
    some = index.candidates(query, factor * top_k, probes)
    return nearest(chunks.join(F.broadcast(some), index.key, "left_semi"), query, top_k, keep, vector, (index.key,))
