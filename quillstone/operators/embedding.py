"""Texts to vectors without a model: signed hashing of words. A trained encoder can take its place in `embed`."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.runtime import ship


def hashed(texts: list[str], dim: int) -> np.ndarray:
    """Word counts at a hashed place with a hashed sign, their square roots, as float32 rows."""
    out = np.zeros((len(texts), dim), np.float32)
    known: dict[str, tuple[int, int]] = {}
    for i, t in enumerate(texts):
        for w in re.findall(r"[^\W_]+", t.lower()):
            if w not in known:
                h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
                known[w] = (h % dim, 1 if h >> 63 else -1)
            at, sign = known[w]
            out[i, at] += sign
    return np.sign(out) * np.sqrt(np.abs(out))


def embed(spark: SparkSession, df: DataFrame, text: str, dim: int = 64, encoder: Callable[[list[str], int], np.ndarray] = hashed) -> DataFrame:
    """The table with `vector`, array<float>; null for null text. In Arrow batches, without a shuffle."""
    ship(spark)
    columns = df.columns
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            flat = encoder([t or "" for t in texts], dim).astype(np.float32)
            offsets = pa.array(np.arange(0, (len(texts) + 1) * dim, dim, dtype=np.int32), mask=np.r_[[t is None for t in texts], False].astype(bool))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))], names=[*columns, "vector"])

    return df.select(*[F.col(c) for c in columns]).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))
