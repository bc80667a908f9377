"""An inverted index of words and stems with positions, written once; queries read the rows of their stems only.

A row is a word in one field of a batch of documents: its stem, and side by side for each document that holds it the key,
how often and where the word occurs, and the field's length. Rows lie in buckets by a hash of the stem, sorted by stem, so
that a query's filter prunes folders and row groups; texts are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.stem import STOP, stem
from quillstone.operators.lexical import K1, B, Boolean, query_words
from quillstone.runtime import Written, ship, spread

WORD = re.compile(r"[^\W_]+")
#: Of stems: the most positions of one that a rank looks at, and the greatest place that is told apart.
MOST_POSITIONS, LAST_PLACE = 256, 16_383
#: The folder of the rows that hold lengths.
LENGTHS = -1
CACHE_WORDS = 500_000
#: Characters of all fields in a batch of documents that share rows.
BATCH_CHARS = 4_000_000
#: Partitions of texts whose rows are written without a shuffle: as many files in a bucket are no burden to a query.
UNSHUFFLED = 32
POSITION_WEIGHT = 0.1


def bucket_of(stem_: str, buckets: int) -> int:
    return xxhash.xxh32_intdigest(stem_) % buckets


def _lists(starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Lists of runs of values that begin at `starts`."""
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), values)


def _rows(docs: DataFrame, fields: Sequence[str], buckets: int, places: Sequence[str]) -> DataFrame:
    """(bucket, stem, word, field, keys, tfs, lens, positions) by word, field and batch; a row with a null word holds the
    lengths of a field. Positions are null for fields that aren't among `places`."""

    def index(keys: pa.Array, texts: list[str | None], name: str, known: dict[str, int]) -> pa.RecordBatch:
        found = [WORD.findall(t.lower()) if t else [] for t in texts]
        per = np.fromiter(map(len, found), np.int64, len(found))
        for w in set(chain.from_iterable(found)).difference(known):
            known[w] = len(known)
        names = list(known)
        word = np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.int64, int(per.sum()))
        doc = np.repeat(np.arange(len(per)), per)
        place = np.arange(len(word)) - np.repeat(np.cumsum(per) - per, per) + 1
        order = np.argsort(word, kind="stable")  # words of a document stay in order
        word, doc, place = word[order], doc[order], place[order]
        entry = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])]) if len(word) else np.empty(0, np.int64)
        of, holder = word[entry], doc[entry]
        row = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, np.int64)
        words = [names[i] for i in of[row].tolist()]
        stems = list(map(stem, words))
        # the lengths of all documents come first, as a row without a word
        tf = np.r_[np.zeros(len(per), np.int64), np.diff(np.r_[entry, len(word)])]
        starts = np.r_[0, row + len(per)]
        at = np.r_[np.arange(len(per)), holder]
        positions = pa.nulls(len(words) + 1, pa.list_(pa.list_(pa.int32())))
        if name in places:
            inner = _lists(np.r_[np.zeros(len(per), np.int64), entry], pa.array(place.astype(np.int32)))
            positions = _lists(starts, inner)
        columns = [pa.array([LENGTHS, *(bucket_of(x, buckets) for x in stems)], pa.int32()), pa.array([None, *stems], pa.string()), pa.array([None, *words], pa.string()), pa.array([name] * (len(words) + 1), pa.string()), _lists(starts, keys.take(pa.array(at))), _lists(starts, pa.array(tf.astype(np.int32))), _lists(starts, pa.array(per[at].astype(np.int32))), positions]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "stem", "word", "field", "keys", "tfs", "lens", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        held: list[tuple] = []
        size = 0

        def handed() -> Iterator[pa.RecordBatch]:
            keys = pa.concat_arrays([k for k, *_ in held])
            for f, name in enumerate(fields):
                yield index(keys, list(chain.from_iterable(h[f + 1] for h in held)), name, known)

        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                held.append((part.column(0), *(part.column(f + 1).to_pylist() for f in range(len(fields)))))
                size += sum(len(t or "") for texts in held[-1][1:] for t in texts)
                if size > BATCH_CHARS:
                    yield from handed()
                    held, size = [], 0
                    if len(known) > CACHE_WORDS:
                        known = {}
        if held:
            yield from handed()

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"bucket int, stem string, word string, field string, keys array<{kind}>, tfs array<int>, lens array<int>, positions array<array<int>>")


class Postings:
    """The index of some text fields of a table by a key. `n`: documents; `average`: the mean length of each field."""

    def __init__(self, spark: SparkSession, path: str, fields: Sequence[str], buckets: int, kind: str = "bigint"):
        self.spark, self.path, self.fields, self.buckets = spark, path, tuple(fields), buckets
        self.table = spark.read.schema(f"stem string, word string, field string, keys array<{kind}>, tfs array<int>, lens array<int>, positions array<array<int>>, bucket int").parquet(path)
        self.lengths = self.table.where(F.col("bucket") == LENGTHS).select("field", F.explode(F.arrays_zip("keys", "lens")).alias("x")).select(F.col("x.keys").alias("key"), "field", F.col("x.lens").alias("len"))
        per = {r["field"]: r for r in self.lengths.groupBy("field").agg(F.avg("len").alias("a"), F.count("*").alias("n")).collect()}
        self.average = {f: per[f]["a"] if f in per else 0.0 for f in self.fields}
        self.n = max((r["n"] for r in per.values()), default=0)

    @staticmethod
    def build(spark: SparkSession, docs: DataFrame, key: str, fields: Mapping[str, Column | str] | Sequence[str], buckets: int | None = None, places: Sequence[str] | None = None) -> Postings:
        """Write the index of a stored table. `places`: fields for which phrases and ranks are asked, by default all; the
        others have counts. One pass over the texts; rows of many tasks are shuffled by bucket, and a bucket is salted by
        key where the table is large, so that no word is one task. Null and empty texts have length 0; null keys are left
        out."""
        ship(spark)
        columns = fields if isinstance(fields, Mapping) else {f: f for f in fields}
        rows = docs.select(F.col(key).alias("key"), *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]).where("key is not null")
        rows = spread(rows, "key")
        parts = rows.rdd.getNumPartitions()
        buckets = buckets or min(4096, max(16, 4 * parts))
        salts = -(-parts // 1024)
        hashed = F.pmod(F.xxhash64(F.get("keys", F.lit(0))), F.when(F.col("bucket") == LENGTHS, F.lit(min(parts, 1024))).otherwise(F.lit(salts)))
        flat = _rows(rows, list(columns), buckets, list(columns if places is None else places))
        if parts > UNSHUFFLED:  # else each task writes its own part of each bucket
            flat = flat.repartition(min(buckets * salts, parts), F.col("bucket"), hashed)
        flat = flat.sortWithinPartitions("bucket", "stem")
        written = Written(spark, flat, "postings", ["bucket"])
        return Postings(spark, written.path, list(columns), buckets, rows.schema["key"].dataType.simpleString())

    def rows(self, words: Sequence[str] | None = None, stems: Sequence[str] | None = None, fields: Sequence[str] | None = None, places: bool = True) -> DataFrame:
        """(stem, word, field, key, tf, len, positions) of the words, or of the stems, in the fields; without `places`, the
        positions aren't read."""
        wanted = list(dict.fromkeys(map(stem, words) if stems is None else stems))
        out = self.table.where(F.col("bucket").isin([bucket_of(s, self.buckets) for s in wanted]) & F.col("stem").isin(wanted))
        if stems is None:
            out = out.where(F.col("word").isin(list(words)))
        if fields is not None and set(fields) != set(self.fields):
            out = out.where(F.col("field").isin(list(fields)))
        lists = [F.col("keys").alias("key"), F.col("tfs").alias("tf"), F.col("lens").alias("len")]
        if places:
            lists.append(F.coalesce("positions", F.array().cast(self.table.schema["positions"].dataType)).alias("positions"))
        names = ["key", "tf", "len", "positions"][: len(lists)]
        out = out.select("stem", "word", "field", *lists).select("stem", "word", "field", F.explode(F.arrays_zip(*names)).alias("x"))
        return out.select("stem", "word", "field", *[F.col(f"x.{n}").alias(n) for n in names])

    def _none(self, *columns: Column) -> DataFrame:
        return self.lengths.select("key", *columns).limit(0)

    def bm25(self, fields: Mapping[str, float], query: str, operator: str = "or", tie: float = 0.0) -> DataFrame:
        """(key, score) of the documents that match: the best field's boost times BM25 (k1 1.2, b 0.75, idf over the whole
        table), plus `tie` times the other fields. operator: any word (`or`) or every word in one field (`and`)."""
        words = query_words(query)
        if not words:
            return self._none(F.lit(0.0).alias("score"))
        names = list(fields)
        rows = self.rows(words, fields=names, places=False)
        cells = {(f, i): (F.col("field") == f) & (F.col("word") == w) for f in names for i, w in enumerate(words)}
        per = rows.groupBy("key").agg(*[F.coalesce(F.max(F.when(c, F.col("tf"))), F.lit(0)).alias(f"tf_{f}_{i}") for (f, i), c in cells.items()], *[F.max(F.when(F.col("field") == f, F.col("len"))).alias(f"len_{f}") for f in names])
        df = rows.agg(*[F.count_if(c).alias(f"df_{f}_{i}") for (f, i), c in cells.items()])
        per = per.crossJoin(F.broadcast(df))  # one row

        def one(f: str, i: int) -> Column:
            tf, df = F.col(f"tf_{f}_{i}"), F.col(f"df_{f}_{i}")
            idf = F.log(1 + (F.lit(self.n) - df + 0.5) / (df + 0.5))
            length = F.coalesce(F.col(f"len_{f}"), F.lit(0)) / F.lit(max(self.average.get(f, 0.0), 1e-9))
            return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))

        scores = []
        for f in names:
            total = reduce(Column.__add__, [one(f, i) for i in range(len(words))])
            if operator == "and":
                every = reduce(Column.__and__, [F.col(f"tf_{f}_{i}") > 0 for i in range(len(words))])
                total = F.when(every, total).otherwise(0.0)
            scores.append(F.lit(float(fields[f])) * total)
        best = F.greatest(*scores) if len(scores) > 1 else scores[0]
        return per.select("key", (best + tie * (reduce(Column.__add__, scores) - best) if tie else best).alias("score")).where("score > 0")

    def full_text(self, field: str, query: str) -> DataFrame:
        """(key, rank) of the documents that hold every stem of the query, stop words left out; a query of stop words only
        matches nothing. rank: for each pair of places of different stems, 0.1 x sqrt of their nearness, combined as
        chances; for a single stem 0.1 / j^2 over its occurrences j, scaled. See README."""
        stems = list(dict.fromkeys(stem(w) for w in query_words(query) if w not in STOP))
        if not stems:
            return self._none(F.lit(0.0).alias("rank"))
        rows = self.rows(stems=stems, fields=[field])
        places = [F.slice(F.array_sort(F.flatten(F.collect_list(F.when(F.col("stem") == s, F.col("positions"))))), 1, MOST_POSITIONS).alias(f"p{i}") for i, s in enumerate(stems)]
        per = rows.groupBy("key").agg(*places).where(reduce(Column.__and__, [F.size(f"p{i}") > 0 for i in range(len(stems))]))
        if len(stems) == 1:
            m = F.least(F.size("p0"), F.lit(MOST_POSITIONS))
            return per.select("key", (F.aggregate(F.sequence(F.lit(1), m), F.lit(0.0), lambda s, j: s + POSITION_WEIGHT / (j * j)) / 1.64493406685).alias("rank"))

        @F.pandas_udf("double")
        def rank(every: pd.DataFrame) -> pd.Series:
            return pd.Series([_nearness([np.minimum(p, LAST_PLACE) for p in row]) for row in every.itertuples(index=False)])

        return per.select("key", rank(F.struct(*[f"p{i}" for i in range(len(stems))])).alias("rank"))

    def match(self, field: str, query: str) -> DataFrame:
        """(key) of the documents that hold every stem of the query, as full_text without a rank; needs no places."""
        stems = list(dict.fromkeys(stem(w) for w in query_words(query) if w not in STOP))
        if not stems:
            return self._none()
        rows = self.rows(stems=stems, fields=[field], places=False)
        return rows.groupBy("key").agg(F.count_distinct("stem").alias("n")).where(F.col("n") == len(stems)).select("key")

    def phrase(self, field: str, query: str, slop: int = 0) -> DataFrame:
        """(key) of the documents that hold the words of the query in order; with slop, at most so many other words
        between them in all."""
        words = query_words_in_order(query)
        if not words:
            return self._none()
        return self._places(field, words).where(_in_order(words, slop)(F.struct(*[f"p_{w}" for w in dict.fromkeys(words)]))).select("key")

    def _places(self, field: str, words: Sequence[str]) -> DataFrame:
        """(key, p_<word>...) of the documents that hold all of the words."""
        distinct = list(dict.fromkeys(words))
        per = self.rows(distinct, fields=[field]).groupBy("key").agg(*[F.first(F.when(F.col("word") == w, F.col("positions")), ignorenulls=True).alias(f"p_{w}") for w in distinct])
        return per.where(reduce(Column.__and__, [F.col(f"p_{w}").isNotNull() for w in distinct]))

    def boolean(self, field: str, query: str) -> DataFrame:
        """(key) of the documents that meet a boolean query (see Boolean). Only one that words needn't meet, such as NOT
        alone, looks at all documents."""
        tree = Boolean(query).tree
        leaves: list[list[str]] = []

        def index(node) -> tuple:
            kind, rest = node
            if kind in ("not", "and", "or"):
                return kind, [index(x) for x in rest]
            leaves.append(query_words_in_order(rest))
            return "leaf", len(leaves) - 1

        tree = index(tree)

        def met(node, leaf: Callable):
            kind, rest = node
            if kind == "leaf":
                return leaf(rest)
            parts = [met(x, leaf) for x in rest]
            return ~parts[0] if kind == "not" else reduce(lambda a, b: a & b if kind == "and" else a | b, parts)

        words = list(dict.fromkeys(w for leaf in leaves for w in leaf))
        if words:
            per = self.rows(words, fields=[field]).groupBy("key").agg(*[F.first(F.when(F.col("word") == w, F.col("positions")), ignorenulls=True).alias(f"p_{w}") for w in words])
        else:
            per = self._none()
        if met(tree, lambda i: np.bool_(False)):
            per = self.lengths.where(F.col("field") == field).select("key").join(per, "key", "left")

        def leaf(i: int) -> Column:
            mine = leaves[i]
            if not mine:
                return F.lit(False)
            there = reduce(Column.__and__, [F.col(f"p_{w}").isNotNull() for w in mine])
            return there if len(mine) == 1 else F.when(there, _in_order(mine, 0)(F.struct(*[f"p_{w}" for w in dict.fromkeys(mine)]))).otherwise(F.lit(False))

        return per.where(met(tree, leaf)).select("key")


def query_words_in_order(query: str) -> list[str]:
    """All words of a query, repeated ones too."""
    return WORD.findall(query.lower())


def _nearness(places: Sequence[np.ndarray]) -> float:
    rest = 1.0
    for i, later in enumerate(places):
        for earlier in places[:i]:
            d = np.abs(later[:, None] - earlier[None]).ravel()
            d = d[(d > 0) & (d <= 100)]
            near = 1.0 / (1.005 + 0.05 * np.exp(d / 1.5 - 2))
            rest *= float(np.prod(1 - POSITION_WEIGHT * np.sqrt(near)))
    return max(1 - rest, 1e-20)


def _in_order(words: Sequence[str], slop: int) -> Callable[[Column], Column]:
    """Whether places of the words follow each other, with at most `slop` other words between them in all."""
    column = {w: i for i, w in enumerate(dict.fromkeys(words))}

    @F.pandas_udf("boolean")
    def run(every: pd.DataFrame) -> pd.Series:
        out = []
        for row in every.itertuples(index=False):
            if any(p is None for p in row):
                out.append(False)
                continue
            first = now = np.asarray(row[column[words[0]]])
            for w in words[1:]:
                after = np.asarray(row[column[w]])
                at = np.searchsorted(after, now, "right")
                first, at = first[at < len(after)], at[at < len(after)]
                now = after[at]
            out.append(bool(len(now)) and int((now - first).min()) <= len(words) - 1 + slop)
        return pd.Series(out, dtype=bool)

    return run
