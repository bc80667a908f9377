"""Lines repeated across the documents of one source: mergeable heavy-hitter summaries, exact counts, removal."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.joins import left_join_unique
from quillstone.runtime import Scope, ship, spread

MIN_DOCUMENTS, MIN_SHARE = 5, 0.15
#: Least counters of one source's summary; it grows with the lines a document has (see Summary).
COUNTERS = 2048
#: Counters of all summaries that a task holds before it hands them on; bounds memory, not results.
TASK_COUNTERS = 2_000_000
#: Line hashes (8 bytes each) that are broadcast at once; more take further rounds, each over its share of the sources.
ROUND_LINES = 2_000_000
SLICES = 1 << 20

DIGITS = re.compile(r"[0-9]+")
#: Runs of characters that are neither letters nor digits, but for a single space, which stays as it is.
OTHERS = re.compile(r"(?:[^\w\n ]|_)(?:[^\w\n]|_)*| (?:[^\w\n]|_)+")


def keys_of(text: str) -> list[str]:
    """The form in which each line of a text is compared; '' for a line without any letter."""
    out = OTHERS.sub(" ", DIGITS.sub("0", text.lower())).split("\n")
    return [k if any(map(str.isalpha, k)) else "" for k in map(str.strip, out)]


def hashes_of(source: str, keys: Iterable[str]) -> list[int]:
    """64-bit hashes of a source's lines: the source's own hash is the seed, so that they name (source, line). '' is 0."""
    seed = xxhash.xxh3_64_intdigest(source)
    return [xxhash.xxh3_64_intdigest(k, seed) if k else 0 for k in keys]


def signed(values: Iterable[int]) -> np.ndarray:
    return np.array(list(values), np.uint64).view(np.int64)


class Summary:
    """Misra-Gries counters of one source's line hashes, at most one count a document.

    `missed` bounds what any line lost. It stays below a quarter of share x documents, as the counters kept are at
    least four times the counts added, divided by share x documents; memory follows one document's lines, not the data.
    """

    def __init__(self, share: float):
        self.share, self.counts = share, Counter()
        self.items = self.documents = self.missed = 0

    def add(self, keys: set[int]) -> None:
        self.documents += 1
        self.items += len(keys)
        self.counts.update(keys)
        most = max(COUNTERS, int(4 * self.items / (self.share * self.documents)))
        if len(self.counts) > 2 * most:
            cut = int(np.partition(np.fromiter(self.counts.values(), np.int64), -most - 1)[-most - 1])
            self.counts = Counter({k: n for k, c in self.counts.items() if (n := c - cut) > 0})
            self.missed += cut

    def heavy(self) -> tuple[list[int], list[int], int]:
        """Lines that may reach the share here, by how much each may exceed the bound of all others, and that bound."""
        need = max(1, math.ceil(self.share * self.documents - 1e-9))
        slack = max(self.missed, need - 1)
        kept = [(k, n + self.missed - slack) for k, n in self.counts.items() if n + self.missed >= need]
        return [k for k, _ in kept], [e for _, e in kept], slack


def _inputs(documents: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    docs = documents.select(documents[id_col].alias("doc_id"), documents[source_col].alias("source"), documents[text_col].alias("text"))
    return spread(docs, "doc_id")


def _summaries(docs: DataFrame, share: float) -> DataFrame:
    """(source, documents, slack, h, extra): a summary of each source and task, its hashes packed in arrays. A task that
    holds many sources hands on what it has and begins anew: summaries of any division of the documents can be merged."""

    def handed(of: dict[str, Summary]) -> Iterator[pa.RecordBatch]:
        items = list(of.items())
        for a in range(0, len(items), 512):
            some = [(source, s.documents, *s.heavy()) for source, s in items[a : a + 512]]
            ends = np.r_[0, np.cumsum([len(x[2]) for x in some])].astype(np.int32)
            h = pa.ListArray.from_arrays(ends, pa.array(signed(k for x in some for k in x[2])))
            extra = pa.ListArray.from_arrays(ends, pa.array([e for x in some for e in x[3]], pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.string()), pa.array([x[1] for x in some], pa.int64()), pa.array([x[4] for x in some], pa.int64()), h, extra], names=["source", "documents", "slack", "h", "extra"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, Summary] = {}
        held = 0
        for batch in batches:
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = set(keys_of(text))
                keys.discard("")
                s = of.setdefault(source, Summary(share))
                held -= len(s.counts)
                s.add(set(hashes_of(source, keys)))
                held += len(s.counts) + 1
                if held > TASK_COUNTERS:
                    yield from handed(of)
                    of, held = {}, 0
        yield from handed(of)

    return docs.select("source", "text").mapInArrow(run, "source string, documents bigint, slack bigint, h array<bigint>, extra array<int>")


def _slice(source: str) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(SLICES)).cast("int")


def candidate_lines(scope: Scope, docs: DataFrame, min_documents: int, min_share: float) -> tuple[DataFrame, DataFrame]:
    """(h, slice) of every line that may reach the threshold, and (source, need) with the documents it needs.

    The summaries' bounds add up: a line can occur at most slack + extra times. Sources of too few documents are left
    out before their lines are taken from the arrays; sums are by line hash and combined before the shuffle, so that
    neither a source nor a line is a hot task."""
    there = docs.where("source is not null and text is not null")
    merged = scope.written(_summaries(there, min_share), "summaries")
    need = F.greatest(F.lit(min_documents).cast("bigint"), F.ceil(F.sum("documents") * F.lit(min_share) - F.lit(1e-9)))
    totals = merged.groupBy("source").agg(need.alias("need"), F.sum("slack").alias("all_slack"), F.sum("documents").alias("d")).where(F.col("d") >= F.col("need")).drop("d")
    totals = scope.written(totals, "totals")
    known = left_join_unique(merged.drop("slack"), totals, "source").where("need is not null")
    entries = known.select((F.col("need") - F.col("all_slack")).alias("gap"), _slice("source").alias("slice"), F.explode(F.arrays_zip("h", "extra")).alias("x"))
    summed = entries.groupBy("x.h").agg(F.sum("x.extra").alias("extra"), F.min("gap").alias("gap"), F.min("slice").alias("slice"))
    return scope.written(summed.where("extra >= gap").select("h", "slice"), "candidates"), totals.select("source", "need")


def in_rounds(docs: DataFrame, wanted: DataFrame, step: Callable[[Broadcast], Callable], schema: str) -> DataFrame:
    """mapInArrow of step(hashes) over all documents, where `hashes` is a sorted array of the wanted line hashes (h, slice)
    of their sources. One round holds about ROUND_LINES hashes; each document is in exactly one round."""
    sc = docs.sparkSession.sparkContext
    rounds = max(1, -(-wanted.count() // ROUND_LINES))
    out = None
    for r in range(rounds):
        h = np.unique(wanted.where(F.col("slice") % rounds == r).select("h").toArrow().column(0).to_numpy().astype(np.int64))
        mine = docs if rounds == 1 else docs.where(F.coalesce(_slice("source"), F.lit(0)) % rounds == r)
        one = mine.mapInArrow(step(sc.broadcast(h)), schema)
        out = one if out is None else out.unionByName(one)
    return out


def marked(sources: list[str | None], texts: list[str | None], wanted: np.ndarray) -> Iterator[tuple[list[str], np.ndarray, np.ndarray] | None]:
    """For each text: None if it holds no wanted line, else the keys of its lines, their hashes, and which are wanted."""
    keys = [keys_of(t) if s is not None and t else [] for s, t in zip(sources, texts)] if len(wanted) else [[] for _ in texts]
    flat = signed(chain.from_iterable(hashes_of(s, k) for s, k in zip(sources, keys) if k))
    hit = np.zeros(len(flat), bool)
    if len(flat) and len(wanted):
        hit = (wanted[np.minimum(np.searchsorted(wanted, flat), len(wanted) - 1)] == flat) & (flat != 0)
    at = 0
    for k in keys:
        mine = slice(at, at + len(k))
        at += len(k)
        yield (k, flat[mine], hit[mine]) if hit[mine].any() else None


def _occurrences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, source, key, line_no, first) where a document holds a wanted line; first: in this document."""

    def step(shared: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, keys, numbers, first = [], [], [], []
                for i, found in enumerate(marked(batch.column(1).to_pylist(), batch.column(2).to_pylist(), shared.value)):
                    if found:
                        seen = set()
                        for n in np.flatnonzero(found[2]).tolist():
                            key = found[0][n]
                            rows.append(i)
                            keys.append(key)
                            numbers.append(n)
                            first.append(key not in seen)
                            seen.add(key)
                at = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(keys, pa.string()), pa.array(numbers, pa.int32()), pa.array(first, pa.bool_())], names=["doc_id", "source", "key", "line_no", "first"])

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_rounds(docs, wanted, step, f"doc_id {kind}, source string, key string, line_no int, first boolean")


def repeated_lines(spark: SparkSession, documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """The lines held by at least `min_documents` and `min_share` of their source's documents: (source, key, n), and
    their places: (doc_id, source, key, line_no).

    First pass: a Misra-Gries summary of 64-bit line hashes per source and task. A line below the share in every part
    of the documents is below it as a whole, so that only hashes that may reach it somewhere leave a task (8 bytes each;
    in a task with fewer than 1 / share documents of a source, all of its lines may). Merging adds bounds by source and
    hash; sources with too few documents in all go first. Second pass: exact counts of the candidates by their text,
    summed within partitions before the shuffle. Candidates are broadcast, in rounds over slices of the sources where
    they are many; a source's own number at most its lines a document divided by the share.

    Null sources and texts take no part; lines without a letter never do; a line twice in a document counts once;
    repeated rows count as documents of their own; an empty table gives no rows. Other columns are not read.
    """
    ship(spark)
    docs = _inputs(documents, id_col, source_col, text_col).where("source is not null and text is not null")
    with Scope(spark) as scope:
        candidates, totals = candidate_lines(scope, docs, min_documents, min_share)
        places = scope.written(_occurrences(docs, candidates), "places", keep=True)
        counted = places.groupBy("source", "key").agg(F.sum(F.col("first").cast("bigint")).alias("n"))
        lines = scope.written(left_join_unique(counted, totals, "source").where("n >= need").select("source", "key", "n"), "lines", keep=True)
    found = left_join_unique(places.select("doc_id", "source", "key", "line_no"), lines, ["source", "key"])
    return lines, found.where("n is not null").select("doc_id", "source", "key", "line_no")


def hashed_lines(lines: DataFrame) -> DataFrame:
    """(h, slice) of (source, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = signed(hashes_of(s, [k])[0] for s, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(2)], names=["h", "slice"])

    return lines.where("source is not null and key <> ''").select("source", "key", _slice("source").alias("slice")).mapInArrow(run, "h bigint, slice int")


def without_lines(spark: SparkSession, documents: DataFrame, lines: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, text, removed): every document without its source's `lines` (source, key), and how many went.

    The other lines keep their order and characters. A document without a source, or with none of the lines, keeps its
    text; null stays null. The lines are known by 64-bit hashes and broadcast, in rounds over slices of the sources
    where they are many; texts are never shuffled by source.
    """
    ship(spark)
    docs = _inputs(documents, id_col, source_col, text_col)

    def step(shared: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(2).to_pylist()
                removed = [None if t is None else 0 for t in texts]
                for i, found in enumerate(marked(batch.column(1).to_pylist(), texts, shared.value)):
                    if found:
                        texts[i] = "\n".join(line for line, gone in zip(texts[i].split("\n"), found[2].tolist()) if not gone)
                        removed[i] = int(found[2].sum())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["doc_id", "text", "removed"])

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_rounds(docs, hashed_lines(lines), step, f"doc_id {kind}, text string, removed int")
