"""Cutting long texts into overlapping pieces at the strongest natural boundary in reach."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.runtime import ship, spread

MAX_CHARS, OVERLAP, LEAST_SHARE = 4000, 200, 0.5
#: A line break, or white space right after a full stop, exclamation or question mark.
BOUNDARY = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]|(?<=[.!?])\s")
BREAKS = frozenset("\n\r\x0b\x0c\x85\u2028\u2029")
#: Boundaries that one sparse table holds at least; longer texts take one after another.
BLOCK = 1 << 16


def boundaries(text: str, both_sides: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Where a text may be cut (just after each boundary; with `both_sides` just before it, too), in order, and how strong
    each cut is: 3 after an empty line, 2 after a line break that ends a sentence, 1.5 after another line break, 1 after a
    sentence. Both sides of a boundary are equally strong."""
    at, strength = array("q"), array("d")
    for m in BOUNDARY.finditer(text):
        a, b = m.span()
        if text[a] in BREAKS:
            before = text[a - 1] if a else "\n"
            s = 3.0 if before in BREAKS or text[b : b + 1] in BREAKS else 2.0 if before in ".!?" else 1.5
        else:
            s = 1.0
        if both_sides:
            at.append(a)
            strength.append(s)
        at.append(b)
        strength.append(s)
    return np.asarray(at), np.asarray(strength)


class StrongestCut:
    """A sparse table: the strongest boundary of any range of boundaries in constant time, the rightmost of equals."""

    def __init__(self, strength: np.ndarray):
        self.strength = strength
        self.rows = [np.arange(len(strength))]
        while 2 ** len(self.rows) <= len(strength):
            half, last = 2 ** (len(self.rows) - 1), self.rows[-1]
            left, right = last[:-half], last[half:]
            self.rows.append(np.where(strength[left] > strength[right], left, right))

    def query(self, lo: int, hi: int) -> int:
        """Of boundaries lo to hi - 1."""
        row = self.rows[(hi - lo).bit_length() - 1]
        left, right = row[lo], row[hi - 2 ** ((hi - lo).bit_length() - 1)]
        return int(left if self.strength[left] > self.strength[right] else right)


def pieces(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, least_share: float = LEAST_SHARE, both_sides: bool = False) -> list[tuple[int, int, bool]]:
    """(start, end, forced) of each piece. A piece adds at most max_chars - overlap new characters and begins `overlap`
    before the end of the piece before it. Its end is the strongest boundary in the upper part of the window (from
    least_share of the new characters on), else the strongest in the whole window, else the window's end, by force.
    With `both_sides` a boundary whose end is out of reach may be cut at its start, so that a cut is forced only in a run of
    more than max_chars - overlap characters between boundaries (of two at least, a `\\r\\n`), their own not counted."""
    step = max_chars - overlap
    if len(text) <= max_chars:
        return [(0, len(text), False)]
    at, strength = boundaries(text, both_sides)
    table, base, stop = None, 0, 0  # the table holds boundaries base to stop - 1
    out, cut = [], 0
    while True:
        start = max(0, cut - overlap)
        if len(text) - cut <= step:
            out.append((start, len(text), False))
            return out
        hi = int(np.searchsorted(at, cut + step, "right"))
        lo = int(np.searchsorted(at, cut + int(step * least_share), "left"))
        first = int(np.searchsorted(at, cut, "right"))
        if hi > stop:
            base, stop = min(lo, first), max(hi, first + BLOCK)
            table = StrongestCut(strength[base:stop])
        if lo < hi:
            end, forced = int(at[base + table.query(lo - base, hi - base)]), False
        elif first < hi:
            end, forced = int(at[base + table.query(first - base, hi - base)]), False
        else:
            end, forced = cut + step, True
        out.append((start, end, forced))
        cut = end


def split_documents(spark: SparkSession, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_chars: int = MAX_CHARS, overlap: int = OVERLAP, with_text: bool = True, only_long: bool = True, both_sides: bool = False) -> DataFrame:
    """(doc_id, chunk_index, start_char, end_char, cut, text): the pieces of each text over `max_chars` characters.

    Pieces are numbered from 0, hold at most `max_chars` characters, and share `overlap` with the piece before. cut is
    how the piece ends: `natural` at a boundary or the end of the text, `forced` where none was in reach (with
    `both_sides`: neither the end nor the start of one). Without `with_text`, the text column is left out. With
    only_long=False shorter texts come out whole; null texts never come out, empty ones only then. Repeated rows come out repeatedly. Narrow, without a shuffle; each text is cut as a whole.
    """
    if not 0 <= overlap < max_chars:
        raise ValueError("the overlap must be smaller than the pieces")
    ship(spark)
    docs = documents.select(documents[id_col].alias("doc_id"), documents[text_col].alias("text")).where(F.length("text") > max_chars if only_long else F.col("text").isNotNull())
    docs = spread(docs, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [(i, n, *p) for i, t in enumerate(texts) for n, p in enumerate(pieces(t, max_chars, overlap, both_sides=both_sides))]
            i, n, start, end, forced = map(list, zip(*rows)) if rows else ([], [], [], [], [])
            columns = [batch.column(0).take(pa.array(i, pa.int32())), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(["forced" if x else "natural" for x in forced], pa.string())]
            if with_text:
                columns.append(pa.array([texts[r[0]][r[2] : r[3]] for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "chunk_index", "start_char", "end_char", "cut", "text"][: len(columns)])

    kind = documents.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, chunk_index int, start_char bigint, end_char bigint, cut string" + ", text string" * with_text)


def cut_kinds(pieces_df: DataFrame) -> DataFrame:
    """(doc_id, cut) by document: forced if any of its cuts is. Counts are combined before the shuffle."""
    return pieces_df.groupBy("doc_id").agg(F.when(F.max(F.col("cut") == "forced"), "forced").otherwise("natural").alias("cut"))
