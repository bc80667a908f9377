"""Byte-level BPE of a public vocabulary, in batched numpy merge rounds.

The symbols of all new words of a batch lie in one flat array. A round finds each word's lowest-rank pair by binary
search over sorted pair keys, merges all its places at once, and drops the words that have no pair left.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quillstone.runtime import ship, spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the published pattern that splits text before the merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space beside other white space, or at an end of the text.
SPACE_RUNS = [p for c in map(chr, range(0x3001)) if c.isspace() for p in dict.fromkeys((c + " ", " " + c))]
NO_PAIR = np.iinfo(np.int32).max
#: Characters handled at once in a worker, and words and symbols that it remembers; they bound memory, not results.
BATCH_CHARS, CACHE_WORDS, CACHE_SYMBOLS = 1_500_000, 400_000, 4_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable Latin-1 stands for itself, the rest follows 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Arrays of a byte-level BPE file: the id of each byte, and sorted pair keys with their ranks and merged ids."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, merges = model["vocab"], model["merges"]
        self.base = max(vocab.values()) + 1
        self.byte_id = np.zeros(256, np.int64)
        for char, byte in byte_alphabet().items():
            self.byte_id[byte] = vocab[char]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.arange(len(keys), dtype=np.int32)[order]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NO_PAIR).astype(np.int32)


def merge_words(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each of `words` (none empty): all ids in word order, and how many each word has."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    sym = v.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), lens)
    rank = np.full(len(sym), NO_PAIR, np.int32)
    inner = np.flatnonzero(word[:-1] == word[1:])
    rank[inner] = v.pair_ranks(sym[inner], sym[inner + 1])
    done_sym, done_word = [], []
    while len(sym):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[starts, len(sym)])
        least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        live = least != NO_PAIR
        if not live.all():
            done_sym.append(sym[~live])
            done_word.append(word[~live])
            sym, word, rank, least = sym[live], word[live], rank[live], least[live]
            if not len(sym):
                break
        hit = rank == least
        at = np.flatnonzero(hit)
        # of overlapping places, as in "aaa", every second one counts from the left
        run = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
        sym[at] = v.merged[rank[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        new = np.cumsum(keep) - 1
        changed = new[at]
        sym, word, rank = sym[keep], word[keep], rank[keep]
        again = np.zeros(len(sym), bool)
        again[changed] = True
        again[changed[changed > 0] - 1] = True
        rank[again] = NO_PAIR
        inner = np.flatnonzero(again[:-1])
        inner = inner[word[inner] == word[inner + 1]]
        rank[inner] = v.pair_ranks(sym[inner], sym[inner + 1])
    sym, word = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
    order = np.argsort(word, kind="stable")
    return sym[order].astype(np.int32), np.bincount(word, minlength=len(words))


class Encoder:
    """Encodes texts in batches and remembers the ids of words it has met."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        self.v, self.rx = vocabulary, regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def learn(self, words: list[str]) -> None:
        split = list(map(self.rx.findall, words))
        distinct = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        ids, per = merge_words(self.v, [w.encode("utf-8", "replace") for w in distinct]) if distinct else (np.empty(0, np.int32), np.empty(0, np.int64))
        at = np.fromiter(map(distinct.__getitem__, chain.from_iterable(split)), np.int64)
        starts, size = np.cumsum(per) - per, per[at]
        ends = np.cumsum(size)
        ids = ids[np.repeat(starts[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        parts = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        lens = np.diff(np.r_[0, np.r_[0, ends][parts]])
        n, need = len(self.known), self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(2 * need - self.used, np.int32)])
        if n + len(words) > len(self.start):
            more = np.empty(n + 2 * len(words), np.int64)
            self.start, self.count = np.r_[self.start[:n], more], np.r_[self.count[:n], more]
        self.flat[self.used : need] = ids
        self.start[n : n + len(words)] = self.used + np.cumsum(lens) - lens
        self.count[n : n + len(words)] = lens
        self.known.update(zip(words, range(n, n + len(words))))
        self.used = need

    def pieces(self, text: str) -> list[str]:
        """Parts of a text that can be encoded apart. Between two characters that are not white space a single space
        always begins a new word of the pattern, so that such texts are split there, which is much cheaper."""
        if text[:1] == " " or text[-1:] == " " or any(p in text for p in SPACE_RUNS):
            return self.rx.findall(text)
        parts = text.split(" ")
        return parts[:1] + [" " + p for p in parts[1:]]

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The remembered index of each piece of all texts, and the pieces per text."""
        found = list(map(self.pieces, texts))
        if len(self.known) > CACHE_WORDS or self.used > CACHE_SYMBOLS:
            self.forget()
        new = set(chain.from_iterable(found)).difference(self.known)
        if new:
            self.learn(list(new))
        per = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(found)), np.int64, int(per.sum())), per

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in order, and the ids per text."""
        at, per = self.words(texts)
        lens = self.count[at]
        ends = np.cumsum(lens)
        ids = self.flat[np.repeat(self.start[at] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.r_[0, np.cumsum(per)]
        return ids, np.diff(np.r_[0, ends][bounds])

    def sizes(self, texts: list[str]) -> np.ndarray:
        """The ids per text."""
        at, per = self.words(texts)
        bounds = np.r_[0, np.cumsum(per)]
        return np.diff(np.r_[0, np.cumsum(self.count[at])][bounds])


def slices(texts: list[str | None], chars: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of `texts` of about `chars` characters each."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode_documents(spark: SparkSession, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, ids): the token ids of every text, without special tokens.

    Strings that look like special tokens are ordinary text. Null text gives null ids, empty text an empty list. Null
    and repeated doc_ids are passed through row by row; an empty table gives no rows; other columns are not read.
    Narrow: one pass over the scan, without a shuffle where the
    scan has a partition for each core. Only the vocabulary (fixed size) is broadcast.
    """
    ship(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                part = texts[a:b]
                ids, per = encoder.encode([t or "" for t in part])
                null = np.fromiter((t is None for t in part), bool, len(part))
                offsets = pa.array(np.r_[0, np.cumsum(per)].astype(np.int32), mask=np.r_[null, False])
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["doc_id", "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    return spread(documents.select(documents[id_col].alias("doc_id"), documents[text_col].alias("text")), "doc_id").mapInArrow(run, f"doc_id {kind}, ids array<int>")
