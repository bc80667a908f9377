"""Near-duplicate texts: circulant MinHash, banding, a compact sketch filter and exact Jaccard verification.

Texts with the same set of word shingles form one class. Everything up to the verified links works on classes, so that
a text repeated in a third of all rows costs no more than once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.joins import left_join_unique
from quillstone.runtime import Scope, Written, maybe_broadcast, ship, spread, written

WORDS, SIMILARITY, MIN_WORDS = 5, 0.8, 20
#: Coordinates of a signature; the chance, at the threshold itself, that a pair shares no band; bytes of the sketch.
COORDINATES, MISS, SKETCH = 448, 1e-3, 128
#: Places that shingles are hashed to before the circulant permutation (a power of two).
PLACES = 1 << 20
#: Classes of a bucket that are paired by a join; a larger bucket is compared in tiles of TILE x TILE sketches.
BUCKET, TILE = 100, 512
BATCH_CHARS, CACHE_WORDS = 2_000_000, 500_000
#: Band entries in a partition aimed at, so that partitions follow the data; members of a class that meet in one task.
ENTRIES, BLOCK = 1_000_000, 2000

WORD = re.compile(r"[^\W_]+")
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def rows_per_band(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most rows a band can have so that a pair at the threshold shares no band with at most the chance `miss`."""
    best = 1
    for r in range(1, 33):
        if (1 - similarity**r) ** (coordinates // r) <= miss:
            best = r
    return best


class Shingler:
    """Sets of hashed runs of `words` consecutive words of lower-cased whole texts."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def hashes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [WORD.findall(t.lower()) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        for w in set(chain.from_iterable(found)).difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
        per = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(found)), np.uint64, int(per.sum())), per

    def sets(self, texts: list[str], min_words: int) -> Iterator[np.ndarray | None]:
        """The sorted shingle hashes of each text; None where it has fewer than `min_words` words or no shingle."""
        words, per = self.hashes(texts)
        flat = words.copy()
        for k in range(1, self.words):
            flat = mix(flat * M1 + np.r_[words[k:], np.zeros(min(k, len(words)), np.uint64)][: len(flat)])
        begin = 0
        for n in per.tolist():
            yield np.unique(flat[begin : begin + n - self.words + 1]) if n >= max(min_words, self.words) else None
            begin += n


class Circulant:
    """Signatures by two permutations: the first places each shingle, the second, shifted by k places on its circle,
    gives coordinate k. Shifts of one table lie side by side, so that a shingle reads all coordinates at once."""

    def __init__(self, coordinates: int = COORDINATES, seed: int = 7):
        table = np.random.default_rng(seed).permutation(PLACES).astype(np.uint32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.r_[table, table[: coordinates - 1]], coordinates)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = (mix(shingles ^ M3) & np.uint64(PLACES - 1)).astype(np.int64)
        out = self.windows[places[:2048]].min(0)
        for i in range(2048, len(places), 2048):
            np.minimum(out, self.windows[places[i : i + 2048]].min(0), out=out)
        return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    bands = len(signature) // rows
    parts = signature[: bands * rows].reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * M1
    for r in range(rows):
        key = mix(key + parts[:, r] * M2)
    return key.view(np.int64)


def _groups(texts: list[str | None], chars: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars or i + 1 == len(texts):
            yield begin, i + 1
            begin, size = i + 1, 0


def names_of(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit names of a shingle set."""
    return int(mix(shingles + M1).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(shingles ^ M2)).view(np.int64))


def sketches(docs: DataFrame, words: int, rows: int, min_words: int) -> DataFrame:
    """(doc_id, name, check, shingles, sketch, keys): name and check name the shingle set; sketch and keys are null if
    the task met it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, circulant, seen = Shingler(words), Circulant(), set()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _groups(texts):
                at, names, size, sketch, keys = [], [], [], [], []
                for i, s in enumerate(shingler.sets([t or "" for t in texts[a:b]], min_words)):
                    if s is None:
                        continue
                    at.append(a + i)
                    names.append(names_of(s))
                    size.append(len(s))
                    new = names[-1] not in seen
                    if len(seen) < CACHE_WORDS:  # beyond that, a set may be sketched again
                        seen.add(names[-1])
                    if new:
                        signature = circulant.signature(s)
                        sketch.append((signature[:SKETCH] & np.uint32(255)).astype(np.uint8).tobytes())
                        keys.append(band_keys(signature, rows))
                    else:
                        sketch.append(None)
                        keys.append(None)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array([n for n, _ in names], pa.int64()), pa.array([c for _, c in names], pa.int64()), pa.array(size, pa.int32()), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "name", "check", "shingles", "sketch", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, name bigint, check bigint, shingles int, sketch binary, keys array<bigint>")


def classed(sketched: DataFrame) -> DataFrame:
    """With `cls`: the name, or, where sets with different checks share a name, a name of both. So classes are told
    apart by 128 bits, while one word of 64 bits is shuffled."""
    shared = sketched.groupBy("name").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x < y").select("name", F.lit(True).alias("again"))
    if shared.isEmpty():
        return sketched.withColumn("cls", F.col("name"))
    return left_join_unique(sketched, shared, "name").withColumn("cls", F.when(F.col("again"), F.xxhash64("name", "check")).otherwise(F.col("name"))).drop("again")


def least_agreement(similarity: float) -> int:
    """Equal bytes that sketches of a pair at the threshold have, less four standard deviations."""
    p = similarity + (1 - similarity) / 256
    return max(1, math.floor(SKETCH * p - 4 * math.sqrt(SKETCH * p * (1 - p))))


def _tiles(hot: DataFrame, sketch: DataFrame, least: int) -> DataFrame:
    """(a, b): pairs of large buckets whose sketches agree. A bucket is cut into blocks by hash, and each pair of blocks
    is a group of its own, so that no task holds a bucket and no pair is made before its sketches are compared."""
    blocks = F.ceil(F.col("n") / TILE).cast("int")
    placed = hot.select("key", "cls", blocks.alias("blocks"), F.pmod(F.xxhash64("cls", F.lit(1)), blocks).cast("int").alias("own")).join(sketch, "cls")
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "sketch")

    def compare(t: pa.Table) -> pa.Table:
        cls, own, i, j = t.column("cls").to_numpy(), t.column("own").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        bits = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        out = []
        for k in left:
            near = right[(bits[right] == bits[k]).sum(1) >= least]
            near = near[cls[near] > cls[k]] if i == j else near[cls[near] != cls[k]]
            out += [(min(cls[k], c), max(cls[k], c)) for c in cls[near]]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return tiles.groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def candidate_pairs(scope: Scope, sketched: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: classes that share a band and whose sketches agree as those of a similar pair do."""
    least = least_agreement(similarity)
    # one shuffle by key serves the counts and the join back
    flat = sketched.where("keys is not null").select("cls", F.explode("keys").alias("key"))
    n = sketched.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    many = n > ENTRIES * int(scope.spark.conf.get("spark.sql.shuffle.partitions"))
    entries = (flat.repartition(-(-n // ENTRIES), "key") if many else flat.repartition("key")).dropDuplicates(["key", "cls"])
    counts = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = scope.written(entries.join(counts.hint("shuffle_hash"), "key"), "buckets")
    few = shared.where(F.col("n") <= BUCKET)
    pairs = few.select("key", F.col("cls").alias("a")).join(few.select("key", F.col("cls").alias("b")), "key").where("a < b").select("a", "b").distinct()
    sketch = sketched.where("sketch is not null").select("cls", "sketch").join(shared.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"])
    both = pairs.join(sketch.select(F.col("cls").alias("a"), F.col("sketch").alias("x")), "a").join(sketch.select(F.col("cls").alias("b"), F.col("sketch").alias("y")), "b").select("a", "b", "x", "y")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in (2, 3))
            keep = pa.array((x == y).sum(1) >= least)
            yield batch.select([0, 1]).filter(keep)

    out = both.mapInArrow(agree, "a bigint, b bigint")
    hot = shared.where(F.col("n") > BUCKET)
    return out if hot.isEmpty() else out.unionByName(_tiles(hot, sketch, least)).distinct()


class NearDuplicates:
    """The result of near_duplicates: `members` (doc_id, cls) and `links` (a, b, jaccard) between different classes."""

    def __init__(self, spark: SparkSession, members: DataFrame, links: DataFrame):
        self.spark, self.members, self.links = spark, members, links

    def pairs(self) -> DataFrame:
        """(doc_id_a, doc_id_b): every pair of documents, copies included. As long as what it states; see classes."""
        linked = self.links.select(F.explode(F.array("a", "b")).alias("cls")).distinct().withColumn("linked", F.lit(True))
        per = self.members.groupBy("cls").agg(F.count("*").alias("n")).join(linked, "cls", "left").where("linked or n > 1")
        per = written(self.spark, per.select("cls", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "sizes")
        m = left_join_unique(self.members, per, "cls").where("n is not null").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        # members meet in blocks of bounded size, each pair of blocks on its own, so that no class is one task
        blocks = per.select("cls", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        one, two = (m.select(F.col("cls").alias(c), F.col("block").alias(f"block_{c}"), F.col("doc_id").alias(d)) for c, d in (("a", "x"), ("b", "y")))
        met = self.links.select("a", "b")
        for c in ("a", "b"):
            met = met.join(blocks.select(F.col("cls").alias(c), F.col("block").alias(f"block_{c}")), c)
        across = met.join(one, ["a", "block_a"]).join(two, ["b", "block_b"]).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
        same = m.where("n > 1")
        left = same.select("cls", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("doc_id").alias("doc_id_a"))
        within = left.join(same.select("cls", "block", F.col("doc_id").alias("doc_id_b")), ["cls", "block"]).where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")
        return across.where("doc_id_a < doc_id_b").unionByName(within)

    def classes(self) -> DataFrame:
        """(doc_id, class_id, copies, links): one row per document; class_id is the least doc_id with the same shingles."""
        per = self.members.groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
        ends = self.links.select(F.col("a").alias("cls")).unionByName(self.links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("links"))
        facts = written(self.spark, per.join(ends, "cls", "left"), "facts")
        return left_join_unique(self.members, facts, "cls").select("doc_id", "class_id", "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))

    def groups(self) -> DataFrame:
        """(doc_id, group_id): connected documents share the least doc_id of the group. Least labels spread over the links
        and jump along each other until none changes; every round is a written table, and nothing goes to the driver."""
        with Scope(self.spark) as scope:
            label = scope.written(self.members.groupBy("cls").agg(F.min("doc_id").alias("label")), "labels")
            ends = scope.written(self.links.select("a", "b").unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "ends")
            ties = ends.select("a").distinct()
            moving = Written(self.spark, label.join(ties, label.cls == ties.a, "left_semi"), "labels")
            changed = True
            while changed:
                now = moving.df
                near = ends.join(now.select(F.col("cls").alias("b"), F.col("label").alias("seen")), "b").groupBy("a").agg(F.min("seen").alias("seen"))
                step = now.join(near, now.cls == near.a).select("cls", "label", F.least("label", "seen").alias("next"))
                # a label is the doc_id of a class; what that class has reached since holds for this one too
                heads = step.groupBy(F.col("label").alias("head")).agg(F.min("next").alias("reached"))
                step = Written(self.spark, step.join(heads, step.next == heads["head"], "left").select("cls", F.col("label").alias("was"), F.least("next", F.coalesce("reached", "next")).alias("label")), "labels")
                changed = not step.df.where("label < was").isEmpty()
                moving.drop()
                moving = Written(self.spark, step.df.select("cls", "label"), "labels")
                step.drop()
            final = label.join(moving.df.select("cls", F.col("label").alias("better")), "cls", "left").select("cls", F.coalesce("better", "label").alias("group_id"))
            final = scope.written(final, "groups", keep=True)
            moving.drop()
        return left_join_unique(self.members, final, "cls").select("doc_id", "group_id")


def near_duplicates(spark: SparkSession, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> NearDuplicates:
    """Links between texts whose sets of `words` consecutive words have a Jaccard similarity of at least `similarity`.

    Words are runs of letters and digits of the lower-cased whole text. Candidates share a band of their circulant
    MinHash signatures; sketches of 128 bytes drop those that met by chance; the rest are verified on their whole sets
    of 64-bit shingle hashes. A link at the threshold itself is missed with a chance of about one in a thousand, and
    the chance falls steeply above it. No bucket is capped: large ones are compared in tiles. Texts of more shingles than
    PLACES holds look more alike in the signature than they are, which costs candidates, not links.

    Null texts and those with fewer than `min_words` words take no part. Rows that repeat a text are members of one
    class; a repeated doc_id counts as its rows do. An empty table gives no rows. Other columns are not read.
    """
    ship(spark)
    docs = documents.select(documents[id_col].alias("doc_id"), documents[text_col].alias("text")).where("text is not null")
    docs = spread(docs, "doc_id")
    with Scope(spark) as scope:
        sketched = scope.written(sketches(docs, words, rows_per_band(similarity), min_words), "sketches", keep=True)
        sketched = classed(sketched)
        members = sketched.select("doc_id", "cls")
        candidates = scope.written(candidate_pairs(scope, sketched, similarity), "candidates")
        wanted = candidates.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        one = sketched.groupBy("cls").agg(F.min(F.struct("doc_id", "name", "check")).alias("x"))
        chosen = scope.written(one.join(maybe_broadcast(wanted), "cls", "left_semi").select("cls", "x.doc_id", "x.name", "x.check"), "chosen")
        texts = docs.join(maybe_broadcast(chosen), docs["doc_id"].eqNullSafe(chosen["doc_id"])).select("cls", "name", "check", "text")

        def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler(words)
            for batch in batches:
                all_texts = batch.column(3).to_pylist()
                for a, b in _groups(all_texts):
                    found = list(shingler.sets(all_texts[a:b], min_words))
                    part = batch.slice(a, b - a)
                    # rows that share the chosen row's id may hold other texts
                    keep = [i for i, (s, *name) in enumerate(zip(found, part.column(1).to_pylist(), part.column(2).to_pylist())) if s is not None and names_of(s) == tuple(name)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int32())), pa.array([found[i].view(np.int64) for i in keep], pa.list_(pa.int64()))], names=["cls", "found"])

        sets = scope.written(texts.mapInArrow(to_sets, "cls bigint, found array<bigint>").dropDuplicates(["cls"]), "sets")
        common = F.size(F.array_intersect("x", "y"))
        links = (
            candidates.join(sets.select(F.col("cls").alias("a"), F.col("found").alias("x")), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("found").alias("y")), "b")
            .select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("jaccard"))
            .where(F.col("jaccard") >= similarity)
        )
        return NearDuplicates(spark, members, scope.written(links, "links", keep=True))
