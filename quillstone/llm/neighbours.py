"""The most similar vectors of every vector: an inverted file of coarse centroids with product-quantised residuals,
asymmetric distance tables and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators.joins import left_join_unique
from quillstone.runtime import Scope, maybe_broadcast, ship

#: The index is fitted on at most so many vectors; every vector is indexed.
SAMPLE = 60_000
#: Vectors per cell aimed at, and the most centroids of either level (16 sample vectors must stand for one).
CELL, MOST_CELLS = 160, 4096
#: Sub-vectors of a residual and the centroids of each; a code has one byte a part.
PARTS, CODES = 16, 256
#: Index rows and queries that meet in one task's group.
SHARD, ASKING = 4000, 8000
#: Rows of about 100 bytes in a partition of the search.
PARTITION = 150_000
#: Candidates of a query whose cosines are computed; half as many may come from each of its NEAREST cells' groups.
RERANK, NEAREST = 400, 8
SEED = 11


def usable(vector: Column, dim: int) -> Column:
    """Vectors that take part: of the dimension, with finite numbers only, and not all zero."""
    low, high = F.array_min(vector), F.array_max(vector)  # NaN counts as the greatest
    finite = ~F.isnan(high) & (high < F.lit(float("inf"))) & (low > F.lit(float("-inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & F.coalesce(finite & ((low != 0) | (high != 0)), F.lit(False)) & ~F.exists(vector, lambda x: x.isNull())


def spherical_kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(x), 8192)])
        order = np.argsort(near, kind="stable")
        filled, starts = np.unique(near[order], return_index=True)
        c[filled] = np.add.reduceat(x[order], starts, axis=0)
        empty = np.setdiff1d(np.arange(k), filled)
        c[empty] = x[rng.choice(len(x), len(empty))]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def euclidean_kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 8192] @ c.T - (c * c).sum(1) / 2).argmax(1) for i in range(0, len(x), 8192)])
        sums, n = np.zeros_like(c), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c.astype(np.float32)


@dataclass
class Index:
    """Coarse centroids (unit length), fine centroids of what they leave (one of zeros where one level is enough), the
    codebooks of residuals (parts, codes, width), and by how much codes underrate a vector's cosine with itself, but for
    one in a thousand.
    A cell is a pair of a coarse and a fine centroid."""

    coarse: np.ndarray
    fine: np.ndarray
    books: np.ndarray
    deficit: float = 0.0

    def __len__(self) -> int:
        return len(self.coarse) * len(self.fine)

    def centroids(self, cell: np.ndarray) -> np.ndarray:
        return self.coarse[cell // len(self.fine)] + self.fine[cell % len(self.fine)]

    def cells(self, unit: np.ndarray, probes: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """The `probes` nearest cells of each vector, the nearest first, and which of them lie within `reach` of it."""
        if len(self.fine) > 1 and len(unit) > 256:
            parts = [self.cells(unit[i : i + 256], probes, reach) for i in range(0, len(unit), 256)]
            return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
        k1, k2 = len(self.coarse), len(self.fine)
        p1 = min(k1, probes if k2 == 1 else max(8, 4 * -(-probes // k2)))
        score = unit @ self.coarse.T
        top = np.argpartition(-score, p1 - 1, axis=1)[:, :p1] if p1 < k1 else np.tile(np.arange(k1), (len(unit), 1))
        score = np.take_along_axis(score, top, 1)
        if k2 > 1:
            if not hasattr(self, "cross"):
                self.cross = self.coarse @ self.fine.T + (self.fine**2).sum(1) / 2
            score = (score[:, :, None] + (unit @ self.fine.T)[:, None] - self.cross[top]).reshape(len(unit), -1)
            top = (top[:, :, None] * k2 + np.arange(k2)).reshape(len(unit), -1)
            p = min(probes, score.shape[1])
            keep = np.argpartition(-score, p - 1, axis=1)[:, :p] if p < score.shape[1] else np.tile(np.arange(p), (len(unit), 1))
            top, score = np.take_along_axis(top, keep, 1), np.take_along_axis(score, keep, 1)
        order = np.argsort(-score, axis=1, kind="stable")
        score = np.take_along_axis(score, order, 1)
        return np.take_along_axis(top, order, 1), score >= score[:, :1] - reach

    def encode(self, unit: np.ndarray, cell: np.ndarray) -> np.ndarray:
        parts, codes, width = self.books.shape
        rest = (unit - self.centroids(cell)).reshape(len(unit), parts, width)
        return np.stack([(rest[:, m] @ self.books[m].T - (self.books[m] ** 2).sum(1) / 2).argmax(1) for m in range(parts)], 1).astype(np.uint8)

    def estimate(self, unit: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Cosines of queries and coded vectors of a cell: one table of inner products per query and part, then look-ups."""
        parts, _, width = self.books.shape
        tables = np.ascontiguousarray(unit.reshape(len(unit), parts, width).transpose(1, 0, 2)) @ self.books.transpose(0, 2, 1)
        score = np.repeat((unit @ self.centroids(np.array([cell]))[0])[:, None], len(codes), 1)
        for m in range(parts):
            score += np.take(tables[m], codes[:, m], axis=1)
        return score


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten()).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(vectors: DataFrame, dim: int, rows: int, probes: int | None, reach: float, sample: int = SAMPLE, seed: int = SEED) -> tuple[Index, np.ndarray, np.ndarray]:
    """Fit on a sample of at most about `sample` vectors, chosen by hash, so that the same table gives the same index;
    with the share of all vectors that lies in each cell, and the share that visits it, both estimated by the sample."""
    take = vectors if rows <= sample else vectors.where(F.pmod(F.xxhash64("vector", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * sample / rows))
    x = unit_rows(take.select("vector").limit(2 * sample).toArrow().column("vector").combine_chunks(), dim).astype(np.float32)
    x = x[np.lexsort(x.T[:4])]  # rows arrive in any order
    rng = np.random.default_rng(seed)
    wanted, most = max(1, rows // CELL), max(1, min(MOST_CELLS, len(x) // 16))
    c = spherical_kmeans(x, min(wanted, most), 6, rng)
    near = np.concatenate([(x[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(x), 8192)])
    fine = np.zeros((1, dim), np.float32)
    if wanted > 2 * len(c):
        fine = euclidean_kmeans(x - c[near], min(most, wanted // len(c)), 6, rng)
    index = Index(c, fine, np.zeros((PARTS, CODES, dim // PARTS), np.float32))
    p = probes or default_probes(len(index))
    homes, visits = [], np.zeros(len(index))
    for i in range(0, len(x), 4096):
        cells, within = index.cells(x[i : i + 4096], p, reach)
        homes.append(cells[:, 0])
        np.add.at(visits, cells[within], 1)
    home = np.concatenate(homes)
    share = np.bincount(home, minlength=len(index)) / len(x)
    if len(fine) > 1:  # too many cells for the sample: shares of both levels are multiplied
        by = np.bincount(home // len(fine), minlength=len(c))[:, None] * np.bincount(home % len(fine), minlength=len(fine))[None] / len(x) ** 2
        share, visits = np.maximum(share, by.ravel()), np.maximum(visits, by.ravel() * p * len(x))
    some = rng.choice(len(x), min(len(x), 16_384), replace=False)
    rest = (x[some] - index.centroids(home[some])).reshape(len(some), PARTS, dim // PARTS)
    index.books = np.stack([euclidean_kmeans(np.ascontiguousarray(rest[:, m]), CODES, 8, rng) for m in range(PARTS)])
    codes = index.encode(x, home)
    back = np.stack([index.books[m][codes[:, m]] for m in range(PARTS)], 1).reshape(len(x), dim) + index.centroids(home)
    index.deficit = float(np.quantile(np.maximum(0, 1 - (x * back).sum(1)), 0.999))
    return index, share, visits / len(x)


def default_probes(cells: int) -> int:
    return max(32, cells // 16)


def packed(unit: np.ndarray) -> list[bytes]:
    """Unit vectors with one byte a number, and their scale; for estimates only."""
    scale = np.abs(unit).max(1, keepdims=True).astype(np.float32) / 127
    small = np.rint(unit / scale).astype(np.int8)
    return [a.tobytes() + b.tobytes() for a, b in zip(scale, small)]


def unpacked(data: list[bytes], dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), dim + 4)
    return np.ascontiguousarray(raw[:, 4:]).view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


def _place(reps: DataFrame, index: Broadcast, shards: np.ndarray, blocks: np.ndarray, probes: int, reach: float, dim: int) -> DataFrame:
    """Codes in the cells of their vectors, and queries in the cells that they visit. A cell is cut into shards of codes
    and blocks of queries, by hash; each shard meets each block in a group of its own. asks: 0 for a code, 1 for a query
    in one of its NEAREST cells, 2 for one in another."""
    sizes = reps.sparkSession.sparkContext.broadcast((shards, blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (shards, blocks) = index.value, sizes.value

        def copies(at: np.ndarray, cell: np.ndarray, mine: np.ndarray, many: np.ndarray):
            """Rows repeated for each of `many`, with their own hashed part and the running one."""
            n = many[cell]
            rows = np.repeat(np.arange(len(at)), n)
            running = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            return at[rows], cell[rows], mine[rows], running

        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                unit = unit_rows(part.column(1), dim).astype(np.float32)
                near, within = own.cells(unit, probes, reach)
                home, mix = near[:, 0], part.column(3).to_numpy()
                codes = [c.tobytes() for c in own.encode(unit, home)]
                at, cell, shard, block = copies(np.arange(len(unit)), home, mix % shards[home], blocks)
                asked = np.asarray(part.column(2).to_numpy(zero_copy_only=False), bool)
                q, p = np.nonzero(within & asked[:, None])
                qat, qcell, qblock, qshard = copies(q, near[q, p], mix[q] % blocks[near[q, p]], shards)
                far = np.repeat(np.where(p < NEAREST, 1, 2), shards[near[q, p]])
                small = packed(unit)
                data = [codes[i] for i in at.tolist()] + [small[i] for i in qat.tolist()]
                both = lambda x, y, kind: pa.array(np.concatenate([x, y]).astype(kind))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(both(at, qat, np.int32)), both(cell, qcell, np.int32), both(shard, qshard, np.int32), both(block, qblock, np.int32), both(np.zeros(len(at)), far, np.int8), pa.array(data, pa.binary())],
                    names=["id", "cell", "shard", "block", "asks", "data"],
                )

    kind = reps.schema["id"].dataType.simpleString()
    return reps.select("id", "vector", "asked", "mix").mapInArrow(run, f"id {kind}, cell int, shard int, block int, asks tinyint, data binary")


def _guess(placed: DataFrame, index: Broadcast, each: tuple[int, int] | None, floor: float, dim: int) -> DataFrame:
    """(id, neighbour, guess): of each query in each group the best by its distance tables, from `floor`; at most `each`
    in its NEAREST cells and in others, None: all."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks, cell, ids, data = t.column("asks").to_numpy(), t.column("cell")[0].as_py(), t.column("id"), t.column("data")
        inside = np.flatnonzero(asks == 0)
        left, right, score = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.float32)]
        if len(inside) and len(inside) < len(asks):
            codes = np.frombuffer(b"".join(data.take(pa.array(inside)).to_pylist()), np.uint8).reshape(len(inside), -1)
            for kind in (1, 2):
                asking = np.flatnonzero(asks == kind)
                keep = len(inside) if each is None else min(each[kind - 1] + 1, len(inside))
                for a in range(0, len(asking), 512):
                    q = asking[a : a + 512]
                    guess = index.value.estimate(unpacked(data.take(pa.array(q)).to_pylist(), dim), cell, codes)
                    if keep < len(inside):
                        best = np.argpartition(-guess, keep - 1, axis=1)[:, :keep]
                        r, c = np.nonzero(np.take_along_axis(guess, best, 1) >= floor)
                        c = best[r, c]
                    else:
                        r, c = np.nonzero(guess >= floor)
                    left.append(q[r])
                    right.append(inside[c])
                    score.append(guess[r, c])
        left, right, score = map(np.concatenate, (left, right, score))
        out = pa.table({"id": ids.take(pa.array(left)), "neighbour": ids.take(pa.array(right)), "guess": pa.array(score, pa.float32())})
        return out.filter(pa.compute.not_equal(out["id"], out["neighbour"]))

    kind = placed.schema["id"].dataType.simpleString()
    return placed.groupBy("cell", "shard", "block").applyInArrow(run, f"id {kind}, neighbour {kind}, guess float")


def _exact(pairs: DataFrame, reps: DataFrame, dim: int) -> DataFrame:
    """(id, neighbour, cosine) of stored pairs. A vector that is a candidate of very many is no hot task."""
    v = reps.select("id", "vector")
    asked = v.join(maybe_broadcast(pairs.select("id").distinct()), "id", "left_semi")
    other = v.withColumnRenamed("id", "neighbour").join(maybe_broadcast(pairs.select("neighbour").distinct()), "neighbour", "left_semi")
    both = left_join_unique(pairs, other.withColumnRenamed("vector", "y"), "neighbour", rows=0)
    both = both.join(maybe_broadcast(asked.withColumnRenamed("vector", "x")), "id").select("id", "neighbour", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = np.einsum("nd,nd->n", unit_rows(batch.column(2), dim), unit_rows(batch.column(3), dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine)], names=["id", "neighbour", "cosine"])

    kind = pairs.schema["id"].dataType.simpleString()
    # a repeated id may hold several vectors: its best counts, and each pair once
    return both.mapInArrow(run, f"id {kind}, neighbour {kind}, cosine double").groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))


def most_similar(spark: SparkSession, table: DataFrame, k: int = 10, queries: Column | None = None, probes: int | None = None, least: float = -2.0, rerank: int = RERANK, reach: float = 2.0, exact: bool = False, id_col: str = "id", vector_col: str = "vector", dim: int = 64) -> DataFrame:
    """(id, neighbour, cosine, rank): up to `k` most similar other rows of each query row, rank from 1.

    `queries`: a condition on the table that chooses the rows to ask for (default: all). `least`: only neighbours of at
    least this cosine. Equal cosines are ranked by id. Vectors that are null, not `dim` wide, all zero, or hold NaN or
    infinities, and null ids, take no part; a repeated id counts as its rows do; an empty table gives no rows; other
    columns are not read. `dim` must be a multiple of PARTS.

    Equal vectors (by two 64-bit hashes) are one class, shown by its least id; the k + 1 least ids of a class stand for
    all its members, so that a group of copies of any size stays linear. The index has as many cells as CELL demands,
    on two levels where one has too few. Each class is coded in its nearest cell; a query visits the `probes` nearest
    cells (default: a sixteenth of all, at least 32) that are within `reach` of the nearest. There, look-up tables over
    the codes give guesses; the best `rerank` of all visited cells are compared exactly, once. Codes and queries of a
    cell are cut by hash into groups of bounded size. Where all rows ask, each pair counts for both sides.
    Recall depends on probes, reach and rerank; README has the measured figures. `exact` visits all cells and compares
    all vectors, for small tables and for checks.
    """
    if dim % PARTS:
        raise ValueError(f"the dimension must be a multiple of {PARTS}")
    ship(spark)
    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    rows = table.select(table[id_col].alias("id"), table[vector_col].cast("array<float>").alias("vector"), asked.alias("asked")).where(usable(F.col("vector"), dim) & F.col("id").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector"))
    kind = rows.schema["id"].dataType.simpleString()
    with Scope(spark) as scope:
        groups = scope.written(rows.groupBy("h", "h2").agg(F.count("*").alias("n"), F.min("id").alias("rep"), F.max("asked").alias("any")), "classes")
        total, asking = groups.agg(F.count("*"), F.coalesce(F.count_if("any"), F.lit(0))).first()
        if total == 0:
            return spark.createDataFrame([], f"id {kind}, neighbour {kind}, cosine double, rank int")
        copied = groups.where("n > 1").select("h", "h2", "rep", "any")
        joined = left_join_unique(rows, copied, ["h", "h2"])
        mix = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("int").alias("mix")
        shown = F.when(F.col("rep").isNull() | (F.col("rep") == F.col("id")), F.col("vector")).alias("vector")  # once a class
        stored = scope.written(joined.select("id", "rep", "asked", F.coalesce("any", "asked").alias("any"), mix, shown), "vectors", keep=True)
        reps = stored.where("vector is not null").select("id", "vector", F.col("any").alias("asked"), "mix")
        members = stored.where("rep is not null").select("rep", "id", "asked")
        index, share, visits = fit(reps, dim, total, probes, reach)  # classes, not rows: copies would crowd the sample
        probes = len(index) if exact else probes or default_probes(len(index))
        if exact:
            reach, visits = 9.0, np.ones(len(index))
        shards = np.maximum(1, np.ceil(share * total / SHARD)).astype(np.int64)
        blocks = np.maximum(1, np.ceil(visits * asking / ASKING)).astype(np.int64)
        shared = spark.sparkContext.broadcast(index)
        each = None if exact else (max(2 * k, rerank // 2), max(2 * k, -(-2 * rerank // probes)))
        floor = -9.0 if exact else least - 0.01 - 1.2 * index.deficit
        placed = _place(reps, shared, shards, blocks, probes, reach, dim)
        # partitions follow the data: codes in each block of their cell, queries in each shard of the cells they visit
        n = int(total * (share * blocks).sum() + asking * (visits * shards).sum())
        placed = placed.repartition(max(spark.sparkContext.defaultParallelism, n // PARTITION), "cell", "shard", "block")
        guesses = _guess(placed, shared, each, floor, dim)
        if not exact:
            guesses = guesses.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("guess"), "neighbour"))).where(F.col("r") <= rerank)
        pairs = guesses.select("id", "neighbour")
        if queries is None:
            pairs = pairs.select(F.least("id", "neighbour").alias("id"), F.greatest("id", "neighbour").alias("neighbour"))
        found = _exact(scope.written(pairs.distinct(), "pairs"), reps, dim).where(F.col("cosine") >= max(least, -2.0))
        if queries is None:
            found = found.select(F.explode(F.array(F.struct("id", "neighbour", "cosine"), F.struct(F.col("neighbour").alias("id"), F.col("id").alias("neighbour"), "cosine"))).alias("x")).select("x.*")
        found = scope.written(found, "found", keep=True)

        # from classes to rows: lists of at most k + 1 ids a class, then a narrow step for its members
        few = members.select("rep", "id", F.row_number().over(Window.partitionBy("rep").orderBy("id")).alias("r")).where(F.col("r") <= k + 1)
        few = scope.written(few.select("rep", F.col("id").alias("copy")), "copies", keep=True)
        best = F.struct((-F.col("cosine")).alias("s"), F.col("neighbour").alias("nb"))
        spread = found.join(maybe_broadcast(few.withColumnRenamed("rep", "neighbour")), "neighbour", "left").select("id", F.coalesce("copy", "neighbour").alias("neighbour"), "cosine")
        own = few.select(F.col("rep").alias("id"), F.col("copy").alias("neighbour"), F.lit(1.0).alias("cosine"))
        ranked = spread.unionByName(own).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("r") <= k + 1)
        lists = scope.written(ranked.groupBy("id").agg(F.sort_array(F.collect_list(best)).alias("list")), "lists", keep=True)
        of_members = left_join_unique(members.where("asked").select("rep", "id"), lists.join(maybe_broadcast(few.select(F.col("rep").alias("id")).distinct()), "id", "left_semi").withColumnRenamed("id", "rep"), "rep")
        named = lists.join(maybe_broadcast(few.select(F.col("rep").alias("id")).distinct()), "id", "left_anti").select("id", "list").unionByName(of_members.select("id", "list"))
    out = named.select("id", F.posexplode(F.slice(F.filter("list", lambda x: x["nb"] != F.col("id")), 1, k)).alias("p", "x"))
    return out.select("id", F.col("x.nb").alias("neighbour"), (-F.col("x.s")).alias("cosine"), (F.col("p") + 1).cast("int").alias("rank"))


#: similar_pairs: cells that a vector visits at most, and how much farther than its own they may be.
PAIR_PROBES, PAIR_REACH = 8, 0.05


def similar_pairs(spark: SparkSession, table: DataFrame, least: float = 0.9, k: int = 10, probes: int = PAIR_PROBES, reach: float = PAIR_REACH, rerank: int = 128, exact: bool = False, id_col: str = "id", vector_col: str = "vector", dim: int = 64) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of a cosine of at least `least` of which one is among the k most similar of the
    other. Such near vectors lie in the same or neighbouring cells, so that a reach finds all but a trace of them."""
    lists = most_similar(spark, table, k, None, probes, least, rerank, reach, exact, id_col, vector_col, dim)
    return lists.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
