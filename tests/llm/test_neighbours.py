from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from quillstone.llm import neighbours

SCHEMA = "id bigint, vector array<float>, cell int, rep string"


def table(spark, rows):
    ids, vectors = zip(*rows) if (rows := list(rows)) else ((), ())
    lists = [None if v is None else list(v) for v in vectors]
    columns = {"id": pa.array(ids, pa.int64()), "vector": pa.array(lists, pa.list_(pa.float32())), "cell": pa.array([1] * len(ids), pa.int32()), "rep": pa.array(["x"] * len(ids), pa.string())}
    return spark.createDataFrame(pa.table(columns), SCHEMA) if ids else spark.createDataFrame([], SCHEMA)


def brute(ids, x, k, least=-2.0, step=1):
    x = x.astype(np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    out = {}
    for i in range(0, len(ids), step):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 9), ids[j]))
        out[ids[i]] = [ids[j] for j in order[:k] if s[i, j] >= least]
    return out


def test_all_cells_give_the_exact_result(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 16))
    ids = list(range(700))
    got = {}
    for r in neighbours.most_similar(spark, table(spark, zip(ids, x)), k=5, probes=1000, dim=16).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.neighbour
    want = brute(ids, x, 5)
    hits = sum(len(set(got[i].values()) & set(want[i])) for i in ids)
    assert hits >= 0.995 * 5 * 700 and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())


def test_recall_with_few_probes(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 64))
    x = centres[rng.integers(0, 30, 3000)] + 0.5 * rng.normal(size=(3000, 64))
    df = table(spark, enumerate(x))
    got = {}
    for r in neighbours.most_similar(spark, df, k=10, queries=df["id"] % 50 == 0, probes=8).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert set(got) == set(range(0, 3000, 50))
    want = brute(list(range(3000)), x, 10, step=50)
    assert sum(len(got[i] & set(want[i])) for i in got) >= 0.9 * 10 * len(got)


def test_pairs_with_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 64))
    rows = list(enumerate(base)) + [(100 + i, base[0]) for i in range(15)] + [(200, 3.0 * base[1]), (201, base[2] + 0.05 * rng.normal(size=64))]
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows])
    bad = [(300, None), (301, []), (302, base[0][:10]), (303, np.zeros(64)), (304, [float("nan")] * 64), (305, [float("inf")] * 64), (306, [None] * 64), (None, base[0])]
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(spark, table(spark, rows + bad)).collect()}
    want = {(min(a, b), max(a, b)) for a, near in brute(ids, x, 10, 0.9).items() for b in near}
    assert got == want and (1, 200) in got and (2, 201) in got


def test_small_and_empty_tables(spark):
    assert neighbours.most_similar(spark, table(spark, [])).count() == 0
    assert neighbours.most_similar(spark, table(spark, [(1, None)])).count() == 0
    one = [1.0] * 64
    assert neighbours.most_similar(spark, table(spark, [(1, one)])).count() == 0
    out = neighbours.most_similar(spark, table(spark, [(1, one), (2, one), (2, one), (3, [-1.0] * 64)])).collect()
    assert {(r.id, r.neighbour) for r in out if r.cosine > 0.99} >= {(1, 2), (2, 1)}
    with pytest.raises(ValueError):
        neighbours.most_similar(spark, table(spark, []), dim=10)


def test_cells_cut_into_groups(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 50)
    rng = np.random.default_rng(4)
    x = 1 + 0.2 * rng.normal(size=(300, 64))
    got = {(r.id, r.neighbour) for r in neighbours.most_similar(spark, table(spark, enumerate(x)), k=3, probes=100).collect()}
    want = {(i, j) for i, near in brute(list(range(300)), x, 3).items() for j in near}
    assert len(got & want) >= 0.98 * len(want)


def test_exact_mode_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 16))
    got = {}
    for r in neighbours.most_similar(spark, table(spark, enumerate(x)), k=4, exact=True, dim=16).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.neighbour
    assert {i: [g[n] for n in sorted(g)] for i, g in got.items()} == brute(list(range(400)), x, 4)


def test_two_levels_of_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 5)
    monkeypatch.setattr(neighbours, "MOST_CELLS", 30)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 64))
    x = centres[rng.integers(0, 60, 3000)] + 0.3 * rng.normal(size=(3000, 64))
    df = table(spark, enumerate(x))
    index, share, visits = neighbours.fit(df.where("vector is not null"), 64, 3000, 40, 2.0)
    assert len(index) > 30 and visits.sum() > 40 - 1e-6
    near, _ = index.cells(neighbours.unit_rows(df.select("vector").toArrow().column("vector").combine_chunks(), 64).astype(np.float32), 40, 2.0)
    assert len(np.unique(near[:, 0])) > 30
    got = {}
    for r in neighbours.most_similar(spark, df, k=10, queries=df["id"] % 50 == 0, probes=60).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    want = brute(list(range(3000)), x, 10, step=50)
    assert sum(len(got[i] & set(want[i])) for i in got) >= 0.9 * 10 * len(got)


def test_hot_cells_and_hubs(spark, monkeypatch):
    """One cell of nearly all vectors, cut into groups on both sides, and a vector near to all others."""
    monkeypatch.setattr(neighbours, "SHARD", 40)
    monkeypatch.setattr(neighbours, "ASKING", 30)
    rng = np.random.default_rng(8)
    x = 1 + 0.3 * rng.normal(size=(300, 64))
    x[0] = 1
    got = {(r.id, r.neighbour) for r in neighbours.most_similar(spark, table(spark, enumerate(x)), k=3, probes=100).collect()}
    want = {(i, j) for i, near in brute(list(range(300)), x, 3).items() for j in near}
    assert len(got & want) >= 0.98 * len(want) and all((i, 0) in got for i in range(1, 300))
