from __future__ import annotations

import datetime

from quillstone.operators import joins
from quillstone.operators.references import Reference, direct_orphans, orphan_report, orphans

T1, T2, T3 = (datetime.datetime(2024, m, 1) for m in (1, 5, 9))
GRAPH = (Reference("child", "ref", "id", "at", "parent", "key", "since", "gone"), Reference("parent", "up", "key", "since", "root", "name", "since"))


def tables(spark, child, parent, root):
    return {
        "child": spark.createDataFrame(child, "id bigint, ref bigint, at timestamp, key string, reason string"),
        "parent": spark.createDataFrame(parent, "key bigint, up string, since timestamp, gone timestamp, record_id int"),
        "root": spark.createDataFrame(root, "name string, since timestamp"),
    }


def example(spark):
    child = [(1, 10, T2), (2, 11, T2), (3, 12, T2), (4, 10, None), (5, 99, None), (6, None, T2), (7, 10, T1), (8, 13, T3), (2, 11, T2), (None, 99, T2)]
    parent = [(10, "a", T2, None), (11, "a", T1, T3), (12, "a", T3, None), (13, "missing", T1, None), (14, " a", T3, None), (15, None, T1, None), (None, "a", T1, None)]
    return tables(spark, [(*r, "x", "y") for r in child], [(*r, 0) for r in parent], [("a", T1), ("late", T3)])


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


WANT = sorted([("child", 2, "2024-05", "deleted"), ("child", 3, "2024-05", "late"), ("child", 5, "none", "missing"), ("child", None, "2024-05", "missing"), ("child", 7, "2024-01", "late"), ("parent", 13, "2024-01", "missing"), ("parent", 14, "2024-09", "missing")], key=str)


def test_direct(spark):
    assert rows(direct_orphans(example(spark), GRAPH)) == WANT


def test_shuffled_and_hot_keys_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    assert rows(direct_orphans(example(spark), GRAPH)) == WANT
    hot = tables(spark, [(i, 10 if i % 3 else i, T2, "", "") for i in range(40_000)], [(10, "a", T3, None, 0), (11, "a", T1, None, 0)], [("a", T1)])
    found = direct_orphans(hot, GRAPH).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in found} == {"late": sum(1 for i in range(40_000) if i % 3), "missing": sum(1 for i in range(0, 40_000, 3))}


def test_cascade(spark):
    found = orphans(spark, example(spark), GRAPH)
    inherited = [r for r in found.collect() if r.kind == "inherited"]
    assert [(r.table_name, r.record_id, r.period, r.depth) for r in inherited] == [("child", 8, "2024-09", 1)]
    report = {(r.table_name, r.period, r.kind, r.reason): r.n for r in orphan_report(found).collect()}
    assert report["child", "2024-05", "direct", "missing"] == 1 and sum(report.values()) == len(WANT) + 1


def test_cycles_end(spark):
    t = spark.createDataFrame([(1, 2, T1), (2, 3, T1), (3, 1, T1), (4, 9, T1), (5, 4, T1), (6, 5, T1)], "id bigint, ref bigint, at timestamp")
    found = orphans(spark, {"t": t}, (Reference("t", "ref", "id", "at", "t", "id", "at"),))
    assert sorted((r.record_id, r.depth) for r in found.collect()) == [(4, 0), (5, 1), (6, 2)]


def test_empty_tables(spark):
    assert orphans(spark, tables(spark, [], [], []), GRAPH).count() == 0
    full = example(spark)
    none = tables(spark, [], [], [])
    found = direct_orphans({"child": full["child"], "parent": none["parent"], "root": none["root"]}, GRAPH)
    assert {r.reason for r in found.collect()} == {"missing"}


def test_found_comes_from_the_cascade(spark, data, monkeypatch):
    from quillstone.operators import references
    from quillstone.plans import reference_queries

    asked, whole = [], references.orphans
    monkeypatch.setattr(references, "orphans", lambda *a: asked.append(1) or whole(*a))
    found = reference_queries.p4_found(spark, data)
    direct = direct_orphans(reference_queries._tables(spark, data))
    assert asked and found.columns == direct.columns and sorted(found.collect()) == sorted(direct.collect())


def test_three_levels_and_several_names_of_a_row(spark):
    """a <- b <- c <- d; rows of b are named by `id` in one reference and by `code` in the other, whose values overlap."""
    a = spark.createDataFrame([(1, T1)], "id bigint, at timestamp")
    b = spark.createDataFrame([(1, 2, 1, 1, T1), (2, 1, 9, 1, T1), (3, 4, 1, 8, T1)], "id bigint, code bigint, up bigint, other bigint, at timestamp")
    c = spark.createDataFrame([(10, 1, T1), (20, 2, T1), (30, 3, T1)], "id bigint, ref bigint, at timestamp")
    d = spark.createDataFrame([(100, 10, T1), (200, 20, T1), (300, 30, None)], "id bigint, ref bigint, at timestamp")
    graph = (Reference("b", "up", "id", "at", "a", "id", "at"), Reference("b", "other", "code", "at", "a", "id", "at"), Reference("c", "ref", "id", "at", "b", "id", "at"), Reference("d", "ref", "id", "at", "c", "id", "at"))
    found = {(r.table_name, r.record_id, r.reason, r.depth) for r in orphans(spark, {"a": a, "b": b, "c": c, "d": d}, graph).collect()}
    assert found == {("b", 2, "missing", 0), ("b", 4, "missing", 0), ("c", 20, "inherited", 1), ("c", 30, "inherited", 1), ("d", 200, "inherited", 2), ("d", 300, "inherited", 2)}
