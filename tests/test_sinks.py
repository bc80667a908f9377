from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillstone.functions import metadata as M
from quillstone.operators import embedding, partitioning
from quillstone.sources import logs, sinks


def test_routed_writes_replace_their_bucket_only(spark, tmp_path):
    to = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "id int, db string, t string")
    bucket = M.bucket(F.col("db"), F.col("t"), F.lit(""))
    sinks.write_routed(rows((1, None, "case"), (2, "HCA", "case"), (3, None, "treaty")), to, bucket)
    sinks.write_routed(rows((4, None, "case")), to, bucket)
    assert {(r.id, r.bucket) for r in spark.read.parquet(to).collect()} == {(4, "cases"), (2, "hca"), (3, "treaties")}


def test_upserts_can_be_repeated(spark, tmp_path):
    to = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "k int, v string")
    sinks.write_upserted(spark, rows((1, "a"), (1, "b"), (2, "c")), to, ["k"], [F.desc("v")], 1)
    for _ in range(2):
        at = sinks.write_upserted(spark, rows((2, "d"), (3, "e")), to, ["k"], [F.desc("v")], 2)
    assert sorted(map(tuple, spark.read.parquet(at).collect())) == [(1, "b"), (2, "d"), (3, "e")]


def test_logs_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("/a", 3, None), ("/b", 1, 2.5)], "path string, chunks int, parse_ms double")
    sinks.write_success_list(df, str(tmp_path / "ok"), ["chunks", "parse_ms"])
    assert {r.path: r["values"] for r in logs.succeeded(spark, str(tmp_path / "ok")).collect()} == {"/a": {"chunks": "3"}, "/b": {"chunks": "1", "parse_ms": "2.5"}}
    sinks.write_ndjson(df, str(tmp_path / "n"))
    assert logs.ndjson(spark, str(tmp_path / "n")).where("chunks = 3").count() == 1


def test_manifest_and_sql(spark):
    df = spark.createDataFrame([(f"f{i}",) for i in range(7)], "path string")
    m = sinks.manifest(partitioning.even(df, 3, ["path"])).collect()[0]
    assert (m.total_files, m.assigned_total, m.unique_assigned, [s["count"] for s in m.shards]) == (7, 7, 7, [3, 2, 2])
    assert sinks.run_sql(spark, "select count(*) as n from {t} where path > :p", {"p": "f3"}, t=df).collect()[0].n == 3


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a dam and a wharf"), (2, None), (3, ""), (4, "a wharf and a dam!")], "id int, t string")
    out = {r.id: r.vector for r in embedding.embed(spark, df, "t", 32).collect()}
    assert out[2] is None and np.allclose(out[1], out[4]) and not any(out[3]) and any(out[1])


def test_run_logs(spark, tmp_path):
    rows = [("a", "ok", None, None, 3, 1.5), ("b", "error", "parse", "Timeout: x", None, None), ("b", "error", "parse", "Timeout: y", None, None), ("c", "empty", None, None, None, None)]
    df = spark.createDataFrame(rows, "path string, status string, stage string, error string, chunks bigint, duration_ms double")
    sinks.write_run_logs(df, f"{tmp_path}/run")
    assert [r.value for r in spark.read.text(f"{tmp_path}/run/success").collect()] == ["a\tchunks=3\tduration_ms=1.5"]
    assert [r.value for r in spark.read.text(f"{tmp_path}/run/failed").collect()] == ["b"] and spark.read.json(f"{tmp_path}/run/errors").count() == 2
    assert spark.read.json(f"{tmp_path}/run/summary").collect()[0].asDict() == {"files_ok": 1, "files_failed": 2, "files_other": 1, "chunks": 3}
