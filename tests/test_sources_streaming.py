from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillstone.sources import files, front_matter, logs, sinks
from quillstone.streaming import ingest


def test_files(spark, tmp_path):
    root = tmp_path / "corpus"
    for name, text in {"a/file10.txt": "x", "a/file2.TXT": "---\ntype: case\n---\nBody", "a/page.html": "<p>Hi</p>", "a/2004/old.txt": "old", "b/n.pdf": "no", "b/latin.txt": None}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes("caf\xe9".encode("latin-1") if text is None else text.encode())
    found = files.scan(spark, str(root))
    assert found.count() == 5
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.sample(found).collect()) == ["file2.TXT", "latin.txt"]
    parsed = {r.path.rsplit("/", 1)[1]: r for r in files.parsed(spark, str(root)).collect()}
    assert parsed["file2.TXT"].format == "case" and parsed["file2.TXT"].body == "Body" and parsed["page.html"].body == "Hi" and parsed["page.html"].format == "html"
    assert parsed["latin.txt"].body == "café"
    part = tmp_path / "part.txt"
    part.write_text("one\n\n two \n")
    assert [r.path for r in files.listed(spark, str(part)).collect()] == ["one", "two"]
    assert files.pending(found, found.where(F.col("path").endswith("old.txt"))).count() == 4


def test_logs(spark, tmp_path):
    (tmp_path / "m.ndjson").write_text(json.dumps({"session": "s", "status": "ok", "chunks": 3}) + "\nnot json\n" + json.dumps({"session": "t"}) + "\n")
    assert logs.ndjson(spark, str(tmp_path / "m.ndjson")).where("session is not null").count() == 2
    (tmp_path / "h.log").write_text("# session=abc\n#files_ok = 3\n# files_ok=4\nrow\n")
    assert logs.headers(spark, str(tmp_path / "h.log")).collect()[0]["values"] == {"session": "abc", "files_ok": "4"}
    (tmp_path / "ok.tsv").write_text("# c\n/a/b.txt\tchunks=3\ttext_len=9\n/c\n")
    rows = {r.path: r["values"] for r in logs.succeeded(spark, str(tmp_path / "ok.tsv")).collect()}
    assert rows == {"/a/b.txt": {"chunks": "3", "text_len": "9"}, "/c": {}}


def test_ingest_resumes_without_repeats(spark, tmp_path):
    source, to, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    text = "The appeal is allowed and the orders below are set aside. " * 20
    docs = spark.createDataFrame([(i, "s", None if i == 3 else text + str(i)) for i in range(4)], ingest.DOCUMENTS)
    docs.coalesce(1).write.parquet(source)
    ingest.ingest(spark, source, to, at, files_per_batch=1).awaitTermination()
    first = ingest.merged(spark, to).count()
    assert first > 0
    ingest.ingest(spark, source, to, at).awaitTermination()
    assert ingest.merged(spark, to).count() == first
    docs.coalesce(1).write.mode("append").parquet(source)
    ingest.ingest(spark, source, to, at).awaitTermination()
    assert spark.read.parquet(to).count() == 2 * first and ingest.merged(spark, to).count() == first


def test_listed_files(spark, tmp_path):
    for name in ("a.txt", "b.html", "c.txt"):
        (tmp_path / name).write_text("x")
    (tmp_path / "part.lst").write_text(f"{tmp_path}/a.txt\n\n  file://{tmp_path}/b.html \n{tmp_path}/none.txt\n")
    found = files.listed_files(spark, f"{tmp_path}/part.lst", str(tmp_path)).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in found) == ["a.txt", "b.html"]


def test_case_pages(spark):
    page = "<html><p>top</p><hr><h2>A v B; C v D [2001] HCA 7; (2001) 3 DEF 4 (4 June 2001)</h2><small>note</small><p>Held &amp; done.</p><hr>foot</html>"
    rows = [(1, page, "2001/7.txt"), (2, "<p>Neutral Citation has changed</p>", "x"), (3, "<p>High Court of Australia decisions beginning with A</p>", "x"), (4, "<h2>No form</h2><p>t</p>", "x"), (5, None, "x")]
    out = {r.id: r for r in files.case_pages(spark.createDataFrame(rows, "id int, html string, path string"), "html", "path", "/au/cases/cth/HCA", "https://x").collect()}
    assert {i: r.status for i, r in out.items()} == {1: "case", 2: "reference", 3: "list", 4: "plain", 5: None}
    meta = json.loads(out[1].meta)
    assert meta["titles"] == ["A v B", "C v D"] and meta["citations"] == ["[2001] HCA 7", "HCA 7", "(2001) 3 DEF 4", "3 DEF 4"] and meta["date"] == "2001-06-04 00:00:00"
    assert (meta["url"], meta["jurisdiction"], meta["court"]) == ("https://x/au/cases/cth/HCA/2001/7.html", "cth", "HCA")
    back, body = front_matter.split(out[1].document)
    assert json.loads(back)["titles"] == ["A v B", "C v D"] and "Held & done." in body and "note" not in body and "foot" not in body
    assert out[2].document.startswith("Neutral Citation has changed: This file") and out[4].document == "No form\nt"


def test_batches_by_bytes(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, "s", "A sentence of a few words. " * 20)], ingest.DOCUMENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ingest.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", bytes_per_batch=1000).awaitTermination()
    assert ingest.merged(spark, f"{tmp_path}/out").select("doc_id").distinct().count() == 3


def test_database_tables(spark):
    url = "jdbc:derby:memory:quillstone;create=true"
    df = spark.range(100).select(F.col("id").alias("ID"), (F.col("id") * 2).alias("V"))
    df.write.jdbc(url, "T", mode="overwrite", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    back = sinks.read_table(spark, url, "T", "ID", 0, 100, 4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert back.rdd.getNumPartitions() == 4 and back.agg(F.sum("V")).first()[0] == 9900


def test_loading_both_tables_again_changes_nothing(spark, tmp_path):
    text = "The appeal is allowed and the orders below are set aside. " * 60
    df = spark.createDataFrame([(1, "s", text, '{"type": "case", "title": "T"}'), (2, "t", None, None), (3, "t", " ", None), (4, "u", "A single short sentence of eight words here.", "not json")], ingest.DOCUMENTS + ", m string")
    seen = []
    for _ in range(2):
        ingest.load(spark, df.where("doc_id <> 4"), f"{tmp_path}/t", 7, metadata_col="m")
        docs, vectors = (spark.read.parquet(f"{tmp_path}/t/{n}") for n in ("documents", "embeddings"))
        seen.append((sorted(map(str, docs.collect())), sorted(map(str, vectors.collect()))))
    assert seen[0] == seen[1] and docs.count() == vectors.count() > 1
    assert vectors.join(docs.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti").count() == 0
    ingest.load(spark, df.where("doc_id = 4"), f"{tmp_path}/u", metadata_col="m")
    assert [json.loads(r.chunk_metadata)["raw"] for r in spark.read.parquet(f"{tmp_path}/u/embeddings").collect()] == ["not json"]
    assert {r.format for r in docs.collect()} == {"case"} and all(len(r.vector) == 64 and json.loads(r.chunk_metadata)["title"] == "T" for r in vectors.collect())
