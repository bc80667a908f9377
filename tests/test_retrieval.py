from __future__ import annotations

import datetime
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillstone.functions import text as X
from quillstone.functions import vectors as V
from quillstone.operators import etl, fusion, ledger, lexical, partitioning, postings, reports, vector
from quillstone.operators.predicates import boolean
from quillstone.plans import capabilities


def scores(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "id int, v double")


def column(df, c):
    return [r.x for r in df.select("id", c.alias("x")).orderBy("id").collect()]


def test_percentile_scaling(spark):
    got = column(scores(spark, [1, 2, 10]), fusion.percentile_scaled(F.col("v")))
    lo, hi = 1.1, 9.2
    assert got == pytest.approx([0.0, (2 - lo) / (hi - lo), 1.0])
    assert column(scores(spark, [3, 5]), fusion.percentile_scaled(F.col("v"))) == [0.0, 1.0]
    assert column(scores(spark, [2, 2, 2]), fusion.percentile_scaled(F.col("v"))) == [1.0] * 3
    assert column(scores(spark, [0, 0, 0]), fusion.percentile_scaled(F.col("v"))) == [0.0] * 3


def test_min_max(spark):
    assert column(scores(spark, [1, None, 3]), fusion.min_max(F.col("v"), inverse=True)) == [1.0, None, 0.0]
    assert column(scores(spark, [4, 4]), fusion.min_max(F.col("v"))) == [1.0, 1.0]


def test_reciprocal_ranks(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "k string, l int")
    b = spark.createDataFrame([("b", 1), ("c", 2)], "k string, r int")
    got = {r.k: r.score for r in fusion.reciprocal_ranks([(a, "l"), (b, "r")], ["k"]).collect()}
    assert got == pytest.approx({"a": 1 / 61, "b": 1 / 62 + 1 / 61, "c": 1 / 62})


def test_unions(spark):
    a, b = (spark.createDataFrame(x, "k string, score double") for x in ([("a", 1.0), ("b", 0.5)], [("b", 1.0), ("c", 0.2)]))
    assert {r.k: r.score for r in fusion.union_mean(a, b, ["k"]).collect()} == {"a": 1.0, "b": 0.75, "c": 0.2}
    assert {r.k: r.score for r in fusion.union_first([a, b], ["k"], [F.desc("score")]).collect()} == {"a": 1.0, "b": 0.5, "c": 0.2}


@pytest.mark.parametrize("query,want", [("wharf AND dam", {1}), ("wharf dam", {1}), ("wharf OR levy", {1, 2, 3}), ("wharf NOT dam", {2}), ('"big wharf"', {2}), ("(wharf OR levy) AND NOT dam", {2, 3}), ("NOT wharf", {3, 4})])
def test_boolean_queries(spark, query, want):
    df = spark.createDataFrame([(1, "The wharf, a dam"), (2, "Big wharf!"), (3, "levy"), (4, "")], "id int, t string")
    assert {r.id for r in df.where(lexical.Boolean(query).condition(X.words(F.col("t")))).collect()} == want


@pytest.mark.parametrize("query", ["", "(a", "a AND", "a )", "OR a"])
def test_broken_boolean_queries(query):
    with pytest.raises(ValueError):
        lexical.Boolean(query)


def test_phrases(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, "one x two"), (3, "one x y two three"), (4, None)], "id int, t string")
    hits = lambda q, slop: {r.id for r in df.where(lexical.phrase(X.words(F.col("t")), q, slop)).collect()}
    assert hits("one two", 0) == {1} and hits("one two", 1) == {1, 2} and hits("one two", 2) == {1, 2, 3}
    assert hits("one two three", 1) == {1} and hits("one two three", 2) == {1, 3} and hits("", 0) == set()


def test_lexical_edges(spark):
    df = spark.createDataFrame([(1, "appeals dismissed", "t"), (2, None, None), (3, "appeal", "x")], "id int, content string, title string")
    assert lexical.bm25(spark, df, {"content": 1.0}, "", ["id"]).count() == 0
    assert lexical.bm25(spark, df.limit(0), {"content": 1.0}, "appeal", ["id"]).count() == 0
    assert [r.id for r in lexical.full_text(spark, df, "content", "dismissing the appeal", ["id"]).collect()] == [1]
    assert lexical.full_text(spark, df, "content", "the of", ["id"]).count() == 0


@pytest.mark.parametrize("query,kind", [("[2001] ABC 12", "citation"), ("see 175 CLR 1", "citation"), ("Smith v Jones", "case_name"), ("Smith vs. The Crown", "case_name"), ("v for value", "keyword"), ("Wharf Levy Act 1999", "legislation"), ("section 4", "legislation"), ("duty under s 12", "legislation"), ("dam AND wharf", "boolean"), ("who owes the rent?", "question"), ("how long is a lease", "question"), ("one two three four five six seven", "keyword"), ("one two three four five six seven eight", "question"), ("dam", "keyword")])
def test_routes(query, kind):
    assert lexical.route(query) == kind


def test_boolean_predicates(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, None, 2)], "id int, s string, n int")
    ids = lambda **k: [r.id for r in df.where(boolean(**k)).orderBy("id").collect()]
    assert ids(must_not=[F.col("s") == "a"]) == [2, 3] and ids(should=[F.col("n") == 1, F.col("n") == 2]) == [2, 3]
    assert ids(must=[F.col("s") == "b"], should=[F.col("n") == 5]) == [2] and ids() == [1, 2, 3]


def test_partitioning(spark):
    df = spark.createDataFrame([(f"f{i}", s) for i, s in enumerate([5, 4, 3, 2, 1])], "f string, s int")
    assert [r.s for r in partitioning.zigzag(df, "s", "f").orderBy("position").collect()] == [5, 1, 4, 2, 3]
    assert partitioning.largest_first([("a", 5), ("b", 4), ("c", 3), ("d", 2), ("e", 1)], 2) == [["a", "d", "e"], ["b", "c"]]
    assert partitioning.gini(df.withColumn("s", F.lit(3)), "s").collect()[0].gini == pytest.approx(0)
    paths = df.select(F.col("f").alias("path"))
    assert partitioning.coverage(paths, paths).collect()[0].complete
    bad = partitioning.coverage(paths, paths.where("path <> 'f1'").unionByName(paths.where("path = 'f2'"))).collect()[0]
    assert (bad.missing, bad.repeated, bad.complete) == (1, 1, False)


def test_tracing_takes_the_oldest_of_all(spark):
    # 30 documents carry the citation, 5 quote it only; the later the doc_id, the older; three years are unknown
    quoted = lambda i: "as held in [2010] ABC 1, so" if i > 30 else "nothing"
    docs = spark.createDataFrame([(i, quoted(i), "t") for i in range(1, 36)], "doc_id bigint, content string, title string")
    year = lambda i: None if i in (1, 2, 35) else 2020 - i
    chunks = spark.createDataFrame([(i, ["[2010] abc 1"] if i <= 30 else [], year(i)) for i in range(1, 36)], "doc_id bigint, md_citations array<string>, md_year int")
    got = [(r.doc_id, r.score) for r in capabilities.Corpus(spark, docs, chunks).tracing("[2010] ABC 1").collect()]
    assert got == [(i, 2020.0 - i) for i in range(34, 14, -1)]
    every = capabilities.Corpus(spark, docs, chunks.where("doc_id <> 34"), 40).tracing("[2010] ABC 1").collect()
    assert len(every) == 35 and [r.doc_id for r in every[-4:]] == [1, 2, 34, 35]


def test_zigzag_ranks_in_ranges(spark):
    rows = [(i, None if i % 97 == 0 else i * 7 % 50) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, s int").repartition(3)
    down = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    want = [down[n // 2] if n % 2 == 0 else down[-1 - n // 2] for n in range(len(down))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = partitioning.zigzag(df, "s", "k").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.k, r.s) for r in sorted(out, key=lambda r: r.position)] == want and sorted(r.position for r in out) == list(range(1, 1001))
    assert len({r.task for r in out}) > 1
    assert partitioning.zigzag(df.limit(0), "s", "k").count() == 0


def test_zigzag_covers_all_sources(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("n_chars is not null")
    out = entry.queries()["zigzag_order"](spark, data)
    assert out.join(docs, "doc_id").select("source").distinct().count() == docs.select("source").distinct().count() > 1
    assert out.count() == docs.count()


def test_etl(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, etl.upsert(old, new, ["k"], [F.desc("v")]).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    nulls = spark.createDataFrame([(None, "x"), (None, "x"), (1, "y")], "k int, v string")
    assert etl.new_rows(nulls, spark.createDataFrame([(None, "x")], "k int, v string"), ["k", "v"]).count() == 1
    first = etl.first_known(spark.createDataFrame([(1, 1, None, "p"), (1, 2, "m", None), (1, 3, "n", "q")], "k int, o int, a string, b string"), ["k"], ["a", "b"], "o").collect()[0]
    assert (first.a, first.b) == ("m", "p")


def test_nearest_rank_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 7)], "v double")
    assert reports.nearest_ranks(df, [], "v", {"x": 0.5}).collect()[0].x == 3.0  # rank round(2.5) = 2, from 0
    many = spark.createDataFrame([("a", 1.0)] * 5 + [("a", 2.0), ("a", None), ("b", 7.0)], "g string, v double")
    assert {r.g: (r.lo, r.hi) for r in reports.nearest_ranks(many, ["g"], "v", {"lo": 0.5, "hi": 1.0}).collect()} == {"a": (1.0, 2.0), "b": (7.0, 7.0)}


def test_html_pages_hold_whole_texts(spark, tmp_path):
    texts = ["a < b & c > d &amp; e\r\n" * 2000 + "end", " \u2003<p>x</p>\n", None]
    rows = [(i, "s", t, "case", "u", title, "en") for i, (t, title) in enumerate(zip(texts, [" T & <b> ", None, "only"]))]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string, format string, url string, title string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in entry.queries()["html_text"](spark, str(tmp_path)).collect()}
    assert got == {0: "T & <b>\n" + texts[0], 1: "<p>x</p>", 2: "only"}


def test_sections_hold_whole_texts(spark, tmp_path):
    text = "A statute. " * 500 + "last word"
    rows = [(8, "s", text, "legislation", "u", "Wharf Schedule", "en")]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string, format string, url string, title string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["etl_sections"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(8, "1", "schedule", text)]


def test_knn_score_covers_all_types(spark, data):
    chunks = spark.read.parquet(f"{data}/chunk_embeddings.parquet")
    types = entry.queries()["knn_score"](spark, data).join(chunks, "id").select("md_type").distinct().count()
    assert types == chunks.where("vector is not null").select("md_type").distinct().count() > 1


def test_full_text_counts_words_with_a_stem_of_their_own(spark):
    df = spark.createDataFrame([(1, "lying there"), (2, "the lie"), (3, "dying"), (4, "dies"), (5, "tying"), (6, "none")], "id int, content string")
    hits = lambda q: sorted(r.id for r in lexical.full_text(spark, df, "content", q, ["id"]).collect())
    assert hits("lie") == [1, 2] and hits("dying") == [3, 4] and hits("tie") == [5] and hits("lies dying") == []


def test_entities_of_a_query():
    assert lexical.entities("levy cases in 1993 NSW HCVR", ["HCVR"]) == {"subjurisdiction": "nsw", "database": "HCVR", "year": 1993}
    assert lexical.entities("[1993] ABC 1") == {} and lexical.without_year("Wharf Levy Act in 1993") == "Wharf Levy Act"


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


@pytest.fixture(scope="module")
def index(spark):
    texts = [(1, "The wharf, a dam. A wharf!", "Wharf"), (2, "Big wharf and dams; appealed", None), (3, "levy the the appeals", "Dam"), (4, "", "levy"), (5, None, None), (6, "dam wharf dam x y wharf", "t"), (None, "wharf", "x")]
    df = spark.createDataFrame(texts, "id int, content string, title string")
    return postings.Postings.build(spark, df, "id", ["content", "title"], buckets=3), texts


def keys(df):
    return {r.key for r in df.collect()}


def test_postings_hold_lengths_and_places(spark, index):
    p, texts = index
    assert p.n == 6 and p.average["content"] == pytest.approx(sum(len(words_of(c)) for i, c, _ in texts if i) / 6)
    rows = {(r.key, r.word): r.positions for r in p.rows(["wharf", "dam"], fields=["content"]).collect()}
    assert rows[1, "wharf"] == [2, 6] and rows[6, "dam"] == [1, 3] and (4, "wharf") not in rows and p.rows(stems=["dam"]).where("word = 'dams'").count() == 1


def test_searches_of_postings(spark, index):
    p, _ = index
    assert keys(p.bm25({"content": 1.0}, "wharf levy")) == {1, 2, 3, 6} and keys(p.bm25({"content": 1.0, "title": 2.0}, "dam wharf", "and")) == {1, 6}
    assert keys(p.full_text("content", "the dams")) == {1, 2, 6} and keys(p.full_text("content", "appealing dam")) == {2} and keys(p.full_text("content", "the")) == set()
    assert keys(p.boolean("content", "wharf AND NOT dam")) == {2} and keys(p.boolean("content", "NOT wharf")) == {3, 4, 5} and keys(p.boolean("content", '"dam wharf" OR levy')) == {3, 6}
    assert keys(p.phrase("content", "the the")) == {3} and keys(p.phrase("content", "dam wharf")) == {6} and keys(p.phrase("content", "wharf dam", 1)) == {1, 6} and keys(p.phrase("content", "dam wharf wharf", 3)) == {6}
    assert keys(p.bm25({"content": 1.0}, "")) == keys(p.phrase("content", "")) == set()


def test_fields_without_places(spark):
    df = spark.createDataFrame([(1, "the dams of a wharf", "a wharf dam"), (2, "dam", "wharfs")], "id int, content string, title string")
    p = postings.Postings.build(spark, df, "id", ["content", "title"], places=["title"])
    assert keys(p.match("content", "dam wharf")) == {1} and keys(p.match("title", "the wharfs")) == {1, 2} and keys(p.match("title", "the")) == set()
    assert p.rows(["dam"], fields=["content"]).where("positions is null and tf = 1").count() == 1 and keys(p.phrase("title", "wharf dam")) == {1}


def test_bm25_against_the_formula(spark, index):
    p, texts = index
    docs = {i: words_of(c) for i, c, _ in texts if i}
    mean = sum(map(len, docs.values())) / 6
    want = {}
    for i, w in docs.items():
        for q in ("wharf", "dam"):
            df = sum(q in d for d in docs.values())
            if q in w:
                want[i] = want.get(i, 0) + math.log(1 + (6 - df + 0.5) / (df + 0.5)) * w.count(q) * 2.2 / (w.count(q) + 1.2 * (0.25 + 0.75 * len(w) / mean))
    assert {r.key: r.score for r in p.bm25({"content": 1.0}, "wharf dam").collect()} == pytest.approx(want)


def test_rank_of_near_stems(spark, index):
    p, _ = index
    rank = {r.key: r.rank for r in p.full_text("content", "wharf dam").collect()}
    near = lambda d: 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
    assert rank[2] == pytest.approx(1 - (1 - near(2))) and rank[1] == pytest.approx(1 - (1 - near(2)) * (1 - near(2)))
    one = {r.key: r.rank for r in p.full_text("content", "wharf").collect()}
    assert one[1] == pytest.approx((0.1 + 0.1 / 4) / 1.64493406685)


def test_queries_of_the_index_read_no_texts(spark, data):
    for name in ("fts_match", "bm25_ranked", "dsl_boolean", "phrase_slop"):
        plan = entry.queries()[name](spark, data)._jdf.queryExecution().toString()
        assert "documents.parquet" not in plan and "PartitionFilters: [" in plan and "bucket#" in plan


def test_vector_index_recall(spark):
    """Fifty vectors of the larger tables ask for their twenty nearest."""
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/chunk_embeddings.parquet").select("id", "vector")
    rows = rows.where(V.usable(F.col("vector"), 64)).cache()
    index = vector.VectorIndex.build(spark, rows, "id", "vector", 64)
    t = rows.toPandas()
    x = np.stack(t["vector"].to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = t["id"].to_numpy()
    hits, lists = 0, (x @ index.centroids.T).argmax(1)
    for q in range(0, len(ids), len(ids) // 50)[:50]:
        s = x @ x[q]
        want = set(ids[np.lexsort((ids, -s))[:20]])
        near = set(np.argsort(-(index.centroids @ x[q]), kind="stable")[: max(16, len(index.centroids) // 4)])
        probed = s.copy()
        probed[~np.isin(lists, list(near))] = -9
        hits += len(want & set(ids[np.lexsort((ids, -probed))[:20]]))
    assert hits >= 0.9 * 20 * 50
    got = {r.id for r in vector.nearest_two_phase(index, rows, x[0].tolist(), 20, ["id"]).collect()}
    assert len(got & set(ids[np.lexsort((ids, -(x @ x[0])))[:20]])) >= 18
    rows.unpersist()


def test_orders_without_one_task(spark):
    df = spark.range(1000).select(F.col("id").alias("path"), (F.col("id") * 7919 % 1000).alias("size"))
    place = {r.path: r.position for r in partitioning.positioned(df, [F.desc("size"), F.asc("path")]).collect()}
    assert sorted(place.values()) == list(range(1, 1001)) and place[0] == 1000
    for parts in (7, 1000, 1500):
        sizes = [r["n"] for r in partitioning.even(df, parts, [F.asc("path")]).groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()]
        assert sizes == [len(x) for x in np.array_split(np.arange(1000), parts) if len(x)]
    robin = {r.path: r.part for r in partitioning.round_robin(df, 3, [F.asc("path")]).collect()}
    assert all(robin[i] == i % 3 for i in range(1000))
    by = df.withColumn("g", F.when(F.col("path") < 900, "hot").otherwise(F.lit(None)))
    want = {}
    for g, sizes in (("hot", [i * 7919 % 1000 for i in range(900)]), (None, [i * 7919 % 1000 for i in range(900, 1000)])):
        s = sorted(sizes)
        want[g] = 2 * sum(i * v for i, v in enumerate(s, 1)) / (len(s) * sum(s)) - (len(s) + 1) / len(s)
    assert {r.g: r.gini for r in partitioning.gini(by, "size", ["g"]).collect()} == pytest.approx(want)


def test_balanced_shards(spark, monkeypatch):
    skewed = spark.createDataFrame([(f"f{i:03}", 10_000 if i == 7 else 1 + i % 3) for i in range(40)], "path string, size bigint")
    out = partitioning.balanced(skewed, 2).collect()
    assert len(out) == 40 and {r.by_size for r in out} == {True} and len({r.part for r in out}) == 8
    big = next(r.part for r in out if r.path == "f007")
    assert sum(r.part == big for r in out) == 1
    assert {r.by_size for r in partitioning.balanced(skewed.where("path <> 'f007'"), 2).collect()} == {False} and {r.by_size for r in partitioning.balanced(skewed, 1).collect()} == {False}
    monkeypatch.setattr(partitioning, "FILES", 10)
    laps = partitioning.balanced(skewed, 2).groupBy("part").count().collect()
    assert {r["count"] for r in laps} == {5} and len(laps) == 8
    assert partitioning.balanced(skewed.limit(0), 2).count() == 0


def test_parity(spark):
    a = spark.createDataFrame([("x", 1, "s", None), ("x", 2, None, None), ("y", 3, None, None)], "mode string, id int, source string, title string")
    b = spark.createDataFrame([("x", 1, None, "t"), ("z", 1, None, None)], "mode string, id int, source string, title string")
    got = {(r["mode"], r.field, r.side, r.count_left, r.count_right) for r in reports.parity(a, b).collect()}
    assert got == {("x", "source", "left", 2, 1), ("x", "title", "right", 2, 1), ("y", "id", "left", 1, 0), ("z", "id", "right", 0, 1)}


def test_related_shares_citations_and_sections(spark):
    docs = spark.createDataFrame([(1, "see section 4A and Sections 9", "t", "case"), (2, "under section 4a", "t", "case"), (3, "section 9", "t", "legislation"), (4, "none", "t", "case")], "doc_id bigint, content string, title string, format string")
    chunks = spark.createDataFrame([(1, ["[2001] A 1"]), (4, ["[2001] a 1", "x"]), (2, ["[2001] a 1"])], "doc_id bigint, md_citations array<string>")
    assert [(r.doc_id, r.score) for r in capabilities.Corpus(spark, docs, chunks).related(1).collect()] == [(2, 2.0), (4, 1.0)]


def test_loading_report_of_nothing(spark):
    r = spark.createDataFrame([], "type string, status string, chunks bigint, parse_ms double, chunk_ms double, embed_ms double, index_ms double, duration_ms double")
    row, histograms = reports.loading_report(r, spark.createDataFrame([(None, None), ("", "Retry: x")], "stage string, error string"))
    got = row.collect()[0]
    assert (got.files_total, got.files_per_min, got.avg_parse_ms, got.retry_like_errors) == (0, 0.0, 0.0, 1)
    assert {tuple(x) for x in histograms.collect()} == {("stage", "unknown", 2), ("type", "unknown", 1), ("type", "Retry", 1)}


def test_rollup_of_children(spark):
    s = spark.createDataFrame([("a", 4, 10, "active"), ("a-gpu0", 9, 9, "active"), ("b-gpu0", 3, 5, "complete"), ("b-gpu15", 2, None, None), ("c-gpu16", 1, 1, "x")], "session_name string, total_files int, processed_chunks int, status string")
    f = spark.createDataFrame([("b-gpu0", "f1", "complete"), ("b-gpu0", "f1", "complete"), ("b-gpu15", "f2", "complete"), ("b-gpu15", "f3", "error"), ("a", "f", "complete")], "session_name string, filepath string, status string")
    got = {r.session: (r.own, r.children, r.total_files, r.completed_files, r.processed_chunks, r.file_ratio) for r in reports.session_rollup(s, f).collect()}
    assert got["a"] == (True, 0, 4, 1, 10, 0.25) and got["b"] == (False, 2, 5, 2, 5, 0.4) and "c" not in got and "c-gpu16" in got


def test_ledger(spark, tmp_path):
    at = [datetime.datetime(2024, 1, d) for d in range(1, 5)]
    path = f"{tmp_path}/events"
    for e in (ledger.session_event(spark, "s", at[0], "active", total_files=3), ledger.session_event(spark, "s", at[2], last_file="f2", processed_chunks=9), ledger.session_event(spark, "s", at[1], last_file="f1", processed_chunks=4)):
        ledger.append(e, path)
    now = ledger.sessions(spark.read.schema(ledger.SESSION).parquet(path)).collect()[0]
    assert (now.status, now.last_file, now.processed_chunks, now.total_files, now.ended_at) == ("active", "f2", 9, 3, None)
    ledger.append(ledger.session_event(spark, "s", at[3], "complete"), path)
    assert ledger.sessions(spark.read.schema(ledger.SESSION).parquet(path)).collect()[0].ended_at is not None
    files = spark.createDataFrame([("s", "f1", at[0], "pending"), ("s", "f1", at[1], "complete"), ("s", "f2", None, None)], ledger.FILE)
    assert {(r.status, r.n) for r in ledger.file_counts(files).collect()} == {("complete", 1), ("pending", 1)}
    with pytest.raises(ValueError):
        ledger.session_event(spark, "s", at[0], nothing=1)
