from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from quillstone.llm import lines
from quillstone.llm.lines import Summary, keys_of
from quillstone.runtime import Scope

SCHEMA = "doc_id bigint, source string, text string, key string, n int, line_no int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def found(spark, rows):
    return {(r.doc_id, r.line_no) for r in lines.repeated_lines(spark, docs(spark, rows))[1].collect()}


def brute(rows):
    per, count = Counter(), Counter()
    for _, source, text in rows:
        if source is None or text is None:
            continue
        per[source] += 1
        count.update((source, k) for k in set(keys_of(text)) if k)
    return {(i, n) for i, s, t in rows if s is not None and t is not None for n, k in enumerate(keys_of(t)) if k and count[s, k] >= 5 and count[s, k] * 100 >= 15 * per[s]}


def test_keys():
    assert keys_of("Page 12 of 340\n--- 5 ---\n  ÉTÉ_x\t1.5 ") == ["page 0 of 0", "", "été x 0 0"]
    assert keys_of("") == [""]
    assert keys_of("a\r\nb") == ["a", "b"]


def test_lines_against_brute_force(spark):
    rows = [(i, "hot", f"Share this page\nbody {chr(97 + i % 26) * (1 + i // 26)}\nShare this page\nPage {i} of 9") for i in range(60)]
    rows += [(100 + i, "small", "Legal notice\nunique " + "abcdefg"[i]) for i in range(5)]
    rows += [(200 + i, "four", "Four times") for i in range(4)]
    rows += [(300, None, "Share this page"), (301, "hot", None), (302, "hot", ""), (303, "hot", "SHARE  this page!"), (304, "", "x")]
    rows += [(400 + i, "edge", "here\nq" if i < 6 else "zz" + chr(97 + i)) for i in range(40)]  # 6 of 40 is exactly 15 %
    assert found(spark, rows) == brute(rows)
    assert (303, 0) in brute(rows) and (400, 0) in brute(rows) and (200, 0) not in brute(rows)


def test_repeated_rows_count_and_empty_table(spark):
    rows = [(1, "a", "same line")] * 5
    assert len(lines.repeated_lines(spark, docs(spark, rows))[1].collect()) == 5
    assert found(spark, []) == set()


def test_clean(spark):
    rows = [(i, "s", f"Notice\nkept {'abcdef'[i]}\n\nnotice ") for i in range(6)] + [(9, None, "Notice"), (10, "s", None), (11, "t", "Notice\r\n")]
    df = docs(spark, rows)
    out = {r.doc_id: (r.text, r.removed) for r in lines.without_lines(spark, df, lines.repeated_lines(spark, df)[0]).collect()}
    assert out[0] == ("kept a\n", 2) and out[9] == ("Notice", 0) and out[10] == (None, None) and out[11] == ("Notice\r\n", 0)


def test_more_lines_than_one_round_holds(spark, monkeypatch):
    rows = [(6 * k + i, f"s{k}", f"Notice {'xyz'[k]}\nkept {'abcdef'[i]}") for i in range(6) for k in range(3)] + [(90, None, "Notice x")]
    want = found(spark, rows)
    monkeypatch.setattr(lines, "ROUND_LINES", 1)
    monkeypatch.setattr(lines, "TASK_COUNTERS", 3)
    assert found(spark, rows) == want == {(i, 0) for i in range(18)}
    df = docs(spark, rows)
    assert lines.without_lines(spark, df, lines.repeated_lines(spark, df)[0]).count() == len(rows)
    out = {r.doc_id: r.text for r in lines.without_lines(spark, df, lines.repeated_lines(spark, df)[0]).collect()}
    assert out[3] == "kept d"


def test_summary_never_loses_a_heavy_line(monkeypatch):
    monkeypatch.setattr(lines, "COUNTERS", 4)
    s = Summary(0.15)
    for i in range(400):
        s.add({f"u{i}-{j}" for j in range(30)} | ({"heavy"} if i % 6 == 0 else set()))
    heavy, extra, slack = s.heavy()
    assert all(e >= 1 for e in extra)
    assert "heavy" in heavy and s.missed < 0.15 * 400 and slack >= s.missed and s.missed > 0


def test_few_lines_of_many_small_sources_are_candidates(spark):
    """50,000 sources, most of one document: only what five documents share is looked for in the second pass."""
    text = F.concat(F.lit("A notice of "), "source", F.lit("\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.translate(F.col("doc_id").cast("string"), "0123456789", "abcdefghij"), F.lit(" own line "), F.element_at(F.array(*map(F.lit, "abcdefghijkl")), i))), "\n"))
    source = F.when(F.col("doc_id") < 49_000, F.col("doc_id")).otherwise(49_000 + F.col("doc_id") % 1000)
    df = spark.range(55_000).select(F.col("id").alias("doc_id")).withColumn("source", source.cast("string")).withColumn("text", text)
    with Scope(spark) as scope:
        candidates, totals = lines.candidate_lines(scope, lines._inputs(df, "doc_id", "source", "text"), 5, 0.15)
        assert totals.count() == 1000
        assert 1000 <= candidates.count() <= 13 * 55_000 / 100
    assert lines.repeated_lines(spark, df)[1].count() == 6000
