from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from quillstone.functions import metadata as M
from quillstone.functions import text as X
from quillstone.functions import vectors as V
from quillstone.functions.stem import stem


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<float>' if isinstance(v, list) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).collect()[0].x


def test_trigram_similarity(spark):
    assert len(X.query_trigrams("word one")) == 9 and len(X.query_trigrams("one two")) == 8
    assert one(spark, X.similarity(F.col("t"), "one two"), t="word one") == pytest.approx(4 / 13)
    assert one(spark, X.similarity(F.col("t"), "a"), t="") == 0.0
    assert one(spark, X.similarity(F.col("t"), ""), t="") == 0.0
    assert one(spark, X.similarity(F.col("t"), "a"), t=None) is None
    assert one(spark, F.levenshtein(F.lit("kitten"), F.lit("sitting"))) == 3


def test_containment_is_literal_by_default(spark):
    assert one(spark, X.contains(F.col("t"), "50%_"), t="about 50%_ more") and not one(spark, X.contains(F.col("t"), "5%_"), t="about 50 more")
    assert one(spark, X.contains(F.col("t"), "5%m", escape=False), t="about 50 more")


def test_stable_id(spark):
    assert one(spark, M.stable_id(F.lit("doc:abc"))) == 432399300371760109


@pytest.mark.parametrize("raw,strict,loose", [("2021-03-29 00:00:00", "2021-03-29", "2021-03-29"), ("29-03-2021", None, "2021-03-29"), ("2021", None, "2021-01-01"), ("2021-13-01", None, None), ("", None, None), ("n.d.", None, None), (None, None, None)])
def test_dates(spark, raw, strict, loose):
    day = lambda s: s and datetime.date.fromisoformat(s)
    assert one(spark, M.md_date(F.col("t")), t=raw) == day(strict)
    assert one(spark, M.parse_date(F.col("t")), t=raw) == day(loose)


@pytest.mark.parametrize("raw,year", [("2006", 2006), ("2006a", None), ("", None), ("1234567", None), (None, None)])
def test_year(spark, raw, year):
    assert one(spark, M.md_year(F.col("t")), t=raw) == year


def test_keys_and_metadata(spark):
    assert one(spark, M.sanitise_key(F.col("t")), t="__1 a..b__c!") == "k_1_a_b_c"
    m = one(spark, M.sanitise(F.col("t")), t='{"type": "case", "year": "c. 2004", "secret": "x", "title": "' + "y" * 600 + '"}')
    assert m["year"] == "2004" and "secret" not in m and len(m["title"]) == 600
    assert one(spark, M.sanitise(F.col("t")), t=None) is None
    kept = lambda t: one(spark, M.sanitise(F.col("t")), t=t)
    assert kept('{"year": "120345", "judge": "X", "bench": null, "countries": ["a"]}') == {"judge": "X", "bench": None}
    assert kept('{"year": "from 1899 on", ".Section.": "1", "TITLE": "T", "act": {"a": 1}}') == {"year": "1899", "Section": "1", "TITLE": "T", "act": '{"a":1}'}
    assert kept('{"ti.tle": 1, "title": "a", "title.": "b"}') == {"title": "b"} and kept("[1, 2]") == {"raw": "[1, 2]"} and kept("{}") is None
    assert len(kept('{"source": ["' + "y" * 600 + '"]}')["source"]) == 500
    key = lambda t: one(spark, M.sanitise_key(F.col("t")), t=t)
    assert key("-a.b-") == "a_b" and key("..") is None and key(" a//b ") == "a_b"


def test_citations_under_any_key(spark):
    of = lambda t: one(spark, M.citations(F.col("t")), t=t)
    assert of('{"citation": "[2001] A 1", "citations": [" [1999] B 2 ", "[2001] A 1", ""], "md_citation": "C"}') == ["[1999] B 2", "[2001] A 1", "C"]
    assert of("{}") == [] and of('{"citations": "one"}') == ["one"] and of(None) == []


def test_names_and_headings(spark):
    assert one(spark, M.parties(F.col("t")), t="re Smith & Co v Jones, [2001]") == "Smith & Co v Jones"
    assert one(spark, M.parties(F.col("t")), t="smith v Jones") is None and one(spark, M.parties(F.col("t")), t="Re Smith") is None
    h = one(spark, M.case_heading(F.col("t")), t="A v B; C &amp; D [2001] ABC 12; (1999) 3 DEF 4 (4 June 1998)")
    assert (h.names, h.citations, h.date) == (["A v B", "C & D"], ["[2001] ABC 12", "ABC 12", "(1999) 3 DEF 4", "3 DEF 4"], "1998-06-04 00:00:00")
    assert one(spark, M.case_heading(F.col("t")), t="A v B [2001] ABC 12 (4 Jun 1998)").date == "4 Jun 1998" and one(spark, M.case_heading(F.col("t")), t="A v B") is None
    assert one(spark, M.authors(F.col("t")), t="A; B,, C ") == ["A", "B", "C"]


def test_paths_and_buckets(spark):
    p = one(spark, M.path_parts(F.col("t")), t="/corpus/cases/2006/file10.TXT")
    assert (p.folders, p.file, p.year, p.extension) == (["corpus", "cases"], "file10.TXT", 2006, "txt")
    assert one(spark, M.bucket(F.lit("hca"), F.lit("journal"), F.lit(""))) == "hca"
    assert one(spark, M.bucket(F.lit(None), F.lit(None), F.lit("/x/Treaties/1"))) == "cases" and one(spark, M.path_type(F.lit("/x/Treaties/1"))) == "treaties"
    assert one(spark, M.path_type(F.lit("/x/entreaty/1"))) == "cases" and one(spark, M.bucket(F.lit("NSWSC"), F.lit(None), F.lit("/a/HCA/1"))) == "hca"
    for t, want in (("article", "journals"), ("act", "legislation"), ("regulation", "legislation"), (" Case ", "cases"), ("x", "cases")):
        assert one(spark, M.bucket(F.lit("NSWSC"), F.lit(t), F.lit(""))) == want
    mixed = spark.createDataFrame([(1, 1, "NSWSC", "case", None), (2, 1, "hca", "journal", None), (3, 2, None, "memo", "/HCA/x"), (4, 3, None, "act", None), (5, 3, None, "case", None), (6, None, "HCA", "case", None)], "id int, doc_id int, md_database string, md_type string, md_url string")
    assert {r.doc_id: r.bucket for r in M.buckets(mixed, "doc_id").collect()} == {1: "hca", 2: "hca", 3: "legislation"}


def test_types_by_text(spark):
    kind = lambda t, known=None: one(spark, M.doc_type(F.lit(known).cast("string"), F.col("t")), t=t)
    assert kind("We met at the intersection of roads.") == "txt" and kind("See s.12 of it") == "legislation" and kind("See s. 12") == "legislation"
    assert kind("as section 4 says") == "legislation" and kind("Smith v Jones") == "case" and kind("the appellant") == "case" and kind("disappellant") == "txt"
    assert kind("intro\n1.Scope") == "journal" and kind("x" * 1000 + " v ") == "txt" and kind("a v b", "Journal") == "journal" and kind("a v b", "treaty") == "case"


def test_addresses(spark):
    assert one(spark, M.canonical_url(F.col("t"), "/au/cases/cth/HCA", "https://x"), t="2001\\7.txt") == "https://x/au/cases/cth/HCA/2001/7.html"
    assert tuple(one(spark, M.place_of(F.col("t")), t="/nz/cases/NZSC/x/1.html")) == ("NZSC", "x") and tuple(one(spark, M.place_of(F.col("t")), t="/au/legis/a/b")) == ("", "")


def test_natural_order(spark):
    df = spark.createDataFrame([("file10",), ("file2",), ("File1",), ("file002",)], "f string")
    assert [r.f for r in df.orderBy(X.natural_key(F.col("f")), "f").collect()] == ["File1", "file002", "file2", "file10"]


def test_vectors(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, V.cosine_distance(a, b), a=[1.0, 0.0], b=[0.0, 2.0]) == pytest.approx(1.0)
    assert one(spark, V.cosine(a, b), a=[0.0, 0.0], b=[0.0, 2.0]) is None
    assert one(spark, V.parse(F.col("t")), t="[0.5,1]") == [0.5, 1.0]
    assert not one(spark, V.usable(a, 2), a=[float("nan"), 1.0])


def test_highlight(spark):
    assert "<b>Appeal</b>" in one(spark, X.highlight(F.col("t"), ["appeal"]), t="so the Appeal fails")
    assert one(spark, X.highlight(F.col("t"), ["x"]), t="none") is None


@pytest.mark.parametrize("word,want", [("appealed", "appeal"), ("dismissal", "dismiss"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"), ("ponies", "poni"), ("ties", "tie"), ("generously", "generous"), ("skies", "sky"), ("by", "by"), ("agreed", "agre")])
def test_stems(word, want):
    assert stem(word) == want


def test_steps(spark):
    text = "Intro\nStep 1 - Facts: the dam\nbroke\nStep 2 - Law: s 5\nFinal Conclusion: liable"
    assert [(s.step, s.label, s.body) for s in one(spark, X.steps(F.col("t")), t=text)] == [(1, "Facts", "the dam\nbroke"), (2, "Law", "s 5")]
    assert one(spark, X.steps(F.col("t")), t="none") == []


def test_coercions(spark):
    assert one(spark, M.as_int(F.col("t")), t=" 12 ") == 12 and one(spark, M.as_int(F.col("t")), t="x") is None
    assert one(spark, M.truthy(F.col("t")), t=" Yes ") and not one(spark, M.truthy(F.col("t")), t="0") and one(spark, M.truthy(F.col("t")), t=None) is False
