from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.operators import chunking
from quillstone.sources import front_matter, html


def sentence(n):
    return "A" + " word" * (n - 2) + "."


def test_overlap_that_leaves_no_room_is_dropped():
    out = chunking.merged_sentences(sentence(400) + " " + sentence(200) + " " + sentence(400), 512, 64)
    assert [chunking.tokens(c) for c in out] == [400, 200, 400]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(6, 300), min_size=1, max_size=30))
def test_every_sentence_appears_and_chunks_are_bounded(sizes):
    text = " ".join(f"A{i}" + " w" * (n - 2) + "." for i, n in enumerate(sizes))
    out = chunking.merged_sentences(text, 100, 20, 120, 2, 1)
    assert all(chunking.tokens(c) <= 120 for c in out)
    assert all(any(f"A{i} " in c + " " or f"A{i}." in c for c in out) for i in range(len(sizes)))


def test_hard_split_is_strict():
    assert all(chunking.tokens(p) <= 5 for p in chunking.hard_split("a b c d e f g h-i-j-k-l-m-n", 5))


def test_headings_keep_text():
    text = "PRELIMINARY MATTERS\nOne.\n1. On the first point it is so\nTwo."
    assert "".join(b for _, b in chunking.headed_blocks(text)).replace("\n", "") == text.replace("\n", "")


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=300), st.integers(10, 50))
def test_recursive_pieces_are_bounded(text, most):
    parts = chunking.recursive(text, most, 3)
    assert all(len(p) <= most for p in parts)
    assert not text.strip() or parts


def test_cascade_and_windows(spark):
    law = "---\ntitle: Part 1\n---\nThe first rule applies to all of them. " * 3
    rows = [(1, law), (2, sentence(60) * 3), (3, None), (4, " "), (5, "x" * 9000)]
    df = spark.createDataFrame(rows, "doc_id bigint, content string")
    out = chunking.chunk(spark, df).collect()
    assert {r.doc_id: r.strategy for r in out} == {1: "dashed", 2: "semantic", 5: "recursive"}
    windows = df.where("doc_id = 5").select(chunking.windows(df.content).alias("w")).collect()[0].w
    assert [(w.start, len(w.text)) for w in windows] == [(0, 4000), (3800, 4000), (7600, 1400)]


def test_front_matter():
    meta, body = front_matter.split('-----\ntitle: A v B\nyear: 2006\ncitations: ["[2001] X 1"]\nurl: https://a.example/b\n-----\n\nBody')
    assert meta == '{"title": "A v B", "year": 2006, "citations": ["[2001] X 1"], "url": "https://a.example/b"}' and body == "Body"
    assert front_matter.split("no head") == ("{}", "no head") and front_matter.split(None) == (None, None)
    found = front_matter.sections("intro\n---\nTitle: One\n---\nfirst\n---\nsection: 2\n---\nsecond")
    assert [(h.get("title"), b) for h, b in found] == [(None, "intro"), ("One", "first"), (None, "second")]


def test_html():
    page = "<html><script>x()</script><nav>menu</nav><h2>A v B [2001] X 1</h2><hr><p>One &amp; two</p><style>p{}</style><p>three<br>four</p><hr>foot</html>"
    assert html.to_text(page) == "A v B [2001] X 1\nOne & two\nthree\nfour\nfoot"
    assert html.case_page(page) == ("A v B [2001] X 1", "One & two\nthree\nfour") and html.to_text(None) is None


def test_heading_lines():
    heads = ("IV. Costs", "1.2. Scope", "1. On the point", "s. 12 Duty", "Section 4A Duty", "MDCL", "PART 2", "DUTIES")
    assert all(chunking.HEADING.match(h) for h in heads) and not any(map(chunking.HEADING.match, ("On the point", "see section 4", "In 1999", "(a) x")))


def test_the_cascade_ends_in_windows(spark):
    text = "a b. " * 3  # too small a sentence for merging, and no chunk of its own
    assert chunking.pieces_of(" \n ") == ("empty", [])
    assert chunking.pieces_of("x" * 9000, "windows")[1][-1][2] == {"start_char": 7600, "end_char": 9000, "fallback": True}
    assert chunking.pieces_of(text)[0] in ("semantic", "recursive")
    df = spark.createDataFrame([(1, "y" * 5000)], "doc_id bigint, content string")
    assert [(r.chunk_index, len(r.text), r.strategy) for r in chunking.chunk(spark, df, "windows").collect()] == [(0, 4000, "windows"), (1, 1200, "windows")]


def test_headers_never_change_a_documents_own_keys(spark):
    law = "Preface text of the Act, which is long enough to stay.\n---\ntitle: Part 1\nyear: 1900\nregulation: R7\n---\nThe first rule applies to all of them. " * 2
    df = spark.createDataFrame([(1, law, '{"title": "The Act", "year": 1999}')], "doc_id bigint, content string, m string")
    found = [json.loads(r.chunk_metadata) for r in chunking.chunk(spark, df, metadata_col="m").collect()]
    assert all(m["title"] == "The Act" and m["year"] == 1999 and m["strategy"] == "dashed" for m in found)
    assert any(m.get("regulation") == "R7" and m["section_title"] == "Part 1" for m in found) and found[0]["section_title"] is None
    with pytest.raises(ValueError):
        chunking.chunk(spark, df, "unknown")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab. ?", max_size=60), max_size=12))
def test_paragraphs_are_bounded_and_keep_all_letters(parts):
    text = "\n\n".join(parts)
    out = chunking.paragraphs(text, 40, 0)
    assert all(len(c) <= 40 for c in out)
    assert "".join("".join(out).split()) == "".join(text.split())


def test_chunks_by_kind():
    law = "-----\nsection: 4\ntitle: Duty\n-----\n" + "The duty applies. " * 20 + "\n-----\nsection: 5\ntitle: Short\n-----\ntoo short"
    assert [h for h, _ in chunking.by_kind("Legislation", law)] == ["Duty"]
    article = "\n".join(["I. Introduction", "It begins. " * 20, "2. Part", "It goes on. " * 20])
    assert [h for h, _ in chunking.by_kind("journal", article)] == ["I. Introduction", "2. Part"]
    long = "1. Part\n" + "It goes on and on. " * 200
    assert all(h.startswith("para_") and len(t) <= 1500 for h, t in chunking.by_kind("journal", long)) and len(chunking.by_kind("journal", long)) == 3
    assert [h for h, _ in chunking.by_kind("case", "A ruling. " * 20)] == ["para_0"] and chunking.by_kind("case", "A short ruling of sixty characters, which is kept in the end.")[0][0] == ""
    assert chunking.by_kind("txt", "x") == [] and chunking.by_kind("", "") == []
