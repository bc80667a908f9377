from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import split
from quillstone.llm.split import StrongestCut, boundaries, pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. !\n", max_size=400), st.integers(12, 60), st.integers(0, 10))
def test_pieces_cover_the_text(text, most, overlap):
    parts = pieces(text, most, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    cut = 0
    for start, end, _ in parts:
        assert end - start <= most and start == max(0, cut - overlap) and (end > cut or not text)
        cut = end
    if len(text) > most:
        at = set(boundaries(text)[0].tolist())
        for _, end, forced in parts[:-1]:
            assert (end in at) != forced
        edges = [0, *sorted(at), len(text)]
        assert any(p[2] for p in parts) == any(b - a > most - overlap for a, b in zip(edges, edges[1:]))


def test_range_maximum_takes_the_rightmost_of_equals():
    import numpy as np

    strength = np.array([1, 3, 2, 3, 1, 3, 0], float)
    t = StrongestCut(strength)
    for lo in range(7):
        for hi in range(lo + 1, 8):
            assert t.query(lo, hi) == max(range(lo, hi), key=lambda i: (strength[i], i))


def test_strong_boundaries_win():
    text = "a" * 2500 + ".\n\n" + "b" * 600 + ". " + "c" * 3000
    assert pieces(text)[0][1] == 2503


def test_split_documents(spark):
    rows = [(1, "x" * 4001, 5), (2, "x" * 4000, 5), (3, None, None), (4, "", 5), (5, "A sentence. " * 5000, 5), (5, "A sentence. " * 5000, 5), (6, "y " * 3000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, cut int")
    out = split.split_documents(spark, df).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {1, 5, 6} and len(by[5]) % 2 == 0
    assert all(len(r.text) <= 4000 and r.text == dict((a, b) for a, b, _ in rows)[r.doc_id][r.start_char : r.end_char] for r in out)
    assert [r.chunk_index for r in sorted(by[1], key=lambda r: r.chunk_index)] == [0, 1]
    kinds = {r.doc_id: r.cut for r in split.cut_kinds(split.split_documents(spark, df, with_text=False)).collect()}
    assert kinds == {1: "forced", 5: "natural", 6: "forced"}
    assert {r.doc_id for r in split.split_documents(spark, df, only_long=False).collect()} == {1, 2, 4, 5, 6}
    assert split.split_documents(spark, df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split.split_documents(spark, df, max_chars=100, overlap=100)


def test_very_long_text():
    text = "Word one. " * 200_000
    parts = pieces(text)
    assert parts[-1][1] == len(text) and not any(f for *_, f in parts)


def test_runs_at_the_exact_length(spark, tmp_path):
    import __spark_entry__ as entry

    texts = {(n, b, k): t for n in (3799, 3800, 3801) for b in ("\n", "\r\n") for k, t in enumerate(("x" * n + b + "y" * 1000, "z" * 1000 + b + "x" * n + b + "y" * 100, "z" * 1000 + b + "x" * n, "Ab. " + "x" * n + ". " + "y" * 500))}
    length = lambda key: key[0] + (key[2] == 3)  # noqa: E731  # its full stop lies in the run
    spark.createDataFrame(list(enumerate(texts.values())), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.cut for r in entry.queries()["p2_found"](spark, str(tmp_path)).collect()}
    assert got == {i: "forced" if length(key) > 3800 else "natural" for i, key in enumerate(texts)}


def test_an_empty_line_in_the_lower_half_beats_a_weak_cut_there():
    text = "a" * 1000 + ".\n\n" + "b" * 700 + ". " + "c" * 6000
    assert pieces(text)[0][1] == 1003


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 45), st.sampled_from(["\n", "\r\n", "\n\n", ". ", ".\r\n", "! "])), max_size=12), st.integers(12, 45), st.integers(0, 10))
def test_cuts_on_both_sides_are_forced_in_long_runs_only(runs, most, overlap):
    text = "".join("x" * n + b for n, b in runs) + "y" * 20
    last, longest = 0, 0
    for m in split.BOUNDARY.finditer(text):
        last, longest = m.end(), max(longest, m.start() - last)
    longest = max(longest, len(text) - last)
    parts, cut = pieces(text, most, overlap, both_sides=True), 0
    for start, end, _ in parts:
        assert end - start <= most and start == max(0, cut - overlap) and end > cut
        cut = end
    assert cut == len(text)
    if len(text) > most:
        assert any(p[2] for p in parts) == (longest > most - overlap)


def test_p2_found_comes_from_the_pieces(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry

    texts = ["x" * 3800 + "\n" + "y" * 3800 + "\r\n" + "z" * 3800, "A sentence. " * 1000, "w" * 3801 + ". " + "v" * 500, "short", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made, real = [], split.split_documents
    monkeypatch.setattr(split, "split_documents", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    got = {r.doc_id: r.cut for r in entry.queries()["p2_found"](spark, str(tmp_path)).collect()}
    assert got == {0: "natural", 1: "natural", 2: "forced"}
    assert len(made) == 1
    cuts = sorted((r.doc_id, r.start_char, r.end_char, r.cut) for r in made[0].collect())
    assert cuts == [(i, a, b, "forced" if f else "natural") for i, t in enumerate(texts[:3]) for a, b, f in pieces(t, both_sides=True)]


@pytest.mark.parametrize("both_sides", [False, True])
def test_tables_of_few_boundaries_cut_the_same(monkeypatch, both_sides):
    text = ("One two. Three!\n" * 40 + "\n" + "x" * 70 + ".\r\n") * 5
    whole = pieces(text, 60, 10, both_sides=both_sides)
    for n in (1, 5, 64):
        monkeypatch.setattr(split, "BLOCK", n)
        assert pieces(text, 60, 10, both_sides=both_sides) == whole
