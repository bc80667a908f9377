from __future__ import annotations

import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import bpe

if not Path(bpe.DEFAULT_VOCABULARY).exists():
    pytest.skip("no vocabulary file", allow_module_level=True)

encoder = bpe.Encoder(bpe.Vocabulary())


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return t


REFERENCE = library()


def ids(texts):
    flat, per = encoder.encode(texts)
    out, at = [], 0
    for n in per.tolist():
        out.append(flat[at : at + n].tolist())
        at += n
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_any_text_as_the_library(texts):
    assert ids(texts) == [e.ids for e in REFERENCE.encode_batch(texts, add_special_tokens=False)]


def test_hard_cases():
    random.seed(4)
    texts = ["", " ", "a  b", " lead", "trail ", "x\n y", "<|endoftext|>", "aaa" * 3001, "abab" * 999, "don't I'LL we're", "é́ 日本語 ١٢٣ ½", "\x1c \x85   x", "".join(random.choice("abcdefgh") for _ in range(5000))]
    assert ids(texts) == [e.ids for e in REFERENCE.encode_batch(texts, add_special_tokens=False)]


def test_forgetting_keeps_results(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    texts = ["one two three four five", "six seven one two"]
    own = bpe.Encoder(encoder.v)
    for t in texts * 3:
        flat, _ = own.encode([t])
        assert flat.tolist() == REFERENCE.encode(t, add_special_tokens=False).ids


def test_documents(spark):
    rows = [(1, "A decision.", 9), (2, "", 9), (3, None, None), (None, "x", 9), (1, "A decision.", 9), (4, "long text " * 100_000, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    out = bpe.encode_documents(spark, df)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = sorted(((r.doc_id, r.ids) for r in out.collect()), key=str)
    want = sorted(((i, None if t is None else REFERENCE.encode(t, add_special_tokens=False).ids) for i, t, _ in rows), key=str)
    assert got == want and bpe.encode_documents(spark, df.limit(0)).count() == 0
