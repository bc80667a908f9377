from __future__ import annotations

import random
from itertools import combinations

import numpy as np

from quillstone.llm import near_duplicates as nd

VOCABULARY = [f"w{i}" for i in range(3000)]


def words_of(text):
    return nd.WORD.findall(text.lower())


def brute(rows, words, similarity, least=20):
    sets = {}
    for i, t in rows:
        w = words_of(t or "")
        if len(w) >= max(least, words):
            sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def corpus(seed=1):
    rng = random.Random(seed)
    rows, n = [], 0
    for g in range(25):
        base = [rng.choice(VOCABULARY) for _ in range(rng.choice([25, 80, 200]))]
        for k in range(rng.choice([1, 3, 5])):
            text = list(base)
            for _ in range(k * len(base) // 60):
                text[rng.randrange(len(text))] = rng.choice(VOCABULARY)
            rows.append((n, " ".join(text)))
            n += 1
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, cls int, a string")


def test_pairs_against_brute_force(spark):
    rows = corpus()
    rows += [(900, rows[3][1]), (901, rows[3][1].upper() + " !"), (902, None), (903, ""), (904, "too short a text"), (905, rows[3][1])]
    got = {(r.doc_id_a, r.doc_id_b) for r in nd.near_duplicates(spark, table(spark, rows), words=3, similarity=0.5).pairs().collect()}
    assert got == brute(rows, 3, 0.5) and (900, 905) in got


def test_default_threshold_and_classes(spark):
    rows = corpus(2)
    rows += [(800, rows[0][1]), (801, rows[0][1])]
    result = nd.near_duplicates(spark, table(spark, rows))
    assert {(r.doc_id_a, r.doc_id_b) for r in result.pairs().collect()} == brute(rows, 5, 0.8)
    classes = {r.doc_id: r for r in result.classes().collect()}
    assert len(classes) == len(rows) and classes[800].class_id == 0 and classes[0].copies == 3
    groups = {r.doc_id: r.group_id for r in result.groups().collect()}
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute(rows, 5, 0.8):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert groups == {i: root(i) for i, _ in rows}


def test_large_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(nd, "BUCKET", 2)
    monkeypatch.setattr(nd, "TILE", 3)
    rng = random.Random(5)
    base = [rng.choice(VOCABULARY) for _ in range(150)]
    rows = []
    for i in range(20):
        text = list(base)
        for _ in range(i // 2):
            text[rng.randrange(150)] = f"new{i}x{rng.random()}"
        rows.append((i, " ".join(text)))
    got = {(r.doc_id_a, r.doc_id_b) for r in nd.near_duplicates(spark, table(spark, rows), words=3, similarity=0.5).pairs().collect()}
    assert got == brute(rows, 3, 0.5)


def test_empty_table(spark):
    result = nd.near_duplicates(spark, table(spark, []))
    assert result.pairs().count() == result.classes().count() == result.groups().count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    c = nd.Circulant()
    for share in (0.2, 0.5, 0.8):
        n = 2000
        common = int(2 * n * share / (1 + share))
        x = rng.integers(0, 1 << 63, 2 * n - common).astype(np.uint64)
        a, b = c.signature(np.sort(x[:n])), c.signature(np.sort(x[n - common :]))
        assert abs((a == b).mean() - common / (2 * n - common)) < 0.08


def test_very_long_text():
    s = next(nd.Shingler(3).sets(["many words here again " * 100_000 + " ".join(VOCABULARY)], 20))
    assert len(nd.Circulant().signature(s)) == nd.COORDINATES


def test_sets_that_share_a_name_are_told_apart(spark, monkeypatch):
    """All sets get the same first name: only the second tells them apart."""
    real = nd.names_of
    monkeypatch.setattr(nd, "names_of", lambda s: (7, real(s)[1]))
    rows = corpus(3) + [(800, corpus(3)[0][1])]
    df = table(spark, rows)
    docs = df.select("doc_id", "text")
    sketched = nd.classed(nd.sketches(docs, 3, nd.rows_per_band(0.5), 20))
    assert sketched.select("cls").distinct().count() == len({frozenset(zip(w, w[1:], w[2:])) for _, t in rows for w in [words_of(t)]})


def test_repeated_ids_with_other_texts_and_null_ids(spark):
    rows = corpus(4)
    a, b = rows[0][1], rows[1][1]
    changed = a.replace(a.split()[10], "zz", 1)
    df = table(spark, [(1, a), (1, b), (2, changed), (2, b), (None, a), (3, None), (4, "")])
    got = {(r.doc_id_a, r.doc_id_b) for r in nd.near_duplicates(spark, df, words=3, similarity=0.5).pairs().collect()}
    assert (1, 2) in got


def test_blocks_of_a_hot_class_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)
    text = corpus(1)[0][1]
    near = text.replace(text.split()[5], "changed", 1)
    rows = [(i, text) for i in range(15)] + [(100 + i, near) for i in range(9)]
    got = [(r.doc_id_a, r.doc_id_b) for r in nd.near_duplicates(spark, table(spark, rows), words=3, similarity=0.5).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 3, 0.5)
