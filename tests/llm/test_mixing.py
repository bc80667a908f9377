from __future__ import annotations

from pathlib import Path

import pandas as pd
import pytest

from quillstone.llm import bpe, mixing
from quillstone.runtime import written

if not Path(bpe.DEFAULT_VOCABULARY).exists():
    pytest.skip("no vocabulary file", allow_module_level=True)

T = "mix_name string, size_factor double, source string, weight double, max_repeats int, budget int"


def setup(spark):
    docs = [(i, "big", f"word number {i} of a long text that goes on", 1) for i in range(200)]
    docs += [(1000 + i, "small", f"a rare text {i}", 1) for i in range(10)]
    docs += [(2000, None, "no source at all", 1), (2001, "big", None, 1), (2002, "big", "", 1), (2003, "blank", "", 1)]
    return spark.createDataFrame(docs, "doc_id bigint, source string, text string, tokens int")


def targets(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], T)


def test_shares_and_repeats(spark):
    docs = setup(spark)
    t = targets(spark, [("m", 0.3, "big", 0.8, 1), ("m", 0.3, "small", 0.2, 3), ("n", 0.5, "small", 1.0, None), ("n", 0.5, "none", 0.0, 2), ("z", 0.1, "absent", 1.0, 2), ("b", 0.1, "blank", 0.5, 2), ("b", 0.1, "big", None, 2)])
    chosen, report = mixing.mix(spark, docs, t)
    rows = chosen.collect()
    shares = {(r.mix_name, r.source): r for r in report.collect()}
    total = sum(r.tokens for r in mixing.sizes(spark, docs).collect())
    for (mix, source), r in shares.items():
        mine = [x for x in rows if (x.mix_name, x.source) == (mix, source)]
        assert sum(x.tokens * x.copies for x in mine) == r.actual_tokens and len(mine) == r.documents == len({x.doc_id for x in mine})
    assert all(1 <= x.copies <= {"big": 1, "small": 3}[x.source] for x in rows if x.mix_name == "m")
    m = [r for (mix, _), r in shares.items() if mix == "m"]
    assert abs(sum(r.actual_tokens for r in m) - 0.3 * total) < 25
    small = shares["m", "small"]
    assert small.actual_share <= 0.21 and small.documents == 10
    assert shares["n", "small"].actual_tokens == shares["n", "small"].available_tokens and shares["n", "none"].actual_tokens == 0
    assert not [x for x in rows if x.mix_name in ("z",)]
    copies = {x.copies for x in rows if x.mix_name == "m" and x.source == "small"}
    assert max(copies) - min(copies) <= 1  # whole epochs first
    again = mixing.mix(spark, docs.repartition(7), t)[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_empty_tables(spark):
    docs = setup(spark)
    chosen, report = mixing.mix(spark, docs.limit(0), targets(spark, [("m", 0.3, "big", 1.0, 1)]))
    assert chosen.count() == 0 and report.collect()[0].actual_tokens == 0
    chosen, report = mixing.mix(spark, docs, targets(spark, []))
    assert chosen.count() == report.count() == 0


def test_allotment_fills_by_weight():
    t = pd.DataFrame({"source": list("abc"), "weight": [0.5, 0.3, 0.2], "tokens": [10, 1000, 1000], "repeats": [2, 1, 1], "wanted": [500.0] * 3})
    assert mixing.allot(t)["budget"].tolist() == [20, 288, 192]
    t["wanted"] = 1e6
    assert mixing.allot(t)["budget"].tolist() == [20, 1000, 1000]


PROSE = "The court held that the appeal was dismissed, because the tenant had not paid the rent to the landlord.\n"
RUSSIAN = "Суд постановил, что апелляция отклонена, так как арендатор не платил по договору.\n"


def test_quality_orders_the_sample(spark):
    rows = [(i, "s", PROSE * (2 + i % 4)) for i in range(30)] + [(100, "s", RUSSIAN * 4), (101, "s", " \n ")]
    rows += [(200 + i, "s", "\n".join(f"{k * 7}.{i} | {k}/2/2003 | ${k * 99},1 | N" for k in range(30))) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    measured = written(spark, mixing.sizes(spark, df), "sizes")
    quality = {r.doc_id: r.quality for r in mixing.with_quality(spark, measured).collect()}
    assert min(quality[i] for i in range(30)) > 0.9 and quality[100] > 0.9
    assert quality[101] == max(quality[200 + i] for i in range(8)) == mixing.LEAST_QUALITY
    t = targets(spark, [("m", 0.3, "s", 1.0, 1)])
    chosen = {r.doc_id for r in mixing.mix(spark, df, t)[0].collect()}
    assert len(chosen & {200 + i for i in range(8)}) <= 2
