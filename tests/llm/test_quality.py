from __future__ import annotations

from quillstone.llm import quality
from quillstone.llm.lines import repeated_lines

PROSE = "The court held that the appeal was dismissed, because the tenant had not paid the rent to the landlord. It follows that no costs are due.\n"
TABLE = "\n".join(f"{i * 37}.50 | 1{i}/2/2003 | ${i * 991},101 | Nimrod" for i in range(40))
LISTED = "\n".join(f"- {a} {b} statement" for a in ("agreed", "unpaid", "joint", "minor", "plain") for b in ("river", "dam", "bail", "levy", "visa", "wharf"))
CODE = "\n".join(f'<td data-x{i}="abc" width={i}></td>\nvar q{i} = z["k{i}"] || {{}};' for i in range(25))
NOISE = "\n".join("qz;kd,wle .mnv,;xop|s }k{e^ th!s# @nd {" for _ in range(30))


def docs(spark):
    rows = [(i, "s", PROSE * (3 + i % 5), 1.0) for i in range(40)]
    rows += [(100 + i, "s", t, 1.0) for i, t in enumerate((TABLE, LISTED, CODE, NOISE) * 3)]
    rows += [(200, "s", PROSE + TABLE, 1.0), (201, "s", PROSE * 40 + TABLE, 1.0), (202, "s", PROSE.upper() * 4, 1.0), (203, "s", PROSE.replace(" ", "\n") * 4, 1.0)]
    rows += [(300, "s", None, 1.0), (301, None, "", 1.0), (302, "s", " \n\t", 1.0), (303, None, PROSE * 2000, 1.0)]
    rows += [(400, "s", "Суд постановил, что апелляция отклонена. Расходы не возмещаются.\n" * 6, 1.0), (401, "s", "Il tribunale respinge il ricorso della parte civile. Nessun costo viene rimborsato oggi.\n" * 2, 1.0)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, words double")


def test_types(spark):
    out = {r.doc_id: r for r in quality.text_types(spark, docs(spark), without_repeated_lines=False).collect()}
    kind = {i: r.text_type for i, r in out.items()}
    assert all(kind[i] == "prose" for i in range(40))
    assert all(kind[100 + i] == "other" for i in range(12))
    assert kind[200] == "other" and kind[201] == kind[202] == kind[303] == kind[400] == kind[401] == "prose"
    assert kind[300] == kind[301] == kind[302] == "blank"
    assert out[300].words is None and out[302].words == 0 and 0 <= out[0].other <= 1


def test_repeated_lines_are_left_out(spark):
    rows = [(i, "s", TABLE.replace("Nimrod", "same words") + "\n" + " ".join([PROSE.strip()] * (1 + i % 3)) + f" The {'abcdefgh'[i] * 3} is new.") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    assert {r.text_type for r in quality.text_types(spark, df).collect()} == {"prose"}


def test_statistics_of_edges():
    assert len(quality.statistics("")) == len(quality.STATISTICS) and quality.statistics("")[0] == 0
    s = dict(zip(quality.STATISTICS, quality.statistics("The cat sat.\nIt was 12.")))
    assert s["words"] == 5 and s["punctuated_lines"] == 1.0 and s["digit_ratio"] == 2 / 18


def test_learning_finds_the_weak_function():
    names = {"p" * 9: 800, "o" * 9: 150, "p" * 8 + "o": 100, "o" * 8 + "p": 100}
    posterior, chance = quality.learn(names)
    assert posterior["p" * 8 + "o"] < 0.01 and posterior["o" * 8 + "p"] > 0.99
    assert chance[1, 0, 2] > 0.95 and chance[1, 8, 2] < 0.7
    assert quality.learn({})[0] == {}


def test_empty_table(spark):
    assert quality.text_types(spark, docs(spark).limit(0)).count() == 0


OTHER_SCRIPTS = {
    "chinese": ("法院认为上诉应予驳回，因为承租人没有按照合同约定支付租金。双方当事人对此没有提出异议，本院予以确认。\n", "第|条|租金|码头\n"),
    "japanese": ("裁判所は、賃借人が契約に従って賃料を支払わなかったため、控訴を棄却すべきであると判断した。当事者はこれを争わない。\n", "項目|賃料|港湾|番号\n"),
    "thai": ("ศาลเห็นว่าผู้เช่าไม่ได้ชำระค่าเช่าตามสัญญา จึงพิพากษายกอุทธรณ์ คู่ความไม่ได้โต้แย้งข้อเท็จจริงดังกล่าว\n", "เลขที่|ค่าเช่า|ท่าเรือ|ศาล\n"),
    "russian": ("Суд постановил, что апелляция отклонена, так как арендатор не платил по договору. Расходы сторон не возмещаются.\n", "Иванов | Москва | адвокат | пристань\n"),
    "hindi": ("न्यायालय ने कहा कि किरायेदार ने अनुबंध के अनुसार किराया नहीं दिया। इसलिए अपील खारिज की जाती है।\n", "नाम | शहर | किराया | घाट\n"),
}


def test_prose_and_tables_of_other_scripts(spark):
    rows = [(i, "s", PROSE * (3 + i % 5)) for i in range(40)] + [(100 + i, "s", t) for i, t in enumerate((TABLE, LISTED, CODE, NOISE) * 3)]
    rows += [(200 + 10 * k + j, "s", text * 8) for k, pair in enumerate(OTHER_SCRIPTS.values()) for j, text in enumerate(pair)]
    rows += [(300 + k, "s", prose.replace("\n", "") * 3) for k, (prose, _) in enumerate(OTHER_SCRIPTS.values())]
    rows += [(400, "s", "".join(f"- пункт {w}\n" for w in ("река согласовано", "дамба спорно", "залог заявление", "виза отказ") * 6))]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    out, accuracies = quality.typed(spark, df, without_repeated_lines=False)
    kind = {r.doc_id: r.text_type for r in out.collect()}
    for k, script in enumerate(OTHER_SCRIPTS):
        assert (script, kind[200 + 10 * k], kind[201 + 10 * k], kind[300 + k]) == (script, "prose", "other", "prose")
    assert kind[400] == "other" and all(kind[i] == "prose" for i in range(40))
    learnt = {r.function: r for r in accuracies.collect()}
    assert len(learnt) == len(quality.VOTES) and learnt["sentences"].prose_accuracy > 0.9 and learnt["common words"].abstained >= 11


def test_functions_that_do_not_apply_abstain():
    s = dict(zip(quality.STATISTICS, quality.statistics(OTHER_SCRIPTS["chinese"][0])))
    assert s["common_words"] is s["long_tokens"] is s["damaged_tokens"] is s["distinct_words"] is None and s["prose_chars"] == 1.0
    assert dict(zip(quality.STATISTICS, quality.statistics(OTHER_SCRIPTS["russian"][0])))["distinct_words"] > 0.9


def test_texts_with_candidates_below_the_threshold_are_measured_again(spark):
    """A line that is heavy in one part of the documents only is no repeated line, so that its text keeps it."""
    rows = [(i, "s", "Shared words of the site\n" + (PROSE if i < 30 else TABLE)) for i in range(40)]
    rows += [(100 + i, "t", "Nearly a repeated line of the site\n" + PROSE * 2) for i in range(4)] + [(110 + i, "t", PROSE) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(3)
    lines = repeated_lines(spark, df)[0]
    want = {r.doc_id: r.chars for r in quality.text_statistics(spark, df, lines).collect()}
    assert {r.doc_id: r.chars for r in quality.text_types(spark, df).collect()} == want
