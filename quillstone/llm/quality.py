"""Statistics of each text, and its type by labelling functions whose accuracies are learnt from their agreement."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import lines as L
from quillstone.runtime import Scope, maybe_broadcast, ship

#: Frequent function words of English, French, Spanish and German, all of two letters or more.
COMMON = frozenset(
    """the of and to in that is was by for on with as his her its their this no any each another an not be it which
    from at or but into upon under over after before against if because since until unless while whereas although so
    than there he she they were has had have you we my our these those been are will would shall may must can who whom
    le la les de des du un une et en par pour que qui dans sur avec au aux ce cette ces son sa ses leur leurs il elle
    est sont ne pas ou sous sans plus après malgré afin comme être été
    el los las del una por para con su sus al se es son no como sin sobre entre este esta estos según hasta
    der die das den dem des ein eine einer eines einem und in von zu mit auf für im ist sind nicht als auch nach vor
    aus bei durch über unter oder dass zum zur sich wird werden""".split()
)
WORD = re.compile(r"[^\W\d_]+")
#: Words of scripts whose vowel signs and tones are marks.
MARKED_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
MARK = regex.compile(r"\p{M}")
SENTENCE = re.compile(r"[.!?؟۔।](?:[\s\"”’»)]|$)|[。！？｡]")
#: A token with a sign between its letters that words don't hold, and whether a line has such a sign at all.
DAMAGED = re.compile(r"[^\W_][^\w\s'’\-.,/:&–­̀-ͯ​-‏]+[^\W_]")
ODD = re.compile(r"[^\w\s'’\-.,/:&–­̀-ͯ​-‏]")
LATIN_END = "ɏ"
#: Letters of scripts that are written without spaces between words: Thai to Tibetan, Burmese, Khmer, kana, ideographs.
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: What divides the fields of a table's row, and what begins an entry of a list.
FIELDS = re.compile(r"\s*[|¦│\t;]\s*| {3,}")
BULLET = re.compile(r"\s*(?:[-–—*•·◦▪●○■□▶►»›+#]|\(?\w{1,3}[.)])\s")
LONG_TOKEN = 25

STATISTICS = ("chars", "words", "mean_word_length", "symbol_ratio", "digit_ratio", "letter_ratio", "punctuated_lines", "common_words", "distinct_words", "damaged_tokens", "long_tokens", "prose_chars")


def damaged_tokens(line: str) -> int:
    """Tokens with a sign between their letters that words don't hold. Most tokens are letters but for their ends."""
    if not ODD.search(line):
        return 0
    odd = [t for t in line.split() if not t.isalpha() and not t[:-1].isalpha()]
    return len(DAMAGED.findall(" ".join(odd))) if odd else 0


def line_is_prose(words: list[str], letters: int, solid: int, common: int, line: str, damaged: int, near_words: int, near_common: int) -> bool:
    """Whether a line reads as part of sentences, given the words of itself and of its two neighbours together."""
    if not words or letters < 0.6 * solid:
        return False
    if common >= 0.15 * len(words) or (near_words >= 6 and near_common >= 0.2 * near_words and (common or len(words) < 5)):
        return damaged <= 0.1 * len(words) + 1
    foreign = sum(len(w) for w in words if w[0] > LATIN_END)
    if 2 * foreign > letters:
        # no word list for these scripts: what isn't laid out as a row or an entry is read as part of sentences
        if SENTENCE.search(line.rstrip()):
            return not damaged or damaged <= 0.3 * len(words) + 1
        return 4 * len(FIELDS.findall(line.strip())) < len(words) and not BULLET.match(line)
    # no known language: sentences by their shape
    return len(words) >= 8 and letters >= 0.85 * solid and bool(SENTENCE.search(line)) and len(set(words)) >= 0.6 * len(words) and 2.5 <= letters / len(words) <= 9 and not damaged


def statistics(text: str) -> tuple[float | None, ...]:
    """STATISTICS of a text (see README); ratios are of its characters that aren't white space, common_words of its words.
    A statistic that says nothing of the text's script is None: common words of languages outside COMMON's script, and
    damaged, distinct and long tokens where words aren't divided by spaces."""
    lines = [x for x in text.splitlines() if x and not x.isspace()]
    low = list(map(str.lower, lines))
    marks = not text.isascii() and MARK.search(text) is not None
    words = list(map((MARKED_WORD if marks else WORD).findall, low))
    common = [sum(map(COMMON.__contains__, w)) for w in words]
    size = [0, *map(len, words), 0]
    many = [0, *common, 0]
    in_line = [sum(map(len, w)) for w in words]
    letters = sum(in_line)
    unspaced = latin = False
    if text.isascii():
        latin = True
    elif letters:
        latin = 2 * sum(len(w) for x, ws in zip(lines, words) if not x.isascii() for w in ws if w[0] > LATIN_END) <= letters
        unspaced = not latin and 2 * len(UNSPACED.findall(text)) > letters
    plain = [MARK.sub("", x) for x in lines] if marks else lines
    broken = [0] * len(lines) if unspaced or not ODD.search(text) else list(map(damaged_tokens, plain))
    tokens = text.split()
    solid = [len(x) - x.count(" ") - x.count("\t") - x.count("\xa0") for x in lines]
    prose = 0
    for k, line in enumerate(lines):
        if line_is_prose(words[k], in_line[k], solid[k], common[k], line, broken[k], sum(size[k : k + 3]), sum(many[k : k + 3])):
            prose += solid[k]
    total = max(1, sum(solid))
    n = sum(size)
    digits = sum(map(text.count, "0123456789"))
    ends = sum(x.rstrip()[-1] in ".!?:;…”\"’»)。！？؟।" for x in lines)
    distinct = len(set().union(*words)) if words else 0
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    long = int(lengths[lengths >= LONG_TOKEN].sum())
    return (
        float(total if lines else 0), float(n), letters / max(1, n), max(0.0, (total - letters - digits) / total), digits / total, letters / total,
        ends / max(1, len(lines)), sum(common) / max(1, n) if latin else None, None if unspaced else distinct / max(1, n),
        None if unspaced else sum(broken) / max(1, len(tokens)), None if unspaced else long / total, prose / total,
    )


#: Labelling functions: a statistic and the ranges in which it votes for prose and against it; between, it abstains.
#: (name, statistic, prose from, prose to, other from, other to)
VOTES = (
    ("sentences", "prose_chars", 0.55, 1.01, -1.0, 0.45),
    ("common words", "common_words", 0.19, 1.01, -1.0, 0.12),
    ("letters", "letter_ratio", 0.85, 1.01, -1.0, 0.7),
    ("damage", "damaged_tokens", -1.0, 0.03, 0.08, 1e9),
    ("repetition", "distinct_words", 0.3, 1.01, -1.0, 0.05),
    ("blobs", "long_tokens", -1.0, 0.15, 0.35, 1.01),
    ("line ends", "punctuated_lines", 0.6, 1.01, -1.0, 0.05),
)


def votes(stats: DataFrame) -> DataFrame:
    """With `votes`: one letter for each of VOTES, p for prose, o for other, - for no vote."""
    each = [F.when(F.col(s).between(a, b), "p").when(F.col(s).between(c, d), "o").otherwise("-") for _, s, a, b, c, d in VOTES]
    return stats.withColumn("votes", F.concat(*each))


def learn(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray]:
    """The posterior of `other` for each vote pattern, by expectation-maximisation over pattern counts, and the learnt
    chance of each vote, if one is given, for each type (type, function, vote). It starts from the majority of votes.
    An abstention says nothing: a text between the ranges of many functions, or to which they don't apply, is no more
    likely to be either type."""
    names = sorted(patterns)
    if not names:
        return {}, np.full((2, len(VOTES), 3), np.nan)
    codes = np.array([["p-o".index(c) for c in name] for name in names])
    weight = np.array([patterns[n] for n in names], float)
    hot = np.eye(3)[codes] * np.array([1, 0, 1])
    balance = (codes == 2).sum(1) - (codes == 0).sum(1)
    other = np.where(balance > 0, 0.9, np.where(balance < 0, 0.1, 0.5))
    for _ in range(rounds):
        share = np.stack([1 - other, other]) * weight
        prior = (share.sum(1) + 1) / (weight.sum() + 2)
        chance = np.einsum("kn,nfv->kfv", share, hot) + np.array([0.5, 0, 0.5])
        chance = chance / chance.sum(2, keepdims=True)
        score = np.log(prior)[:, None] + np.einsum("nfv,kfv->kn", hot, np.log(np.maximum(chance, 1e-300)))
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        if np.abs(new - other).max() < 1e-9:
            break
        other = new
    return dict(zip(names, other.tolist())), chance


def measured(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, source, h, STATISTICS...) of each text without its wanted lines (h, slice); h: those it held."""

    def step(shared: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(2).to_pylist()
                rows, held = [], []
                for text, found in zip(texts, L.marked(batch.column(1).to_pylist(), texts, shared.value)):
                    if found:
                        text = "\n".join(line for line, gone in zip(text.split("\n"), found[2].tolist()) if not gone)
                    held.append(np.unique(found[1][found[2]]) if found else None)
                    rows.append(statistics(text) if text is not None else (None,) * len(STATISTICS))
                columns = list(zip(*rows)) or [()] * len(STATISTICS)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.list_(pa.int64())), *(pa.array(c, pa.float64()) for c in columns)], names=["doc_id", "source", "h", *STATISTICS])

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    return L.in_rounds(docs, wanted, step, f"doc_id {kind}, source string, h array<bigint>, " + ", ".join(f"{s} double" for s in STATISTICS))


def _no_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "h bigint, slice int")


def text_statistics(spark: SparkSession, documents: DataFrame, lines: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, STATISTICS...) of every text without its source's repeated `lines` (source, key). Null text: null
    statistics; empty and blank text: zeros. One narrow pass; repeated rows come out repeatedly."""
    ship(spark)
    docs = L._inputs(documents, id_col, source_col, text_col)
    return measured(docs, _no_lines(spark) if lines is None else L.hashed_lines(lines)).select("doc_id", *STATISTICS)


def without_repeated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, STATISTICS...) of texts without the lines that their source repeats, in two passes over the texts.

    The second pass takes out all candidate lines and says which ones a text held, so that the same pass counts them.
    Texts that held a candidate which falls below the threshold are measured again, without the confirmed lines only."""
    with Scope(spark) as scope:
        candidates, totals = L.candidate_lines(scope, docs, L.MIN_DOCUMENTS, L.MIN_SHARE)
        first = scope.written(measured(docs, candidates), "measured", keep=True)
        counts = first.where("h is not null").select("source", F.explode("h").alias("h")).groupBy("source", "h").agg(F.count("*").alias("n"))
        weak = scope.written(L.left_join_unique(counts, totals, "source").where("n < need").select("h"), "weak", keep=True)
        if weak.isEmpty():
            return first.select("doc_id", *STATISTICS)
        row = F.to_json(F.struct("doc_id"))  # names null ids, too
        again = scope.written(first.where("h is not null").select(row.alias("row"), F.explode("h").alias("h")).join(maybe_broadcast(weak), "h", "left_semi").select("row").distinct(), "again", keep=True)
        again = maybe_broadcast(again)
        strong = scope.written(candidates.join(maybe_broadcast(weak), "h", "left_anti"), "strong")
        second = measured(docs.withColumn("row", row).join(again, "row", "left_semi").drop("row"), strong)
        return first.withColumn("row", row).join(again, "row", "left_anti").select("doc_id", *STATISTICS).unionByName(second.select("doc_id", *STATISTICS))


def scored(spark: SparkSession, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`stats` (a stored table) with `votes` and `other`, the posterior of not being prose; and what was learnt of each
    function: (function, statistic, prose_votes, other_votes, abstained, prose_accuracy, other_accuracy). Only the counts
    of vote patterns reach the driver, at most 3^7 rows however large the corpus."""
    stats = votes(stats)
    patterns = {r["votes"]: r["n"] for r in stats.where("chars > 0").groupBy("votes").agg(F.count("*").alias("n")).collect()}
    posterior, chance = learn(patterns)
    scores = spark.createDataFrame([*posterior.items()], "votes string, other double")
    counts = {v: [sum(n for p, n in patterns.items() if p[i] == v) for i in range(len(VOTES))] for v in "po-"}
    known = [(name, statistic, counts["p"][i], counts["o"][i], counts["-"][i], *(None if np.isnan(x) else float(x) for x in (chance[0, i, 0], chance[1, i, 2]))) for i, (name, statistic, *_) in enumerate(VOTES)]
    accuracies = spark.createDataFrame(known, "function string, statistic string, prose_votes bigint, other_votes bigint, abstained bigint, prose_accuracy double, other_accuracy double")
    return stats.join(F.broadcast(scores), "votes", "left").withColumn("other", F.when(F.col("chars") > 0, F.col("other"))), accuracies


def text_types(spark: SparkSession, documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", without_repeated_lines: bool = True) -> DataFrame:
    """(doc_id, STATISTICS..., votes, other, text_type): the posterior of not being prose, and the type by it.

    text_type is `prose`, `other` (lists, tables, junk) or `blank` (null, empty, white space, or nothing but lines that
    its site repeats). A function that doesn't apply to a text's script abstains. Repeated rows come out repeatedly; an
    empty table gives no rows; other columns are not read."""
    return typed(spark, documents, id_col, source_col, text_col, without_repeated_lines)[0]


def typed(spark: SparkSession, documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", without_repeated_lines: bool = True) -> tuple[DataFrame, DataFrame]:
    """text_types, and the accuracies that were learnt of the functions (see scored)."""
    ship(spark)
    docs = L._inputs(documents, id_col, source_col, text_col)
    with Scope(spark) as scope:
        stats = without_repeated(spark, docs) if without_repeated_lines else measured(docs, _no_lines(spark)).select("doc_id", *STATISTICS)
        stats, accuracies = scored(spark, scope.written(stats, "statistics", keep=True))
    kind = F.when(F.coalesce("chars", F.lit(0.0)) == 0, "blank").when(F.col("other") > 0.5, "other").otherwise("prose")
    return stats.select("doc_id", *STATISTICS, "votes", "other", kind.alias("text_type")), accuracies
