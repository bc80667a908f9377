"""Lexical retrieval: searches of one table, boolean queries, phrases, dis-max, the router of queries. See postings."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


K1, B = 1.2, 0.75


def query_words(query: str) -> list[str]:
    """The distinct words of a query, in order."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


def bm25(spark: SparkSession, docs: DataFrame, fields: Mapping[str, float], query: str, keep: Sequence[str], operator: str = "or", tie: float = 0.0) -> DataFrame:
    """The kept columns, of which the first is a unique key, with `score`: Postings.bm25 over an index of this table,
    built for this one query. Build the index once where there are more."""
    from quillstone.operators.postings import Postings

    found = Postings.build(spark, docs, keep[0], list(fields)).bm25(fields, query, operator, tie)
    return docs.select(*keep).join(found.withColumnRenamed("key", keep[0]), keep[0])


def full_text(spark: SparkSession, docs: DataFrame, text: str, query: str, keep: Sequence[str]) -> DataFrame:
    """The same with `rank` of Postings.full_text."""
    from quillstone.operators.postings import Postings

    found = Postings.build(spark, docs, keep[0], [text]).full_text(text, query)
    return docs.select(*keep).join(found.withColumnRenamed("key", keep[0]), keep[0])


def phrase(words_column: Column, query: str, slop: int = 0) -> Column:
    """The words of the query in order; with slop, at most so many other words between them in all."""
    words = query_words(query)
    joined = F.concat(F.lit(" "), F.array_join(words_column, " "), F.lit(" "))
    if not words:
        return F.lit(False)
    if slop == 0:
        return F.contains(joined, F.lit(f" {' '.join(words)} "))
    if len(words) == 1:
        return F.array_contains(words_column, words[0])
    gap = rf" (?:[^ ]+ ){{0,{slop}}}"
    # several gaps share the slop: the match must not be longer than the words plus the slop
    match = F.regexp_extract_all(joined, F.lit(f"(?<= )(?=({gap.join(words)}) )"), F.lit(1))
    return F.exists(match, lambda m: F.size(F.split(m, " ")) <= len(words) + slop)


class Boolean:
    """A boolean query as a condition on an array of words: AND, OR, NOT, brackets, "phrases"; words side by side are
    joined by AND. Broken queries raise ValueError."""

    TOKEN = re.compile(r'\s*(?:"([^"]*)"|([()])|([^\s()"]+))')

    def __init__(self, query: str):
        self.tokens = [("phrase", m[1]) if m[1] is not None else ("sign", m[2]) if m[2] else ("op", m[3]) if m[3] in ("AND", "OR", "NOT") else ("word", m[3]) for m in self.TOKEN.finditer(query)]
        self.at = 0
        if not self.tokens:
            raise ValueError("an empty query")
        self.tree = self._either()
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at][1]!r}")

    def _next(self) -> tuple[str, str] | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def _either(self):
        parts = [self._all()]
        while self._next() == ("op", "OR"):
            self.at += 1
            parts.append(self._all())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def _all(self):
        parts = [self._one()]
        while (t := self._next()) and t != ("op", "OR") and t != ("sign", ")"):
            if t == ("op", "AND"):
                self.at += 1
            parts.append(self._one())
        return parts[0] if len(parts) == 1 else ("and", parts)

    def _one(self):
        t = self._next()
        if t is None:
            raise ValueError("the query ends too early")
        self.at += 1
        if t == ("op", "NOT"):
            return ("not", [self._one()])
        if t == ("sign", "("):
            inner = self._either()
            if self._next() != ("sign", ")"):
                raise ValueError("a bracket isn't closed")
            self.at += 1
            return inner
        if t[0] in ("word", "phrase"):
            return t
        raise ValueError(f"unexpected {t[1]!r}")

    def positive(self) -> list[str]:
        """The words that may count for a document: those not below NOT."""
        out: list[str] = []

        def walk(node, below: bool) -> None:
            kind, rest = node
            if kind in ("not", "and", "or"):
                for x in rest:
                    walk(x, below or kind == "not")
            elif not below:
                out.extend(query_words(rest))

        walk(self.tree, False)
        return list(dict.fromkeys(out))

    def condition(self, words_column: Column) -> Column:
        def build(node) -> Column:
            kind, rest = node
            if kind == "not":
                return ~build(rest[0])
            if kind in ("and", "or"):
                return reduce(Column.__and__ if kind == "and" else Column.__or__, map(build, rest))
            return phrase(words_column, rest)

        return build(self.tree)


def dis_max(scores: Sequence[Column], tie: float = 0.2) -> Column:
    """The best score plus `tie` times the others."""
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return best + tie * (reduce(Column.__add__, scores) - best)


#: Rules of the query router in order; the first that fits names the kind of query.
ROUTES = (
    ("citation", re.compile(r"\[\d{4}\]\s+[A-Z]+\s+\d+|\d+\s+CLR\s+\d+")),
    ("case_name", re.compile(r"\b[A-Z][\w'’.-]*\s+(?:[\w&'’.-]+\s+)*?vs?\.?\s+(?:[\w&'’.-]+\s+)*?[A-Z]")),
    ("legislation", re.compile(r"\bAct\b|\bsections?\b|\bss?\.?\s*\d")),
    ("boolean", re.compile(r"\b(?:AND|OR|NOT)\b|\"")),
)
QUESTION = re.compile(r"\?\s*$|^(?:who|what|when|where|which|why|how|is|are|was|were|does|do|did|can|may|must|should)\b", re.I)
#: A query of more words than this is a question.
MOST_KEYWORDS = 7
#: What a query may say of place and time.
IN_YEAR = re.compile(r"\b(?:in|of|since)\s+((?:18|19|20)\d{2})\b")
STATES = ("nsw", "vic", "qld", "sa", "wa", "tas", "nt", "act", "cth")


def route(query: str) -> str:
    """The kind of a query: citation, case_name, legislation, boolean, question, else keyword."""
    kind = next((name for name, rx in ROUTES if rx.search(query)), None)
    if kind is None:
        kind = "question" if len(query.split()) > MOST_KEYWORDS or QUESTION.search(query) else "keyword"
    return kind


def entities(query: str, databases: Sequence[str] = ()) -> dict[str, object]:
    """Filters that a query names, whatever its kind: a subjurisdiction in capitals, one of the databases, a year after
    `in`, `of` or `since` (not one inside a citation)."""
    out: dict[str, object] = {}
    words = re.findall(r"[A-Za-z]+", query)
    state = next((w.lower() for w in words if w.isupper() and w.lower() in STATES and not (w == "ACT" and "Act" in words)), None)
    if state:
        out["subjurisdiction"] = state
    court = next((w for w in words if w in databases), None)
    if court:
        out["database"] = court
    if year := IN_YEAR.search(query):
        out["year"] = int(year[1])
    return out


def without_year(query: str) -> str:
    """The query without the year that entities() takes from it."""
    return " ".join(IN_YEAR.sub(" ", query, count=1).split())
