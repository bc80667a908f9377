"""Text expressions: words, trigrams, patterns, tokens, previews; all inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of characters that are neither letters nor digits of any script; words and single signs.
NOT_WORD = r"[^\p{L}\p{N}]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def words(text: Column) -> Column:
    """The lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, padded by two blanks before and one after."""

    def of(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substr(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words(text), of)))


def query_trigrams(text: str) -> list[str]:
    """The same of a constant."""
    found = (f"  {w} " for w in re.findall(r"[^\W_]+", text.lower()))
    return sorted({p[i : i + 3] for p in found for i in range(len(p) - 2)})


def similarity(text: Column, query: str) -> Column:
    """Share of common trigrams: Jaccard over trigram sets, 0 where both are empty, null for null text."""
    grams = query_trigrams(query)
    own = trigrams(text)
    common = F.size(F.array_intersect(own, F.array(*map(F.lit, grams)).cast("array<string>")))
    return F.when(text.isNull(), F.lit(None)).otherwise(F.coalesce(common / F.nullif(F.size(own) + len(grams) - common, F.lit(0)), F.lit(0.0)))


def like_escape(text: str) -> str:
    """A pattern that matches the text literally."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def contains(text: Column, query: str, escape: bool = True) -> Column:
    """Case-insensitive containment; with escape=False, % and _ of the query are wildcards."""
    return text.ilike(f"%{like_escape(query) if escape else query}%")


def token_count(text: Column) -> Column:
    """Words and single signs."""
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def natural_key(text: Column) -> Column:
    """A key that sorts digit runs by value: each is padded to 20 digits; letters are compared in lower case."""
    padded = F.regexp_replace(F.lower(text), r"(\d+)", "00000000000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{20})(?!\d)", "$1")


def preview(text: Column, chars: int = 500, dots: str = "") -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit(dots))).otherwise(text)


def citation_tag(source: Column, chunk_index: Column) -> Column:
    return F.concat(source, F.lit("#chunk"), chunk_index.cast("string"))


def sentences(text: Column) -> Column:
    """Cut at white space after . ! ? before a capital or an opening bracket."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+(?=[A-Z(])"), lambda s: F.trim(s) != "")


def paragraphs(text: Column) -> Column:
    """Cut at two or more line breaks; trimmed; empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def steps(text: Column) -> Column:
    """`Step n - Label: …` parts of an answer as an array of (step, label, body); the body ends at the next step or at
    `Final Conclusion`."""
    marked = F.regexp_replace(text, r"(?m)^(?:Step\s+\d+\s*-|Final Conclusion)", "\u0001$0")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: p.rlike(r"^Step\s+\d+\s*-"))
    m = r"(?s)^Step\s+(\d+)\s*-\s*([^:\n]*):?\s*(.*?)\s*$"
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, m, 1).cast("int").alias("step"), F.trim(F.regexp_extract(p, m, 2)).alias("label"), F.regexp_extract(p, m, 3).alias("body")))


def highlight(text: Column, terms: list[str], around: int = 80, tag: str = "b") -> Column:
    """A fragment around the first of the terms, with every term in tags; null where none occurs."""
    any_term = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    pattern = rf"(?i)(?<![\p{{L}}\p{{N}}])({any_term})(?![\p{{L}}\p{{N}}])"
    at = F.regexp_instr(text, F.lit(pattern))
    fragment = F.substr(text, F.greatest(F.lit(1), at - around), F.lit(2 * around))
    return F.when(at > 0, F.regexp_replace(fragment, pattern, rf"<{tag}>$1</{tag}>"))
