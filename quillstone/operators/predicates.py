"""Optional predicates on chunks and documents. A parameter that is None adds nothing to the plan."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import metadata as M
from quillstone.functions import text as X

#: The least trigram similarity that counts as a match.
TRIGRAM_LIMIT = 0.3


@dataclass(frozen=True)
class Filters:
    """The fifteen predicates of filtered search; see where()."""

    type: str | None = None
    types: Sequence[str] | None = None
    jurisdiction: str | None = None
    subjurisdiction: str | None = None
    database: str | None = None
    year: int | None = None
    date_from: str | None = None
    date_to: str | None = None
    both_dates: bool = False  # the range counts only if both ends are given
    title: str | None = None
    author: str | None = None
    citation: str | None = None
    country_member: str | None = None
    title_member: str | None = None
    citation_member: str | None = None
    author_approx: str | None = None
    title_approx: str | None = None
    source_approx: str | None = None
    trigram_limit: float = TRIGRAM_LIMIT
    in_json: bool = False  # equalities hold in the column or in the metadata; they don't reach the scan then


def member(values: Column, value: str) -> Column:
    """Case-insensitive membership in an array; false for a null array."""
    return F.coalesce(F.exists(values, lambda v: F.lower(v) == value.lower()), F.lit(False))


def column_or_json(column: str, key: str, value: str | int) -> Column:
    """Equal in the column or in the JSON."""
    return F.coalesce(F.col(column) == value, F.lit(False)) | F.coalesce(M.text_of(F.col("chunk_metadata"), key) == str(value), F.lit(False))


def approx(text: Column, query: str, limit: float = TRIGRAM_LIMIT) -> Column:
    return X.similarity(text, query) >= limit


def conditions(f: Filters) -> list[Column]:
    """All conditions on chunks; source_approx is a semi-join, see where()."""
    plain = [k for k in ("type", "jurisdiction", "subjurisdiction", "database", "year") if getattr(f, k) is not None]
    out = [column_or_json(f"md_{k}", k, getattr(f, k)) if f.in_json else F.col(f"md_{k}") == getattr(f, k) for k in plain]
    if f.types is not None:
        out.append(F.col("md_type").isin(*f.types))
    if not f.both_dates or (f.date_from and f.date_to):
        if f.date_from:
            out.append(F.col("md_date") >= F.lit(datetime.date.fromisoformat(f.date_from)))
        if f.date_to:
            out.append(F.col("md_date") <= F.lit(datetime.date.fromisoformat(f.date_to)))
    out += [column_or_json(f"md_{k}", k, v) for k in ("title", "author", "citation") if (v := getattr(f, k)) is not None]
    out += [member(F.col(c), v) for c, v in (("md_countries", f.country_member), ("md_titles", f.title_member), ("md_citations", f.citation_member)) if v is not None]
    out += [approx(F.col(c), v, f.trigram_limit) for c, v in (("md_author_lc", f.author_approx), ("md_title_lc", f.title_approx)) if v is not None]
    return out


def where(chunks: DataFrame, f: Filters, documents: DataFrame | None = None) -> DataFrame:
    """Chunks that meet all given predicates; plain equalities and ranges come first and reach the scan."""
    c = conditions(f)
    out = chunks.where(reduce(Column.__and__, c)) if c else chunks
    if f.source_approx is not None:
        if documents is None:
            raise ValueError("source_approx needs the documents")
        sources = documents.select("source").distinct().where(approx(F.lower("source"), f.source_approx.lower(), f.trigram_limit))
        out = out.join(documents.join(sources, "source", "left_semi").select("doc_id"), "doc_id", "left_semi")
    return out


def located(field: str, metadata: Column, columns: Sequence[str]) -> Column:
    """A metadata field at the top level, or else inside the JSON."""
    inner = M.text_of(metadata, field)
    return F.coalesce(F.col(field).cast("string"), inner) if field in columns else inner


def boolean(must: Sequence[Column] = (), should: Sequence[Column] = (), must_not: Sequence[Column] = (), filters: Sequence[Column] = (), minimum_should_match: int | None = None) -> Column:
    """A boolean query: all of must and filters, none of must_not, and at least so many of should (by default one, if
    there is neither must nor filter). A null condition counts as not met."""
    met = [F.coalesce(c, F.lit(False)) for c in (*must, *filters)] + [~F.coalesce(c, F.lit(False)) for c in must_not]
    least = minimum_should_match if minimum_should_match is not None else int(bool(should) and not must and not filters)
    if should and least:
        met.append(reduce(Column.__add__, [F.coalesce(c, F.lit(False)).cast("int") for c in should]) >= least)
    return reduce(Column.__and__, met) if met else F.lit(True)


def key_present(metadata: Column, key: str) -> Column:
    """A top-level key is there, even with the value null."""
    return F.array_contains(F.json_object_keys(metadata), key)
