"""Documents to normalised tables: one record per key with the first known attributes, and child rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import metadata as M
from quillstone.operators.joins import left_join_unique
from quillstone.runtime import maybe_broadcast, ship
from quillstone.sources import front_matter


def first_known(df: DataFrame, key: Sequence[str], attributes: Sequence[str], order: str) -> DataFrame:
    """One row of each key: of every attribute the first value by `order` that isn't null. Combined before the shuffle."""
    least = [F.min(F.when(F.col(a).isNotNull(), F.struct(F.col(order), F.col(a)))).getField(a).alias(a) for a in attributes]
    return df.groupBy(*key).agg(*least)


#: By what records of a type without a known address are the same (see records).
SAME_BY = {"legislation": ("title", "jurisdiction", "subjurisdiction", "year"), "journal": ("title", "jurisdiction", "subjurisdiction", "year"), "treaty": ("title", "jurisdiction", "subjurisdiction", "year")}
ATTRIBUTES = ("url", "jurisdiction", "subjurisdiction", "database", "date", "year", "title")


def typed(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of documents with `kind`: the stated type, or else what the document's text looks like (see doc_type)."""
    stated = F.nullif(F.lower(F.trim("md_type")), F.lit(""))
    unknown = chunks.where(stated.isNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    texts = documents.join(maybe_broadcast(unknown), "doc_id", "left_semi")  # only these texts are looked at
    kinds = texts.select("doc_id", M.doc_type(F.lit(None).cast("string"), F.col("content")).alias("_seen"))
    return chunks.join(maybe_broadcast(kinds), "doc_id", "left").withColumn("kind", F.coalesce(stated, "_seen", F.lit("txt"))).drop("_seen")


def keyed(chunks: DataFrame, md_type: str, kind: str = "md_type", order: str = "id") -> DataFrame:
    """Chunks of a type with `record`: the least `order` of the chunks that are the same record. Chunks with the same url
    are one record, and those of a document without one; records whose attributes named in SAME_BY are all the same, with
    at least one known, are one, too (cases are told apart by url alone: a court has many)."""
    rows = chunks.where((F.col(kind) == md_type) & F.col("doc_id").isNotNull()).withColumn("key", F.coalesce("md_url", F.concat(F.lit("doc"), F.col("doc_id").cast("string"))))
    heads = rows.groupBy("key").agg(F.min(order).alias("head"), *[F.min(F.when(F.col(f"md_{c}").isNotNull(), F.struct(F.col(order), F.col(f"md_{c}"))))[f"md_{c}"].alias(c) for c in SAME_BY.get(md_type, ())])
    same = SAME_BY.get(md_type, ())
    if same:
        known = F.coalesce(*[F.col(c).cast("string") for c in same]).isNotNull()
        first = heads.where(known).groupBy(*same).agg(F.min("head").alias("record"))
        heads = heads.join(first, reduce(Column.__and__, [heads[c].eqNullSafe(first[c]) for c in same]), "left").select("key", F.coalesce("record", "head").alias("record"))
    else:
        heads = heads.withColumnRenamed("head", "record")
    return left_join_unique(rows, heads.select("key", "record"), "key")


def records(chunks: DataFrame, md_type: str, kind: str = "md_type", order: str = "id") -> DataFrame:
    """(record_id, url, jurisdiction, subjurisdiction, database, date, year, title) of one type, one row per record (see
    keyed): of each attribute the first that is known, so that later chunks fill only what is missing."""
    rows = keyed(chunks, md_type, kind, order)
    out = first_known(rows, ["record"], [f"md_{c}" for c in ATTRIBUTES], order)
    return out.select(M.stable_id(F.concat(F.lit(f"{md_type}:"), F.col("record").cast("string"))).alias("record_id"), *[F.col(f"md_{c}").alias(c) for c in ATTRIBUTES])


def children(chunks: DataFrame, md_type: str, values: Column, name: str, kind: str = "md_type", order: str = "id") -> DataFrame:
    """(record_id, name): distinct trimmed values of an array column, such as citations, names, authors or countries, by
    record; blank ones are left out."""
    rows = keyed(chunks, md_type, kind, order)
    return rows.select(M.stable_id(F.concat(F.lit(f"{md_type}:"), F.col("record").cast("string"))).alias("record_id"), F.explode(values).alias(name)).select("record_id", F.trim(name).alias(name)).where(F.col(name) != "").distinct()


def citation_key(citation: Column) -> Column:
    """Citations that differ in case and spacing only have one key."""
    return F.trim(F.regexp_replace(F.upper(citation), r"\s+", " "))


def new_rows(incoming: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Insert-if-absent: incoming rows, one per key, whose key isn't there; null keys are equal to each other."""
    one = incoming.dropDuplicates(list(key))
    same = [one[k].eqNullSafe(existing[k]) for k in key]
    return one.join(existing.select(*key), same, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Existing rows but for those whose key comes in, and the newest incoming row of each key."""
    newest = incoming.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
    return existing.join(newest.select(*key), list(key), "left_anti").unionByName(newest)


def sections(spark: SparkSession, documents: DataFrame, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """(doc_id, identifier, section_type, title, content) of each dashed section with a body. identifier is its section,
    identifier or chunk_id, title its title or section_title; section_type is stated or read from the title. The same
    identifier and title of a document once, the first that comes, blanks and nulls being equal. Null and blank texts
    have none."""
    ship(spark)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                seen = set()
                for head, body in front_matter.sections(text):
                    first = lambda *keys: next((str(head[k]) for k in keys if head.get(k) not in (None, "")), None)  # noqa: E731, B023
                    identifier, title = first("section", "identifier", "chunk_id"), first("title", "section_title")
                    if head and body and (identifier, title) not in seen:
                        seen.add((identifier, title))
                        rows.append((i, identifier, first("type"), title, body))
            at = pa.array([r[0] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2, 3, 4))], names=["doc_id", "identifier", "stated", "title", "content"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.mapInArrow(run, f"doc_id {kind}, identifier string, stated string, title string, content string")
    return found.select("doc_id", "identifier", F.coalesce("stated", M.section_type(F.coalesce("title", F.lit("")))).alias("section_type"), "title", "content")


def names(title: Column, titles: Column) -> Column:
    """The distinct names of a record: its title, other titles, and the name `A v B` in its title."""
    empty = F.array().cast("array<string>")
    v = M.parties(title)
    every = F.concat(F.when(title.isNotNull(), F.array(title)).otherwise(empty), F.coalesce(titles, empty), F.when(v.isNotNull(), F.array(v)).otherwise(empty))
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x != ""))
