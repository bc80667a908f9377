"""Expressions on metadata: keys, ids, dates, types by content and path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metadata keys that are kept, with their limits.
KEPT_KEYS = ("url", "citation", "title", "jurisdiction", "subjurisdiction", "court", "date", "year", "database", "author", "judge", "bench", "section", "chapter", "part", "division", "act", "regulation", "type", "source")
MOST_KEYS, MOST_CHARS, KEY_CHARS = 32, 500, 64
#: Keys under which citations come, in the order in which they are read.
CITATION_KEYS = ("md_citations", "citations", "mdCitation", "md_citation", "citation")
#: The four kinds of documents.
TYPES = ("case", "legislation", "journal", "treaty")


def text_of(metadata: Column, key: str) -> Column:
    """The value of a top-level key as text; null where it is absent or null."""
    return F.get_json_object(metadata, f"$.{key}")


def list_of(metadata: Column, key: str) -> Column:
    return F.from_json(text_of(metadata, key), "array<string>")


def md_date(value: Column) -> Column:
    """The date in front of the first space, if it is yyyy-mm-dd and exists; else null."""
    token = F.split_part(value, F.lit(" "), F.lit(1))
    return F.when(token.rlike(r"^\d{4}-\d{2}-\d{2}"), F.to_date(F.try_to_timestamp(F.substring(token, 1, 10), F.lit("yyyy-MM-dd"))))


def md_year(value: Column) -> Column:
    return F.when(value.rlike("^[0-9]{1,6}$"), value.cast("int"))


def parse_date(value: Column) -> Column:
    """yyyy-mm-dd..., dd-mm-yyyy..., or a year alone (its first day); else null."""
    v = F.trim(value)

    def to(text: Column, pattern: str) -> Column:
        return F.to_date(F.try_to_timestamp(text, F.lit(pattern)))

    return (
        F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), to(F.substring(v, 1, 10), "yyyy-MM-dd"))
        .when(v.rlike(r"^\d{2}-\d{2}-\d{4}"), to(F.substring(v, 1, 10), "dd-MM-yyyy"))
        .when(v.rlike(r"^\d{4}$"), to(F.concat(v, F.lit("-01-01")), "yyyy-MM-dd"))
    )


def normalise_date(value: Column) -> Column:
    """yyyy-mm-ddThh:mm:ssZ of several spellings; null where none fits."""
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd-MM-yyyy", "yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX")
    at = F.coalesce(*[F.try_to_timestamp(F.trim(value), F.lit(f)) for f in formats])
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def long_date(value: Column) -> Column:
    """`4 June 1998`, in any case, as a date."""
    return F.to_date(F.try_to_timestamp(F.initcap(F.trim(value)), F.lit("d MMMM yyyy")))


def stable_id(seed: Column) -> Column:
    """A 60-bit id: the first 15 hexadecimal digits of the seed's SHA-1."""
    return F.conv(F.substring(F.sha1(seed), 1, 15), 16, 10).cast("bigint")


def doc_key(source: Column, index: Column, text: Column) -> Column:
    return F.sha1(F.concat_ws("|", source, index.cast("string"), text))


def emb_key(key: Column, index: Column) -> Column:
    return F.sha1(F.concat_ws("|", key, index.cast("string")))


def sanitise_key(key: Column) -> Column:
    """Letters, digits, _ and - only; runs of _ made one, _ and - dropped at the ends; k_ before a digit; at most KEY_CHARS
    characters; null where nothing is left."""
    k = F.regexp_replace(F.regexp_replace(F.trim(key), r"[^A-Za-z0-9_-]+", "_"), "_+", "_")
    k = F.nullif(F.regexp_replace(k, "^[_-]+|[_-]+$", ""), F.lit(""))
    return F.substring(F.when(k.rlike("^[0-9]"), F.concat(F.lit("k_"), k)).otherwise(k), 1, KEY_CHARS)


def sanitise(metadata: Column) -> Column:
    """A map of the kept keys (cleaned, compared in lower case) in order, at most MOST_KEYS; of keys that become equal the
    last counts. Numbers and truth values are their text; lists and objects their JSON, cut to MOST_CHARS; year is its
    first number of 18xx to 20xx that stands alone, and is left out without one. Other JSON than an object gives `raw`."""

    def clean(key: Column) -> Column:
        """As sanitise_key, null for most keys that aren't kept; keys that are clean already pass no pattern."""
        return F.when(F.lower(key).isin(*KEPT_KEYS), key).when(key.rlike(r"[^A-Za-z0-9_-]|^[_-]|[_-]$"), sanitise_key(key))

    entries = F.transform(F.map_entries(F.from_json(metadata, "map<string,string>")), lambda e: F.struct(clean(e["key"]).alias("k"), e["value"].alias("v")))

    def value(e: Column) -> Column:
        nested = e["v"].rlike(r"(?s)^\s*[\[{]") & (F.json_array_length(e["v"]).isNotNull() | F.json_object_keys(e["v"]).isNotNull())
        year = F.nullif(F.regexp_extract(e["v"], r"\b((?:18|19|20)\d{2})\b", 1), F.lit(""))
        return F.when(F.lower(e["k"]) == "year", year).when(nested, F.substring(e["v"], 1, MOST_CHARS)).otherwise(e["v"])

    kept = F.filter(entries, lambda e: F.coalesce(F.lower(e["k"]).isin(*KEPT_KEYS), F.lit(False)))
    kept = F.filter(F.transform(kept, lambda e: F.struct(e["k"].alias("k"), value(e).alias("v"))), lambda e: (F.lower(e["k"]) != "year") | e["v"].isNotNull())
    add = lambda m, e: F.when(F.size(m) < MOST_KEYS, F.map_concat(F.map_filter(m, lambda k, v: k != e["k"]), F.map_from_arrays(F.array(e["k"]), F.array(e["v"])))).otherwise(m)
    found = F.aggregate(kept, F.create_map().cast("map<string,string>"), add)
    some = F.get(F.filter(F.array(found), lambda m: F.size(m) > 0), F.lit(0))
    raw = F.when(metadata.isNotNull() & F.json_object_keys(metadata).isNull(), F.create_map(F.lit("raw"), F.substring(metadata, 1, MOST_CHARS)))
    return F.coalesce(some, raw)


def citations(metadata: Column) -> Column:
    """The distinct citations of all CITATION_KEYS, trimmed, in order: each key holds one or a list."""

    lists = F.from_json(metadata, ", ".join(f"{k} array<string>" for k in CITATION_KEYS))  # null for what is no list

    def under(key: str) -> Column:
        v = text_of(metadata, key)
        return F.coalesce(lists[key], F.when(v.isNotNull(), F.array(v)), F.array().cast("array<string>"))

    every = F.transform(F.concat(*map(under, CITATION_KEYS)), lambda c: F.trim(c))
    return F.array_distinct(F.filter(every, lambda c: c.isNotNull() & (c != "")))


def as_int(value: Column) -> Column:
    return F.trim(value).try_cast("int")


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes", "y", "on"), F.lit(False))


def authors(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, "[;,]"), lambda a: F.trim(a)), lambda a: a != "")


def parties(title: Column) -> Column:
    """The name `A v B` in a title, both parties beginning with a capital; null where there is none."""
    side = r"[A-Z][A-Za-z0-9.\-& ]+"
    m = rf"({side})\s+v\s+({side})"
    return F.when(title.rlike(m), F.concat(F.trim(F.regexp_extract(title, m, 1)), F.lit(" v "), F.trim(F.regexp_extract(title, m, 2))))


def case_heading(line: Column) -> Column:
    """`Names [2001] ABC 12; (2001) 3 DEF 4 (4 June 1998)` as (names, citations, date): names and citations are divided by
    semicolons; after each citation comes the same without its leading year; date is `yyyy-MM-dd 00:00:00`, or as it was
    where it can't be read. Null where the line has another form. The five named characters of HTML are resolved."""
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        line = F.replace(line, F.lit(code), F.lit(char))
    m = r"^(.+)(\[\d{4}\].*)\((\d{1,2} \w+ \d{4})\)$"
    names = F.transform(F.split(F.trim(F.regexp_extract(line, m, 1)), ";"), lambda n: F.trim(n))
    each = F.transform(F.split(F.regexp_extract(line, m, 2), ";"), lambda c: F.trim(c))
    bare = lambda c: F.trim(F.regexp_replace(c, r"^(?:\[\d{4}\]|\(\d{4}\))", ""))
    cited = F.flatten(F.transform(each, lambda c: F.when(bare(c) != c, F.array(c, bare(c))).otherwise(F.array(c))))
    raw = F.regexp_extract(line, m, 3)
    date = F.coalesce(F.date_format(long_date(raw), "yyyy-MM-dd 00:00:00"), raw)
    return F.when(line.rlike(m), F.struct(names.alias("names"), cited.alias("citations"), date.alias("date")))


def canonical_url(path: Column, base: str = "", prefix: str = "") -> Column:
    """The address of a converted file: prefix, base and path, as .html in place of .txt."""
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\.txt$", ".html")
    base = base.replace("\\", "/").strip("/")
    return F.concat(F.lit(f"{prefix}/{base}/" if base else f"{prefix}/"), F.regexp_replace(clean, "^/+", ""))


def place_of(path: Column) -> Column:
    """(jurisdiction, court) of a path /au/cases/<jurisdiction>/<court> or /nz/cases/...; empty where it has another form."""
    parts = F.split(F.regexp_replace(path, "^/+", ""), "/")
    fits = (F.size(parts) >= 4) & parts[0].isin("au", "nz") & (parts[1] == "cases")
    return F.struct(F.when(fits, F.get(parts, F.lit(2))).otherwise("").alias("jurisdiction"), F.when(fits, F.get(parts, F.lit(3))).otherwise("").alias("court"))


def section_type(title: Column) -> Column:
    t = F.lower(title)
    return F.when(t.contains("schedule"), "schedule").when(t.contains("regulation") | t.contains("reg."), "regulation").otherwise("section")


#: Characters at the head of a text in which doc_type looks for parties and sections.
HEAD = 1000


def doc_type(md_type: Column, text: Column, head: int = HEAD) -> Column:
    """The stated type if it is case, legislation or journal, else by signs: parties or sections near the text's head, or
    numbered lines anywhere; else txt."""
    t = F.lower(F.substring(text, 1, head))
    return (
        F.when(F.lower(md_type).isin("case", "legislation", "journal"), F.lower(md_type))
        .when(t.contains(" v ") | t.contains(" appellant") | t.contains(" respondent"), "case")
        .when(t.contains(" section ") | t.rlike(r"\bs\.\s*\d"), "legislation")
        .when(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")).rlike(r"(?m)^(?:[ivxlcdm]+\.|\d+\.)"), "journal")
        .otherwise("txt")
    )


def path_type(path: Column) -> Column:
    """The bucket that a path's folders hint at; the first hint that occurs counts."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.when(p.contains("/hca/"), "hca").when(p.contains("/treat"), "treaties").when(p.contains("/journal"), "journals").when(p.contains("/legis"), "legislation").otherwise("cases")


#: The bucket of each stated type.
BUCKET_OF = {"case": "cases", "treaty": "treaties", "journal": "journals", "article": "journals", "legislation": "legislation", "act": "legislation", "regulation": "legislation"}


def type_bucket(md_type: Column) -> Column:
    """The bucket of a stated type; null for an unknown one."""
    t = F.lower(F.trim(md_type))
    return F.coalesce(*[F.when(t == k, v) for k, v in BUCKET_OF.items()])


def bucket(database: Column, md_type: Column, path: Column) -> Column:
    """Where one row goes: by database, then type, then a path that names hca; else cases."""
    hca = F.coalesce(F.lower(F.trim(database)) == "hca", F.lit(False))
    return F.when(hca, "hca").otherwise(F.coalesce(type_bucket(md_type), F.when(F.lower(path).contains("/hca/"), "hca"), F.lit("cases")))


def buckets(chunks: DataFrame, by: str, order: str = "id", path: str = "md_url") -> DataFrame:
    """(by, bucket) of each document, from all of its chunks: hca if any is of that database; else by the first chunk in
    order whose type is known; else hca if a path names it; else cases."""
    kind = type_bucket(F.col("md_type"))
    per = chunks.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.bool_or(F.coalesce(F.lower(F.trim("md_database")) == "hca", F.lit(False))).alias("high"),
        F.min(F.when(kind.isNotNull(), F.struct(F.col(order), kind.alias("kind"))))["kind"].alias("kind"),
        F.bool_or(F.coalesce(F.lower(path).contains("/hca/"), F.lit(False))).alias("named"),
    )
    return per.select(by, F.when(F.col("high"), "hca").when(F.col("kind").isNotNull(), F.col("kind")).when(F.col("named"), "hca").otherwise("cases").alias("bucket"))


def path_parts(path: Column) -> Column:
    """(parts, folders, file, year, extension, jurisdiction_guess, court_guess, series_guess) of a path. Folders that are
    years are left out of `folders` and of the guesses: the first part, the last folder, and the second and third part."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    is_year = lambda x: x.rlike(r"^(19|20)\d{2}$")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    years = F.filter(folders, is_year)
    plain = F.filter(parts, lambda x: ~is_year(x))
    name = F.try_element_at(parts, F.lit(-1))
    last = F.try_element_at(plain, F.lit(-1))
    court = F.when(F.size(plain) >= 2, F.when(last.contains("."), F.try_element_at(plain, F.lit(-2))).otherwise(last))
    return F.struct(
        parts.alias("parts"), F.filter(folders, lambda x: ~is_year(x)).alias("folders"), name.alias("file"), F.try_element_at(years, F.lit(-1)).cast("int").alias("year"),
        F.lower(F.nullif(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1), F.lit(""))).alias("extension"),
        F.lower(F.try_element_at(plain, F.lit(1))).alias("jurisdiction_guess"), court.alias("court_guess"),
        F.when(F.size(plain) >= 3, F.lower(F.array_join(F.slice(plain, 2, 2), "/"))).alias("series_guess"),
    )
