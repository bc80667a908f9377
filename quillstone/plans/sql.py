"""Pieces of SQL that the checking queries share."""

from __future__ import annotations

import math

#: A fixed query vector.
QUERY = [round(math.sin(0.7 * i + 1), 6) for i in range(64)]
QUERY_SQL = "[" + ", ".join(f"{x:.6f}" for x in QUERY) + "]::double[]"

USABLE = "vector is not null and len(vector) = 64 and not list_bool_or(list_transform(vector, lambda x: isnan(x))) and list_max(list_transform(vector, lambda x: abs(x))) > 0"


def json(key: str) -> str:
    return f"json_extract_string(chunk_metadata, '$.{key}')"


EMB = f"""emb as (select id, doc_id, chunk_index, vector, md_type, md_database, md_date, md_year, chunk_metadata, created_at,
  {json("jurisdiction")} as md_jurisdiction, {json("subjurisdiction")} as md_subjurisdiction, {json("title")} as md_title, {json("url")} as md_url,
  coalesce(lower({json("title")}), '') as md_title_lc, cast(json_extract_string(chunk_metadata, '$.citations[*]') as varchar[]) as md_citations
  from chunk_embeddings)"""
VEC = f"vec as (select *, round(1 - list_cosine_similarity(cast(vector as double[]), {QUERY_SQL}), 6) as distance from emb where {USABLE})"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def trigrams(x: str) -> str:
    return f"list_distinct(flatten(list_transform({words(x)}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def similarity(x: str, query: str) -> str:
    from quillstone.functions.text import query_trigrams

    q = query_trigrams(query)
    literal = "[" + ", ".join("'" + g.replace("'", "''") + "'" for g in q) + "]"
    common = f"len(list_intersect({trigrams(x)}, {literal}))"
    return f"case when {x} is null then null else coalesce({common} / nullif(cast(len({trigrams(x)}) + {len(q)} - {common} as double), 0), 0.0) end"


def bucket_sql(database: str = "md_database") -> str:
    """CTE bk (doc_id, bucket) over emb."""
    kind = "case lower(trim(md_type)) when 'case' then 'cases' when 'treaty' then 'treaties' when 'journal' then 'journals' when 'article' then 'journals' when 'legislation' then 'legislation' when 'act' then 'legislation' when 'regulation' then 'legislation' end"
    return f"""bk as (select doc_id, case when bool_or(coalesce(lower(trim({database})) = 'hca', false)) then 'hca' else coalesce(arg_min(kind, id) filter (where kind is not null),
  case when bool_or(coalesce(contains(lower(md_url), '/hca/'), false)) then 'hca' end, 'cases') end as bucket from (select *, {kind} as kind from emb where doc_id is not null) group by doc_id)"""


#: Chunks as search sees them; needs emb.
HITS = bucket_sql() + f""",
hits as (select *, substr(content, 1, 500) as text_preview, array_to_string(citations, ' ') as cited from (
  select e.id, e.doc_id, e.chunk_index, e.md_type, coalesce(bucket, 'cases') as prod_bucket, e.md_title as title, e.md_citations as citations, e.md_url, e.chunk_metadata as chunk_metadata_text, d.source, d.url, d.format, d.text as whole,
  case when try_cast({json('end_char').replace('chunk_metadata', 'e.chunk_metadata')} as integer) > try_cast({json('start_char').replace('chunk_metadata', 'e.chunk_metadata')} as integer)
    then substr(d.text, try_cast({json('start_char').replace('chunk_metadata', 'e.chunk_metadata')} as integer) + 1, try_cast({json('end_char').replace('chunk_metadata', 'e.chunk_metadata')} as integer) - try_cast({json('start_char').replace('chunk_metadata', 'e.chunk_metadata')} as integer)) end as content
  from emb e left join documents d using (doc_id) left join bk using (doc_id)))"""
DOCS = "(select doc_id, text as content, title, format, lang from documents)"


def bm25(fields: dict[str, float], query: str, operator: str = "or", tie: float = 0.0, where: str = "true", name: str = "bm25", table: str = DOCS, key: str = "doc_id") -> str:
    """CTEs that end in `name` (key, score). Statistics are over the whole table; `where` only filters."""
    import re

    terms_of = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    cols, stats, hits, scores = [], [], [], []
    for f, boost in fields.items():
        cols.append(f"{words(f"coalesce({f}, '')")} as w_{f}")
        tf = [f"len(list_filter(w_{f}, lambda w: w = '{q}'))" for q in terms_of]
        stats.append(f"avg(len(w_{f})) as avg_{f}")
        stats += [f"sum(cast({t} > 0 as integer)) as df_{f}_{i}" for i, t in enumerate(tf)]
        hits.append("(" + (" and " if operator == "and" else " or ").join(f"{t} > 0" for t in tf) + ")")
        terms = " + ".join(f"ln(1 + (n - df_{f}_{i} + 0.5) / (df_{f}_{i} + 0.5)) * {t} * 2.2 / ({t} + 1.2 * (0.25 + 0.75 * len(w_{f}) / avg_{f}))" for i, t in enumerate(tf))
        scores.append(f"{boost} * (case when {hits[-1]} then {terms} else 0 end)")
    best = f"greatest({', '.join(scores)})" if len(scores) > 1 else scores[0]
    score = f"{best} + {tie} * ({' + '.join(scores)} - {best})" if tie else best
    return f"docs_{name} as (select *, {', '.join(cols)} from {table}), stats_{name} as (select count(*) as n, {', '.join(stats)} from docs_{name}), {name} as (select {key}, {score} as score from docs_{name}, stats_{name} where ({' or '.join(hits)}) and {where})"


def forms(*of: str) -> str:
    """A list of the words of a stem."""
    return "(" + ", ".join(f"'{w}'" for w in of) + ")"


def full_text(text: str, table: str, key: str, *stems: str, name: str = "fts") -> str:
    """CTEs that end in `name` (key, rank): documents with all stems, each given as its word forms."""
    places = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: w[i] in {f})[1:256] as p{i}" for i, f in enumerate(stems))
    every = " and ".join(f"len(p{i}) > 0" for i in range(len(stems)))
    base = f"w_{name} as (select {key}, {words(f"coalesce({text}, '')")} as w from {table}), p_{name} as (select {key}, {places} from w_{name}), m_{name} as (select * from p_{name} where {every})"
    if len(stems) == 1:
        return f"{base}, {name} as (select {key}, list_sum(list_transform(range(1, len(p0) + 1), lambda j: 0.1 / (j * j))) / 1.64493406685 as rank from m_{name})"
    pairs = " union all ".join(f"select {key}, abs(least(x, 16383) - least(y, 16383)) as d from (select {key}, unnest(p{i}) as x, p{k} from m_{name}), unnest(p{k}) as u(y)" for i in range(len(stems)) for k in range(i))
    near = "sum(ln(1 - 0.1 * sqrt(1 / (1.005 + 0.05 * exp(d / 1.5 - 2))))) filter (where d between 1 and 100)"
    return f"{base}, {name} as (select {key}, greatest(1 - exp(coalesce({near}, 0)), 1e-20) as rank from ({pairs}) group by {key})"


def in_order(w: str, *of: str, slop: int = 0) -> str:
    """Whether a list of words holds the words in order, with at most `slop` others between them."""
    gap = rf"(?:[^ ]+ ){{0,{slop}}}" if slop else ""
    return f"regexp_matches(' ' || array_to_string({w}, ' ') || ' ', ' {(' ' + gap).join(of)} ')"
