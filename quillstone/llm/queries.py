"""The queries of this subpackage, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bpe, lines, mixing, near_duplicates, neighbours, quality, split
from quillstone.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(spark, table(spark, d, "documents"))[1].select("doc_id", "line_no")


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return lines.without_lines(spark, documents, lines.repeated_lines(spark, documents)[0])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split.cut_kinds(split.split_documents(spark, table(spark, d, "documents"), with_text=False, both_sides=True))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_documents(spark, table(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(spark, table(spark, d, "chunk_embeddings"))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunk_embeddings")
    found = neighbours.most_similar(spark, chunks, queries=chunks["id"] % 50 == 0)
    return found.withColumn("cosine", F.round("cosine", 6))


def _near(spark: SparkSession, d: str) -> near_duplicates.NearDuplicates:
    return near_duplicates.near_duplicates(spark, table(spark, d, "documents"), words=3, similarity=0.5)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).pairs()


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).classes()


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).groups()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(spark, table(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(spark, table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(spark, table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_types(spark, table(spark, d, "documents")).where("text_type = 'other'").select("doc_id")


def p8_types(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_types(spark, table(spark, d, "documents"))


def p8_accuracies(spark: SparkSession, d: str) -> DataFrame:
    return quality.typed(spark, table(spark, d, "documents"))[1]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_pieces, p3_found, p3_neighbours, p5_found, p5_classes, p5_groups, p6_ids, p7_mix, p7_shares, p8_found, p8_types, p8_accuracies)}

#: p1: RE2 classes, as the operator's Python has them; lines are numbered from 0.
_P1_LINES = r"""
with docs as (select doc_id, source, text from documents where source is not null and text is not null),
lines as (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from docs),
keyed as (select doc_id, source, line_no, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') as key from lines),
named as (select * from keyed where regexp_matches(key, '\p{L}')),
found as (select source, key from (select source, key, count(distinct doc_id) as n from named group by all) join (select source, count(*) as d from docs group by all) using (source) where n >= 5 and n * 100 >= 15 * d)
"""

#: p5: an inverted index of word triples; RE2 classes as above.
_P5_LINKS = r"""
with words as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from documents where text is not null),
sets as (select doc_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s from words where len(w) >= 20),
flat as (select doc_id, len(s) as n, unnest(s) as g from sets)
"""

#: p3: every pair compared. Ranks below the least cosine don't matter, as all better neighbours are above it.
_P3_FOUND = """
with v as (select id, cast(vector as double[]) as v from chunk_embeddings where vector is not null and len(vector) = 64
  and not list_bool_or(list_transform(vector, lambda x: isnan(x))) and list_max(list_transform(vector, lambda x: abs(x))) > 0),
near as (select a.id as a, b.id as b, list_cosine_similarity(a.v, b.v) as c from v a join v b on a.id <> b.id where list_cosine_similarity(a.v, b.v) >= 0.9),
ranked as (select a, b, row_number() over (partition by a order by c desc, b) as r from near)
select distinct least(a, b) as id_a, greatest(a, b) as id_b from ranked where r <= 10
"""

#: p3: the same for the asked rows without a least cosine. Exact; the query is so, too, where it probes all cells.
_P3_NEIGHBOURS = _P3_FOUND[: _P3_FOUND.index("near as")] + """near as (select a.id as id, b.id as neighbour, list_cosine_similarity(a.v, b.v) as c from v a join v b on a.id <> b.id and a.id % 50 = 0)
select id, neighbour, round(c, 6) as cosine, cast(row_number() over (partition by id order by round(c, 12) desc, neighbour) as integer) as rank from near qualify rank <= 10
"""

#: p2: boundaries become one sign; the parts between them are measured.
_P2_FOUND = r"""
with cut as (select doc_id, regexp_replace(regexp_replace(text, '([.!?])[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '\1' || chr(1), 'g'),
  '[\n\r\x{0b}\x{0c}\x{85}\x{2028}\x{2029}]', chr(1), 'g') as t from documents where length(text) > 4000)
select doc_id, case when list_max(list_transform(string_split(t, chr(1)), lambda x: length(x))) > 3800 then 'forced' else 'natural' end as cut from cut
"""
#: p2: characters one by one; each boundary with its end and strength; then cut after cut by recursion.
_P2_PIECES = r"""
with recursive docs as (select doc_id, text, length(text) as n, string_split(text, '') as chars from documents where length(text) > 4000),
listed as (select doc_id, n, unnest(chars) as c, generate_subscripts(chars, 1) as i from docs),
around as (select *, lag(c) over w as p, lead(c) over w as q, lead(c, 2) over w as r from listed window w as (partition by doc_id order by i)),
kinds as (select *, {b} as is_break, c = chr(13) and coalesce(q, '') = chr(10) as two, {pb} as after_break, coalesce(p, '') in ('.', '!', '?') as after_stop from around),
cuts as (select doc_id, i + cast(two as integer) as pos, case when not is_break then 1 when p is null or after_break or coalesce(case when two then {rb} else {qb} end, false) then 3 when after_stop then 2 else 1.5 end as strength
  from kinds where (is_break and not (c = chr(10) and coalesce(p, '') = chr(13))) or (not is_break and after_stop and regexp_matches(c, '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]'))),
steps as (
  select doc_id, n, -1 as k, 0 as cut, 0 as e from docs
  union all
  select doc_id, n, k + 1, e, case when n - e <= 3800 then n else coalesce(
    (select arg_max(c.pos, c.strength * 1e9 + c.pos) from cuts c where c.doc_id = s.doc_id and c.pos between s.e + 1900 and s.e + 3800),
    (select arg_max(c.pos, c.strength * 1e9 + c.pos) from cuts c where c.doc_id = s.doc_id and c.pos between s.e + 1 and s.e + 3800), e + 3800) end
  from steps s where k = -1 or e < n
)
select doc_id, cast(k as integer) as chunk_index, cast(greatest(0, cut - 200) as bigint) as start_char, cast(e as bigint) as end_char,
  case when e < s.n and not exists (select 1 from cuts c where c.doc_id = s.doc_id and c.pos = s.e) then 'forced' else 'natural' end as cut,
  substr(text, greatest(0, cut - 200) + 1, e - greatest(0, cut - 200)) as text
from steps s join docs using (doc_id) where k >= 0
"""
_BREAK = "({x} in (chr(10), chr(11), chr(12), chr(13), chr(133), chr(8232), chr(8233)))"
_P2_PIECES = _P2_PIECES.format(b=_BREAK.format(x="c"), pb=_BREAK.format(x="coalesce(p, '')"), qb=_BREAK.format(x="q"), rb=_BREAK.format(x="r"))
_P1_CLEAN = r"""
, every as (select doc_id, source, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents where text is not null),
marked as (select e.doc_id, e.line, e.line_no, exists (select 1 from named n join found f using (source, key) where n.doc_id = e.doc_id and n.line_no = e.line_no) as gone from every e)
select doc_id, coalesce(string_agg(line, chr(10) order by line_no) filter (where not gone), '') as text, cast(count(*) filter (where gone) as integer) as removed from marked group by doc_id
union all select doc_id, null, null from documents where text is null
"""
_P5_CLASSES = """
, keyed as (select doc_id, list_sort(s) as s from sets), classes as (select s, min(doc_id) as class_id, count(*) as copies from keyed group by s),
reps as (select class_id, len(s) as n, unnest(s) as g from classes),
links as (select a.class_id as a, b.class_id as b from reps a join reps b on a.g = b.g and a.class_id <> b.class_id group by a.class_id, b.class_id having count(*) >= 0.5 * (any_value(a.n) + any_value(b.n) - count(*)))
select doc_id, class_id, copies, (select count(*) from links where a = class_id) as links from keyed join classes using (s)
"""
_P5_GROUPS = """
, edges as (select a.doc_id as a, b.doc_id as b from flat a join flat b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id having count(*) >= 0.5 * (any_value(a.n) + any_value(b.n) - count(*))),
reach as (select doc_id as a, doc_id as b from sets union select reach.a, edges.b from reach join edges on reach.b = edges.a)
select a as doc_id, min(b) as group_id from reach group by a
"""

ORACLES: dict[str, str] = {
    "p1_clean": _P1_LINES + _P1_CLEAN,
    "p2_found": _P2_FOUND,
    "p2_pieces": _P2_PIECES,
    "p5_classes": _P5_LINKS + _P5_CLASSES,
    "p5_groups": _P5_LINKS.replace("with words", "with recursive words") + _P5_GROUPS,
    "p3_found": _P3_FOUND,
    "p3_neighbours": _P3_NEIGHBOURS,
    "p5_found": _P5_LINKS + "select a.doc_id as doc_id_a, b.doc_id as doc_id_b from flat a join flat b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id having count(*) >= 0.5 * (any_value(a.n) + any_value(b.n) - count(*))",
    "p1_found": _P1_LINES + "select doc_id, cast(line_no as integer) as line_no from named join found using (source, key)",
}
