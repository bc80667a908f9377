"""Chunkers for retrieval: sentences merged to a token target, sections, paragraphs, windows, and their cascade.

These keep the meaning of a chunk together; the splitter by boundary strength for training data is another operator.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.runtime import ship, spread
from quillstone.sources.front_matter import sections

#: Token targets of a chunk, patterns of tokens, sentences and heading lines, and the keys of a document
#: that the header of a section never changes.
TARGET, OVERLAP, MOST, LEAST_SENTENCE, LEAST_CHUNK = 512, 64, 640, 6, 40
TOKEN = re.compile(r"\w+|[^\w\s]")
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z(])")
HEADING = re.compile(r"^\s*(?:[IVXLCDM]+\.?|\d+(?:\.\d+)*\.?|[A-Z][A-Z0-9 ]{2,}|Section\s+\d+[A-Za-z\-]*|s\.\s*\d+[A-Za-z\-]*)\b")
PROTECTED = frozenset("title year date type jurisdiction subjurisdiction database url ext filename rel_path rel_path_no_years path_parts path_parts_no_years dataset_root court_guess jurisdiction_guess series_guess".split())
#: Characters of the windows that the cascade ends in, and their overlap.
WINDOW, WINDOW_OVERLAP = 4000, 200
#: Legacy chunks: the most characters, and the least of a piece of a statute, article or case, and of other texts.
LEGACY_MOST, LEGACY_LEAST, OTHER_LEAST = 1500, 150, 50


def tokens(text: str) -> int:
    return len(TOKEN.findall(text))


def windows(text: Column, size: int = 4000, overlap: int = 200) -> Column:
    """Character windows as an array of (start, text), in pure expressions; nothing for null or empty text."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - overlap - 1), F.lit(size - overlap))
    return F.when(F.length(text) > 0, F.transform(starts, lambda s: F.struct(s.alias("start"), F.substr(text, s + 1, F.lit(size)).alias("text"))))


def hard_split(sentence: str, most: int) -> list[str]:
    """Pieces of whole words, each of at most `most` tokens; a word of more tokens is cut itself."""
    out, line, n = [], [], 0
    for word in sentence.split():
        k = tokens(word)
        if k > most:
            parts = TOKEN.findall(word)
            if line:
                out.append(" ".join(line))
                line, n = [], 0
            out += ["".join(parts[i : i + most]) for i in range(0, len(parts), most)]
            continue
        if n + k > most:
            out.append(" ".join(line))
            line, n = [], 0
        line.append(word)
        n += k
    return out + [" ".join(line)] if line else out


def merged_sentences(text: str, target: int = TARGET, overlap: int = OVERLAP, most: int = MOST, least_sentence: int = LEAST_SENTENCE, least_chunk: int = LEAST_CHUNK) -> list[str]:
    """Sentences merged up to the target, beginning with the last sentences of the chunk before, up to the overlap. An
    overlap that would leave no room for the next sentence is dropped, so that every step makes progress. Sentences
    over `most` tokens are cut at words; tiny sentences are left out; a small last chunk joins the one before it if it
    fits, else it is dropped unless it is the only one."""
    parts = []
    for s in SENTENCE.split(text):
        s = s.strip()
        n = tokens(s)
        if n > most:
            parts += [(p, tokens(p)) for p in hard_split(s, most)]
        elif n >= least_sentence:
            parts.append((s, n))
    out, now, size, fresh = [], [], 0, 0
    for s, n in parts:
        if now and size + n > target and fresh:
            out.append((now, size))
            tail, k = [], 0
            for t, m in reversed(now):
                if k + m > overlap or k + m + n > target:
                    break
                tail.insert(0, (t, m))
                k += m
            now, size, fresh = tail, k, 0
        elif now and size + n > target:
            now, size = [], 0
        now.append((s, n))
        size += n
        fresh += 1
    if fresh:
        if size < least_chunk and out and out[-1][1] + size <= most:
            last, k = out.pop()
            add = now[-fresh:]
            out.append((last + add, k + sum(n for _, n in add)))
        elif size >= least_chunk or not out:
            out.append((now, size))
    return [" ".join(t for t, _ in chunk) for chunk, _ in out]


def headed_blocks(text: str, keep_headings: bool = True) -> list[tuple[str, str]]:
    """(heading, body) by heading lines: roman or plain numbers, Section, Part, or capitals. With keep_headings the body
    begins with its heading, so that numbered paragraphs lose nothing."""
    out, head, body = [], "", []
    for line in text.splitlines():
        if HEADING.match(line):
            if body or head:
                out.append((head, "\n".join(body).strip()))
            head, body = line.strip(), [line] if keep_headings else []
        else:
            body.append(line)
    out.append((head, "\n".join(body).strip()))
    return [(h, b) for h, b in out if b]


def semantic(text: str, **sizes) -> list[tuple[str, str]]:
    """(section, text): headed blocks, each merged from sentences; without any, the text as one block."""
    out = [(h, c) for h, b in headed_blocks(text) for c in merged_sentences(b, **sizes)]
    return out or [("", c) for c in merged_sentences(text, **sizes)]


def legislation(text: str, **sizes) -> list[tuple[str, str]]:
    """(section title, text) by dashed headers; nothing where a text has none."""
    return [(title, c) for title, c, _ in with_headers(text, **sizes)]


def with_headers(text: str, **sizes) -> list[tuple[str, str, dict]]:
    """(section title, text, fields) by dashed headers; fields are those of the header that a document doesn't keep for
    itself (PROTECTED)."""
    found = sections(text)
    if not any(h for h, _ in found):
        return []
    out = []
    for header, body in found:
        title = next((str(header[k]) for k in ("title", "section_title", "section") if header.get(k) not in (None, "")), "")
        fields = {k: v for k, v in header.items() if k not in PROTECTED}
        out += [(title, c, fields) for c in (merged_sentences(body, **sizes) or [body]) if body]
    return out


def recursive(text: str, most: int = 2000, overlap: int = 100, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces of at most `most` characters, cut at the first separator that occurs, and at the next ones inside what is
    still too long; neighbours are joined while they fit, and each piece repeats up to `overlap` characters."""
    if len(text) <= most:
        return [text] if text.strip() else []
    sep = next(s for s in separators if s in text)
    rest = separators[separators.index(sep) + 1 :]
    if sep == "":
        return [text[i : i + most] for i in range(0, len(text), most - overlap)]
    out, now = [], ""
    for part in text.split(sep):
        if len(now) + len(sep) + len(part) <= most if now else len(part) <= most:
            now = f"{now}{sep}{part}" if now else part
            continue
        if now:
            out.append(now)
        tail = now[-overlap:] if overlap and now else ""
        if len(part) > most:
            out += recursive(part, most, overlap, rest)
            now = ""
        else:
            now = f"{tail}{sep}{part}" if tail and len(tail) + len(sep) + len(part) <= most else part
    return [*out, now] if now.strip() else out


def packed(parts: Iterable[str], most: int, glue: str) -> list[str]:
    """Neighbours joined by `glue` while they stay within `most` characters; longer parts stay as they are, alone."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(glue) + len(p) <= most:
            out[-1] += glue + p
        else:
            out.append(p)
    return out


def paragraphs(text: str, most: int = LEGACY_MOST, least: int = OTHER_LEAST) -> list[str]:
    """Paragraphs packed to `most` characters; longer ones packed from their sentences, and those cut where they are
    longer still; pieces under `least` dropped unless nothing else is left."""
    out = []
    for block in packed((p.strip() for p in re.split(r"(?:\r?\n){2,}", text) if p.strip()), most, "\n\n"):
        if len(block) <= most:
            out.append(block)
            continue
        run: list[str] = []
        for sentence in re.split(r"(?<=[.?!]) +", block):
            if len(sentence) <= most:
                run.append(sentence)
            else:
                out += packed(run, most, " ") + [sentence[i : i + most].strip() for i in range(0, len(sentence), most)]
                run = []
        out += packed(run, most, " ")
    return [c for c in out if len(c) >= least] or out[:1]


#: A section of a statute and a heading of an article, as earlier loads wrote them.
LEGACY_SECTION = re.compile(r"-{5,}\s*\n\s*section:\s*([^\n]+)\n\s*title:\s*([^\n]+)\n-{5,}\s*\n(.*?)(?=(?:-{5,}\s*\n\s*section:)|\Z)", re.S | re.I)
LEGACY_HEADING = re.compile(r"^([IVXLCDM]+\.|[0-9]+\.|[A-Z]\.)\s+.*")


def by_kind(kind: str, text: str, most: int = LEGACY_MOST) -> list[tuple[str, str]]:
    """(section, text) by the kind of a document: sections of a statute, headed parts of an article, paragraphs of a case,
    each of at least LEGACY_LEAST characters. Where that gives nothing, or an article's part is too long, paragraphs of
    the whole text; where those are all too short, pieces of at least OTHER_LEAST."""
    kind = kind.strip().lower()
    long_enough = lambda t, least=LEGACY_LEAST: [p for p in paragraphs(t, most, 0) if len(p) >= least]
    found: list[tuple[str, str]] = []
    if kind == "legislation":
        found = [(m[2].strip() or m[1].strip(), p) for m in LEGACY_SECTION.finditer(text) for p in long_enough(m[3].strip())]
    elif kind == "journal":
        parts: list[tuple[str, list[str]]] = [("", [])]
        for line in map(str.strip, text.splitlines()):
            if LEGACY_HEADING.match(line):
                parts.append((line, [line + "\n"]))
            else:
                parts[-1][1].append(line + " ")
        found = [(h, t) for h, ls in parts if len(t := "".join(ls).strip()) >= LEGACY_LEAST]
        if any(len(t) > most for _, t in found):
            found = []
    if not found and kind in ("legislation", "journal", "case"):
        found = [(f"para_{i}", p) for i, p in enumerate(paragraphs(text, most, 0)) if len(p) >= LEGACY_LEAST]
    return found or [("", p) for p in long_enough(text, OTHER_LEAST)]


def cut_windows(text: str, size: int = WINDOW, overlap: int = WINDOW_OVERLAP) -> list[tuple[str, str, dict]]:
    """Windows of a text with their places; the last resort, which every text with a character passes."""
    return [("", text[i : i + size], {"start_char": i, "end_char": min(len(text), i + size), "fallback": True}) for i in range(0, len(text), max(1, size - overlap))]


Piece = tuple[str, str, dict]


def _plain(pieces: Iterable[tuple[str, str]]) -> list[Piece]:
    return [(h, c, {}) for h, c in pieces]


def pieces_of(text: str, strategy: str = "cascade") -> tuple[str, list[Piece]]:
    """(strategy, [(section, text, fields)]): `cascade` is dashed sections, else merged sentences, else recursive pieces,
    else windows; a blank text has none."""
    ways: dict[str, Callable[[str], list[Piece]]] = {
        "dashed": with_headers,
        "semantic": lambda t: _plain(semantic(t)),
        "recursive": lambda t: _plain(("", c) for c in recursive(t)),
        "windows": cut_windows,
        "paragraphs": lambda t: _plain(("", c) for c in paragraphs(t)),
    }
    if not text.strip():
        return "empty", []
    for name in ("dashed", "semantic", "recursive", "windows") if strategy == "cascade" else (strategy,):
        if found := ways[name](text):
            return name, found
    return "empty", []


def cascade(text: str) -> tuple[str, list[tuple[str, str]]]:
    name, found = pieces_of(text)
    return name, [(h, c) for h, c, _ in found]


STRATEGIES = ("cascade", "dashed", "semantic", "recursive", "windows", "paragraphs")


def metadata_of(base: str | None, found: list[Piece], name: str) -> list[str]:
    """The metadata of each chunk as JSON: the document's own (`raw` where that is no object), then what the section's
    header adds, then the chunk's."""
    try:
        own = json.loads(base) if base else {}
    except ValueError:
        own = base[:500]
    own = own if isinstance(own, dict) else {"raw": own}
    out, sections_, chunk_idx = [], -1, 0
    last: object = None
    for title, text, fields in found:
        if (title, id(fields)) != last:
            last, sections_, chunk_idx = (title, id(fields)), sections_ + 1, 0
        mine = {"section_title": title or None, "section_idx": sections_, "chunk_idx": chunk_idx, "tokens_est": tokens(text), "strategy": name}
        out.append(json.dumps({**own, **fields, **mine}, ensure_ascii=False, default=str))
        chunk_idx += 1
    return out


def chunk_by_kind(spark: SparkSession, documents: DataFrame, id_col: str = "doc_id", text_col: str = "content", kind_col: str = "kind") -> DataFrame:
    """(doc_id, chunk_index, section, text): chunks by the kind of each document (see by_kind). Null and blank texts give
    none. Narrow, in Arrow batches."""
    ship(spark)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(kind_col, F.lit("")).alias("kind")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, h, c) for i, (t, k) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())) for n, (h, c) in enumerate(by_kind(k, t))]
            at = pa.array([r[0] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string())], names=["doc_id", "chunk_index", "section", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return spread(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, chunk_index int, section string, text string")


def chunk(spark: SparkSession, documents: DataFrame, strategy: str = "cascade", id_col: str = "doc_id", text_col: str = "content", metadata_col: str | None = None) -> DataFrame:
    """(doc_id, chunk_index, section, text, tokens, strategy): the chunks of every text; with `metadata_col`, the JSON of
    the document, also chunk_metadata (see metadata_of). Null and blank texts give none. Narrow, in Arrow batches."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    ship(spark)
    base = F.lit(None).cast("string") if metadata_col is None else F.col(metadata_col)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), base.alias("base")).where("text is not null")
    docs = spread(docs, "doc_id") if not docs.isStreaming else docs
    names = ["doc_id", "chunk_index", "section", "text", "tokens", "strategy"] + ["chunk_metadata"] * (metadata_col is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                name, found = pieces_of(text, strategy)
                n = len(found)
                if n:
                    columns = [pa.array([batch.column(0)[i].as_py()] * n, batch.schema.field(0).type), pa.array(range(n), pa.int32()), pa.array([h for h, _, _ in found], pa.string()), pa.array([c for _, c, _ in found], pa.string()), pa.array([tokens(c) for _, c, _ in found], pa.int32()), pa.array([name] * n)]
                    if metadata_col is not None:
                        columns.append(pa.array(metadata_of(own, found, name), pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, chunk_index int, section string, text string, tokens int, strategy string" + ", chunk_metadata string" * (metadata_col is not None))
