"""HTML as text, by the standard parser."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

SKIPPED = frozenset(("script", "style", "nav", "header", "footer"))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        self.skip += tag in SKIPPED

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED and self.skip:
            self.skip -= 1

    def handle_data(self, data: str) -> None:
        if not self.skip and data.strip():
            self.parts.append(data.strip())


def to_text(html: str | None) -> str | None:
    """The text of a page, one line per text node, without scripts, styles and navigation. Null gives null."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "\n".join(parser.parts)


HEADING = re.compile(r"<h2[^>]*>(.*?)</h2>", re.I | re.S)
RULE = re.compile(r"<hr[^>]*>", re.I)


def case_page(html: str | None) -> tuple[str | None, str | None]:
    """(heading, text) of a page of one case: the first second-level heading, and what lies between the first and last
    rules. A page without two rules is taken as a whole."""
    if html is None:
        return None, None
    head = HEADING.search(html)
    rules = list(RULE.finditer(html))
    inner = html[rules[0].end() : rules[-1].start()] if len(rules) > 1 else html
    return (to_text(head[1]).replace("\n", " ") if head else None), to_text(inner)


#: What marks a page that only refers to another, or lists cases, with the notice that takes its place; the
#: form of a case's heading; the line before and after a header.
REFERENCE, REFERENCE_NOTICE = "Neutral Citation has changed", "Neutral Citation has changed: This file is a reference or redirect."
LIST, LIST_NOTICE = re.compile(r"High Court of Australia decisions beginning with ."), "This is a list-of-cases/index page."
CASE_TITLE = re.compile(r"^(.+)(\[\d{4}\].*)\((\d{1,2} \w+ \d{4})\)$")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
LINE = "-" * 35
SMALL = re.compile(r"<small[^>]*>.*?</small>", re.I | re.S)


def case_title(title: str) -> dict | None:
    """titles, citations (each also without its leading year) and date of a heading; None where it has another form."""
    found = CASE_TITLE.match(title)
    if not found:
        return None
    cited: list[str] = []
    for c in map(str.strip, found[2].split(";")):
        bare = re.sub(r"^(?:\[\d{4}\]|\(\d{4}\))", "", c).strip()
        cited += [c] if bare == c else [c, bare]
    day, month, year = found[3].split()
    date = f"{year}-{MONTHS.index(month) + 1:02}-{int(day):02} 00:00:00" if month in MONTHS else found[3]
    return {"titles": [t.strip() for t in found[1].split(";")], "citations": cited, "date": date}


def header(meta: dict) -> str:
    """Front matter of texts and lists, between dashed lines."""
    return "\n".join([LINE, *(f"{k}: {v}" for k, v in meta.items() if isinstance(v, (str, list))), LINE, ""])


def case_document(page: str | None, path: str, base: str = "", prefix: str = "") -> tuple[str | None, str | None, str | None]:
    """(status, metadata as JSON, document) of a page: `case` with a header and the text between the first two rules;
    `reference` or `list` with a notice before the whole text; `plain`, the whole text, where the heading can't be read.
    Null gives nulls."""
    if page is None:
        return None, None, None
    whole = to_text(page) or ""
    for status, there, notice in (("reference", REFERENCE in whole, REFERENCE_NOTICE), ("list", LIST.search(whole), LIST_NOTICE)):
        if there:
            return status, json.dumps({"notice": notice}), f"{notice}\n{whole}"
    rules = list(RULE.finditer(page))
    inner = page[rules[0].end() : rules[1].start() if len(rules) > 1 else len(page)] if rules else page
    inner = SMALL.sub("", inner, count=1)
    head = HEADING.search(inner)
    meta = case_title((to_text(head[1]) or "").replace("\n", " ")) if head else None
    if meta is None:
        return "plain", "{}", whole
    place = "/" + "/".join(x for x in (base.strip("/"), re.sub(r"\.txt$", ".html", path.replace("\\", "/").lstrip("/"))) if x)
    parts = place.strip("/").split("/")
    there = len(parts) >= 4 and parts[0] in ("au", "nz") and parts[1] == "cases"
    meta |= {"type": "case", "url": prefix + place, "jurisdiction": parts[2] if there else "", "court": parts[3] if there else ""}
    return "case", json.dumps(meta, ensure_ascii=False), header(meta) + "\n\n" + (to_text(inner) or "")
