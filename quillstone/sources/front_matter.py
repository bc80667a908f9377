"""Front matter: `key: value` lines between dashed lines, at the head of a text or before each of its sections."""

from __future__ import annotations

import ast
import json
import re

DASHES = re.compile(r"^-{3,}\s*$")


def value_of(raw: str):
    """A Python literal as what it says, anything else as text."""
    raw = raw.strip()
    try:
        value = ast.literal_eval(raw)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return raw
    return value if isinstance(value, (str, int, float, bool, list, dict, type(None))) else raw


def pairs(lines: list[str]) -> dict:
    out = {}
    for line in lines:
        key, colon, raw = line.partition(":")
        if colon and key.strip():
            out[key.strip()] = value_of(raw)
    return out


def split(text: str | None) -> tuple[str | None, str | None]:
    """(metadata as JSON, body). Without a head that opens with dashes and a `key:` line and is closed by dashes, the
    metadata is {} and the body the whole text. Null gives nulls."""
    if text is None:
        return None, None
    lines = text.splitlines()
    if len(lines) > 1 and lines[0].startswith("-") and ":" in lines[1]:
        end = next((i for i in range(1, len(lines)) if lines[i].startswith("-")), None)
        if end is not None:
            return json.dumps(pairs(lines[1:end]), ensure_ascii=False, default=str), "\n".join(lines[end + 1 :]).lstrip("\n")
    return "{}", text


def sections(text: str | None) -> list[tuple[dict, str]]:
    """(header, body) of every dashed header in the text, keys in lower case. Text before the first comes with an empty
    header; a text without headers is one such section; null or blank: none."""
    if not text or not text.strip():
        return []
    lines = text.splitlines()
    marks = [i for i, line in enumerate(lines) if DASHES.match(line)]
    heads, i = [], 0
    while i + 1 < len(marks):
        a, b = marks[i], marks[i + 1]
        inner = lines[a + 1 : b]
        if inner and all(":" in x for x in inner if x.strip()) and any(x.strip() for x in inner):
            heads.append((a, b, {k.lower(): v for k, v in pairs(inner).items()}))
            i += 2
        else:
            i += 1
    out = []
    before = "\n".join(lines[: heads[0][0]] if heads else lines).strip()
    if before:
        out.append(({}, before))
    for n, (_, b, head) in enumerate(heads):
        end = heads[n + 1][0] if n + 1 < len(heads) else len(lines)
        out.append((head, "\n".join(lines[b + 1 : end]).strip()))
    return out
