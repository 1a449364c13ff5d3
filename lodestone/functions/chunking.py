"""Chunking of a single text: what operators.corpus does over tables, for table functions and tests."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

_HEADING = re.compile(r"^(#{1,6})\s+(.+)", re.A)
_FENCE = re.compile(r"^\s*(```+|~~~+)", re.A)
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z(\[\"'`*_])|\n{2,}", re.A)
_BLANK = " \t\n\x0b\x0c\r"


def sections_of(text: str) -> Iterator[tuple[str, str]]:
    """(heading path, text) of what stands between headings, blank parts left out."""
    live: dict[int, str] = {}
    fence, held = "", []
    for line in [*text.split("\n"), None]:
        mark = _FENCE.match(line) if line is not None else None
        heading = _HEADING.match(line) if line is not None and not mark and not fence else None
        if line is None or heading:
            body = "\n".join(held).strip(_BLANK)
            if body:
                yield " > ".join(live[k] for k in sorted(live)), body
            held = []
        if heading:
            level = len(heading[1])
            live = {k: v for k, v in live.items() if k < level}
            live[level] = re.sub(r"\s*#*\s*$", "", heading[2], flags=re.A).strip(_BLANK)
        elif line is not None:
            held.append(line)
        if mark:
            fence = "" if fence == mark[1][0] else fence or mark[1][0]


def chunk_ranges(sizes: list[int], tokens: int, overlap: int) -> list[dict]:
    """Units of given sizes filled into ranges of at most ``tokens``, or of one larger unit; the last units of a range,
    up to ``overlap`` tokens, begin the next one."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > tokens:
            out.append({"start": start, "stop": i, "tokens": total})
            kept, back = 0, i
            while back > start and kept + sizes[back - 1] <= overlap:
                back -= 1
                kept += sizes[back]
            start, total = back, kept
        total += n
    if sizes:
        out.append({"start": start, "stop": len(sizes), "tokens": total})
    return out


def chunk_markdown(text: str, tokens: int = 300, overlap: int = 50) -> Iterator[tuple[str, str, int]]:
    """(heading path, text, tokens) of a text's chunks in order."""
    for path, body in sections_of(text):
        units = [u for u in (x.strip(_BLANK) for x in _SENTENCE.split(body)) if u] or [body]
        for r in chunk_ranges([math.ceil(len(u) / 3.2) for u in units], tokens, overlap):
            chunk = " ".join(units[r["start"] : r["stop"]]).strip(_BLANK)
            if chunk:
                yield path, chunk, r["tokens"]
