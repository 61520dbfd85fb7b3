"""Snippets: up to 24 tokens of a body around the matches, which stand in brackets. Runs on the few rows of a result only."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from lexispan.plans.query import Phrase, folded

OPEN, SHUT, CUT, LENGTH = "[", "]", " … ", 24
_EDGE = re.compile(r"[.:][ \t\r\n]+$")


def spans(text: str) -> list[tuple[int, int, str]]:
    """Begin, end and folded form of every term."""
    out, begin = [], None
    for i, c in enumerate(text + " "):
        inside = unicodedata.category(c)[0] in "LNM" or unicodedata.category(c) == "Co"
        if inside and begin is None:
            begin = i
        elif not inside and begin is not None:
            out.append((begin, i, folded(text[begin:i])))
            begin = None
    return out


def instances(terms: list[str], phrases: list[Phrase]) -> list[tuple[int, int, int]]:
    """(position, phrase, length) of every match, by position."""
    out = []
    for k, p in enumerate(phrases):
        n = len(p.terms)
        for i in range(len(terms) - n + 1):
            if all(terms[i + j] == p.terms[j] for j in range(n - 1)) and terms[i + n - 1].startswith(p.terms[-1]):
                out.append((i, k, n))
    return sorted(out)


def snippet(text: str | None, phrases: list[Phrase], length: int = LENGTH) -> str | None:
    """The window with the most different phrases, then the most matches; one at the start of a sentence is preferred."""
    if text is None:
        return None
    at = spans(text)
    found = instances([t for _, _, t in at], phrases)
    n, best, start = len(at), 0, 0

    def rate(lo: int) -> tuple[int, int]:
        seen: set[int] = set()
        score, first, last = 0, -1, 0
        for pos, k, size in found:
            if lo <= pos < lo + length:
                score += 1 if k in seen else 1000
                seen.add(k)
                first = pos if first < 0 else first
                last = pos + size
        shift = first - int((length - (last - first)) / 2)
        return score, max(0, min(shift, n - length))

    sentences = [0] + [i for i in range(1, n) if _EDGE.search(text, at[i - 1][1], at[i][0])]
    for pos, _, _ in found:
        score, shift = rate(pos)
        if score > best:
            best, start = score, shift
        if n > length:
            lo = max(s for s in sentences if s <= pos)
            if lo < pos:
                score = rate(lo)[0] + (120 if lo == 0 else 100)
                if score > best:
                    best, start = score, lo
    end = min(n, start + length)
    out, here = (CUT, at[start][0]) if start > 0 else ("", 0)
    marked = -1
    for pos, _, size in found:
        if pos + size <= start or pos >= end or pos + size <= marked:
            continue
        lo, hi = max(pos, start), min(pos + size, end)
        if lo < marked:  # overlapping matches share one pair of brackets
            out = out[: -len(SHUT)] + text[here : at[hi - 1][1]] + SHUT
        else:
            out += text[here : at[lo][0]] + OPEN + text[at[lo][0] : at[hi - 1][1]] + SHUT
        here, marked = at[hi - 1][1], hi
    return out + (text[here : at[end - 1][1]] + CUT if end < n else text[here:])


def snippets(phrases: list[Phrase], length: int = LENGTH):
    """Column function: body to snippet."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for bodies in batches:
            yield pd.Series([snippet(b, phrases, length) for b in bodies], dtype=object)

    return run
