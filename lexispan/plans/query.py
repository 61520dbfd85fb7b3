"""The query language: white space parts tokens, each is a prefix, and an identifier also matches as all of its parts.

A query becomes a tree of And, Or and Phrase nodes. Nothing that a user types is an operator.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

MOST_TOKENS = 24
_ACCENT = {}


def _category(c: str) -> str:
    return unicodedata.category(c)


def split_identifier(name: str) -> list[str]:
    """Parts of an identifier, as functions.text.identifier_parts has them."""
    if "_" in name:
        segments = [s for s in name.split("_") if s]
        if len(segments) > 1:
            return segments
    out, last = [], 0
    for i in range(1, len(name)):
        before, here = _category(name[i - 1]), _category(name[i])
        cut = (before == "Ll" and here == "Lu") or (before == "Nd" and here[0] == "L") or (before[0] == "L" and here == "Nd")
        if not cut and before == here == "Lu" and i + 1 < len(name) and _category(name[i + 1]) == "Ll":
            cut = True
        if cut:
            out.append(name[last:i])
            last = i
    return [*out, name[last:]]


def folded(text: str) -> str:
    from lexispan.functions.text import ACCENTED, PLAIN

    return text.lower().translate(str.maketrans(ACCENTED, PLAIN))


def term_list(text: str) -> list[str]:
    """Terms of a query token, as functions.text.terms has them of a text."""
    out, run = [], ""
    for c in folded(text) + " ":
        if _category(c)[0] in "LNM" or _category(c) == "Co":
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


@dataclass(frozen=True)
class Phrase:
    """Terms next to each other, the last of which is a prefix; without terms it matches nothing."""

    terms: tuple[str, ...]


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass
class Query:
    tree: And | Or | Phrase | None
    phrases: list[Phrase] = field(default_factory=list)


def _clean(token: str) -> str:
    return token.replace('"', "").replace("'", "")


def term_clause(token: str) -> And | Or | Phrase | None:
    """Clause of one token: its prefix, or else the prefixes of all its parts."""
    safe = _clean(token)
    if not safe:
        return None
    whole = Phrase(tuple(term_list(safe)))
    parts = [p for p in map(_clean, split_identifier(safe)) if p]
    if len(split_identifier(safe)) < 2 or len(parts) < 2:
        return whole
    return Or((whole, And(tuple(Phrase(tuple(term_list(p))) for p in parts))))


def parse(text: str | None) -> Query:
    """Tree of a query; without usable tokens it is None and finds nothing."""
    tokens = [t.strip('"') for t in re.split(r"\s+", text or "")]
    clauses = [c for c in map(term_clause, [t for t in tokens if t][:MOST_TOKENS]) if c is not None]
    tree = clauses[0] if len(clauses) == 1 else And(tuple(clauses)) if clauses else None
    found: list[Phrase] = []

    def walk(node) -> None:
        if isinstance(node, Phrase):
            if node.terms and node not in found:
                found.append(node)
        elif node is not None:
            for p in node.parts:
                walk(p)

    walk(tree)
    return Query(tree, found)


def occurrences(node) -> list[tuple[Phrase, tuple]]:
    """Every phrase of a tree with the branches of Or nodes above it, each of which must hold for it to score."""
    out = []

    def walk(n, gates: tuple) -> None:
        if isinstance(n, Phrase):
            out.append((n, gates))
        elif isinstance(n, Or):
            for p in n.parts:
                walk(p, (*gates, p))
        elif n is not None:
            for p in n.parts:
                walk(p, gates)

    walk(node, ())
    return out
