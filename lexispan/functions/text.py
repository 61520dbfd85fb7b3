"""Column expressions on text: terms, identifiers, expanded bodies, path prefixes and chunk ids. All of them stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Begins every line that is added to a body; part of the stored format.
MARK = "__lex_"
IDENTIFIER = r"\b[A-Za-z_][A-Za-z0-9_]*\b"
#: Those that may have several parts: all but words of small letters, the first perhaps a capital, and words of capitals.
SEVERAL = r"\b(?!(?:[A-Z]?[a-z]*+|[A-Z]++)(?![A-Za-z0-9_]))[A-Za-z_][A-Za-z0-9_]*\b"
TERM = r"[\p{L}\p{N}\p{M}\p{Co}]+"
#: Where a word without underscores is cut: before a capital, between letters and digits, before the last capital of a run.
CUTS = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Nd})(?=\p{L})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


def _diacritics() -> tuple[str, str]:
    pairs = []
    for point in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(point))
        if len(parts) == 2 and chr(point).lower() == chr(point) and parts[0].isascii():
            pairs.append((chr(point), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _diacritics()


def terms(text: Column) -> Column:
    """Terms of a text in order: runs of letters, digits and marks, in lower case and without a single diacritic."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit(TERM), F.lit(0))


def identifier_parts(name: Column) -> Column:
    """Parts of an identifier: its segments between underscores if there are two or more, else its parts by case and digits."""
    segments = F.filter(F.split(name, "_"), lambda x: x != "")
    return F.when(F.contains(name, F.lit("_")) & (F.size(segments) > 1), segments).otherwise(F.split(name, CUTS))


def expansions(body: Column) -> Column:
    """Parts of all identifiers that have several, blank-separated, each combination once, in order."""
    names = F.array_distinct(F.regexp_extract_all(body, F.lit(SEVERAL), F.lit(0)))
    parts = F.filter(F.transform(names, identifier_parts), lambda x: F.size(x) > 1)
    return F.array_distinct(F.transform(parts, lambda x: F.array_join(x, " ")))


def expanded_body(body: Column) -> Column:
    """The body, followed by a marker line and the expansions if there are any."""
    # One pass over a one-element array binds the expansions, which are then used twice.
    return F.transform(F.array(expansions(body)), lambda e: F.when(F.size(e) > 0, F.concat(body, F.lit(f"\n{MARK}camel:\n"), F.array_join(e, "\n"), F.lit("\n"))).otherwise(body))[0]


def chunk_id(path: Column, line_start: Column) -> Column:
    """60 bits of the MD5 of path and first line: the same in every snapshot, whatever else is indexed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", path, line_start.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def ticks_to_iso(ticks: Column) -> Column:
    """100-nanosecond ticks since year 1 as a round-trip UTC time."""
    seconds = F.expr("0L") + F.floor((ticks - F.lit(621355968000000000)) / F.lit(10000000)).cast("long")
    whole = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.lit("."), F.lpad(F.pmod(ticks, F.lit(10000000)).cast("string"), 7, "0"), F.lit("Z"))


def ascii_folded(path: Column) -> Column:
    """Path prefixes are compared without regard to the case of ASCII letters only."""
    return F.translate(path, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normal_prefix(raw: str) -> str:
    return raw.strip().replace("\\", "/").lstrip("/")
