"""Chat formatting by grammar round trip: rendered text is parsed again, compared with the source, and conflicting content escaped until identical.

    conversation = { START role "\\n" content END "\\n" }

A deterministic parser reads a role up to the line end and a content up to END; START within a turn, END within a role, anything after END but a
line end, and anything between turns but START is an error. It then turns NULL into null, takes one backslash out of every "<",
backslashes, "|", and in roles turns "<|nl|>" into a line end. A turn that doesn't come back as it was is escaped: one backslash goes
into every "<", backslashes, "|" of it. Each turn is tried alone once, escaped if it must be, and the whole conversation is parsed and compared once more.

Turns go by number, those without one first, and of equal numbers by role and text; repeated rows are turns of their own. A null role or text is
NULL and comes back as null, an empty one as empty. A row of null conv_id is a conversation of its own. Very long texts are rendered whole; a conversation is one row of the result, so it must fit into one.
Other columns play no part. No rows, no conversations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, NULL, LINE = "<|im_start|>", "<|im_end|>", "<|null|>", "<|nl|>"
OPEN, SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")

Turn = tuple[str | None, str | None]


def escaped(x: str | None) -> str | None:
    return None if x is None else OPEN.sub(r"<\1\\|", x)


def rendered(turns: list[Turn], escape: list[bool]) -> str:
    out = []
    for (role, text), esc in zip(turns, escape):
        if esc:
            role, text = escaped(role), escaped(text)
            role = role if role is None else role.replace("\n", LINE)
        out.append(f"{START}{NULL if role is None else role}\n{NULL if text is None else text}{END}\n")
    return "".join(out)


def _source(x: str, role: bool = False) -> str | None:
    if x == NULL:
        return None
    return SHUT.sub(r"<\1|", x.replace(LINE, "\n") if role else x)


def parsed(text: str) -> tuple[list[Turn], bool]:
    """Turns up to the first error, and whether the whole text was read."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            return turns, False
        line = text.find("\n", at)
        end = text.find(END, line)
        if line < 0 or end < 0 or text.find(START, at + 1, end) >= 0 or text.find(END, at, line) >= 0 or not text.startswith("\n", end + len(END)):
            return turns, False
        turns.append((_source(text[at + len(START) : line], True), _source(text[line + 1 : end])))
        at = end + len(END) + 1
    return turns, True


def conflicts(turn: Turn) -> bool:
    """Whether a turn rendered as it is doesn't come back. Markers can't overlap, so what comes back alone comes back among others."""
    return parsed(rendered([turn], [False])) != ([turn], True)


def formatted(turns: list[Turn]) -> tuple[str, int]:
    """The text from which the turns come back, and how many of them had to be escaped."""
    escape = [conflicts(t) for t in turns]
    text = rendered(turns, escape)
    if parsed(text) != (turns, True):
        raise AssertionError("a conversation doesn't come back from its text")
    return text, sum(escape)


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, text, n_turns and n_escaped of every conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                turns = [[(t["role"], t["text"]) for t in x] for x in part.column("turns").to_pylist()]
                done = [formatted(x) for x in turns]
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array([x for x, _ in done], pa.string()), pa.array([len(x) for x in turns], pa.int32()), pa.array([k for _, k in done], pa.int32())], ["conv_id", "text", "n_turns", "n_escaped"])

    turn = F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")
    keyed = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone"), turn.alias("t"))
    grouped = keyed.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns")).drop("alone")
    return grouped.mapInArrow(run, "conv_id long, text string, n_turns int, n_escaped int")


_CONFLICT = f"""(contains({{0}}, '{START}') OR contains({{0}}, '{END}') OR {{0}} = '{NULL}' OR regexp_matches({{0}}, '<\\\\+\\|'))"""
_ESCAPED = "regexp_replace({0}, '<(\\\\*)\\|', '<\\1\\\\|', 'g')"
SQL = f"""
WITH t AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, coalesce({_CONFLICT.format("text")}, false) OR coalesce({_CONFLICT.format("role")} OR contains(role, chr(10)) OR contains(role, '{LINE}'), false) AS esc FROM conversations),
r AS (SELECT conv_id, alone, turn, role, text, esc,
  coalesce(CASE WHEN esc THEN replace({_ESCAPED.format("role")}, chr(10), '{LINE}') ELSE role END, '{NULL}') AS a, coalesce(CASE WHEN esc THEN {_ESCAPED.format("text")} ELSE text END, '{NULL}') AS b FROM t)
SELECT conv_id, string_agg('{START}' || a || chr(10) || b || '{END}' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text, count(*)::INT AS n_turns, (count(*) FILTER (WHERE esc))::INT AS n_escaped
FROM r GROUP BY conv_id, alone
"""
