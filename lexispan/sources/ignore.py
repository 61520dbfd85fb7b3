"""Ignore rules in the usual syntax: the last rule that matches decides, "!" takes back, a rule for a folder covers all below it.

Rules become regular expressions on the driver and an expression of the path, so they run inside the scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


def compiled(rules: Sequence[str]) -> list[tuple[str, bool]]:
    """(pattern over a relative path, whether it ignores) of every rule, in order."""
    out = []
    for raw in rules:
        rule = re.sub(r"(?<!\\)\s+$", "", raw.rstrip("\r\n"))
        if not rule or rule.startswith("#"):
            continue
        ignores = not rule.startswith("!")
        rule = rule[1:] if not ignores else rule
        rule = rule[1:] if rule.startswith(("\\#", "\\!")) else rule
        folder = rule.endswith("/")
        rule = rule.rstrip("/")
        if not rule:
            continue
        anchored = "/" in rule
        out.append((("^" if anchored else "^(?:.*/)?") + _glob(rule.lstrip("/")) + ("/.*$" if folder else "(?:/.*)?$"), ignores))
    return out


def _glob(rule: str) -> str:
    out, i = "", 0
    while i < len(rule):
        c = rule[i]
        if rule.startswith("**/", i) and (i == 0 or rule[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("/**", i) and i + 3 == len(rule):
            out, i = out + "/.+", i + 3
        elif c == "*":
            while i < len(rule) and rule[i] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := rule.find("]", i + 2)) > 0:
            inner = rule[i + 1 : end]
            inner = "^" + inner[1:] if inner[0] in "!^" else inner
            out, i = out + "[" + inner.replace("\\", "\\\\") + "]", end + 1
        elif c == "\\" and i + 1 < len(rule):
            out, i = out + re.escape(rule[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def ignored(path: Column, rules: Sequence[str]) -> Column:
    """Whether the rules ignore a relative path with forward slashes."""
    verdict = F.lit(False)
    for pattern, ignores in compiled(rules):
        verdict = F.when(path.rlike(pattern), F.lit(ignores)).otherwise(verdict)
    return verdict


def rules_of(root: str, names: Sequence[str]) -> list[str]:
    """Lines of the ignore files below root; rooted names, names with ".." and files that can't be read are left out."""
    out: list[str] = []
    for name in names:
        name = name.strip().replace("\\", "/")
        if not name or name.startswith("/") or re.match(r"^[A-Za-z]:", name) or ".." in name.split("/"):
            continue
        try:
            out += Path(root, name).read_text("utf-8-sig").splitlines()
        except (OSError, UnicodeDecodeError):
            continue
    return out
