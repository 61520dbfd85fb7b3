"""DuckDB SQL of the retrieval queries over the same tables, written from their definitions."""

from __future__ import annotations

from lexispan.plans.query import And, Or, Phrase

MARK = "__lex_"

EXTENSIONS = {"en": ".md", "de": ".cs", "fr": ".json", "es": ".toml"}
CHUNK, OVERLAP = 20, 5
STEP = CHUNK - OVERLAP
LETTERS = r"[\p{L}\p{N}\p{M}\p{Co}]+"

FILES = f"""f AS (SELECT doc_id, 'docs/' || source || '/' || lang || '/d' || doc_id || ext AS path, ext AS extension, text, strlen(text)::BIGINT AS size_bytes, 638396640000000000 + doc_id * 600000000 AS last_write_utc_ticks
  FROM (SELECT *, CASE lang {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXTENSIONS.items())} ELSE '.txt' END AS ext FROM documents))"""


def _one(*terms: str) -> Phrase:
    return Phrase(terms)


def _cut(whole: str, *split: str) -> Or:
    return Or((_one(whole), And(tuple(map(_one, split)))))


#: The trees of the queries that are checked, by hand.
TREES = {
    "the": _one("the"),
    "la": _one("la"),
    "of.the": _one("of", "the"),
    "the src1": And((_one("the"), _cut("src1", "src", "1"))),
    "src3 d1": And((_cut("src3", "src", "3"), _cut("d1", "d", "1"))),
    "thanThe ofTo": And((_cut("thanthe", "than", "the"), _cut("ofto", "of", "to"))),
}


def leaves(node, gates: tuple = ()) -> list[tuple[Phrase, tuple]]:
    """Phrases of a tree, each with the branches of Or that it is in."""
    if isinstance(node, Phrase):
        return [(node, gates)]
    return [x for p in node.parts for x in leaves(p, (*gates, p) if isinstance(node, Or) else gates)]


def parts(x: str) -> str:
    """List of the parts of identifier x."""
    segments = f"list_filter(string_split({x}, '_'), lambda s: s <> '')"
    cut = x
    for pattern in ("([A-Z])([A-Z][a-z])", "([a-z])([A-Z])", "([0-9])([A-Za-z])", "([A-Za-z])([0-9])"):
        cut = rf"regexp_replace({cut}, '{pattern}', '\1 \2', 'g')"
    return f"CASE WHEN contains({x}, '_') AND len({segments}) > 1 THEN {segments} ELSE string_split({cut}, ' ') END"


def expand(source: str, key: str, text: str, name: str) -> str:
    """CTE name: all of source with column body, text with its expansions."""
    words = r"list_filter(regexp_extract_all(" + text + r", '[\p{L}\p{N}\p{M}_]+'), lambda w: regexp_full_match(w, '[_a-zA-Z][_a-zA-Z0-9]*'))"
    return f"""{name}_w AS (SELECT *, list_transform(list_filter(list_transform({words}, lambda w: {parts("w")}), lambda p: len(p) > 1), lambda p: array_to_string(p, ' ')) AS many FROM {source}),
{name}_e AS (SELECT * EXCLUDE (many), list_filter(many, lambda e, i: list_position(many, e) = i) AS exps FROM {name}_w),
{name} AS (SELECT * EXCLUDE (exps), CASE WHEN len(exps) > 0 THEN {text} || chr(10) || '{MARK}camel:' || chr(10) || array_to_string(exps, chr(10)) || chr(10) ELSE {text} END AS body FROM {name}_e)"""


CHUNK_ID = "('0x' || substr(md5(path || ':' || line_start), 1, 15))::BIGINT"
CHUNKS = f"""{FILES},
l AS (SELECT *, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM f WHERE text <> ''),
j AS (SELECT *, unnest(range(0, CASE WHEN len(ls) <= {CHUNK} THEN 1 ELSE (len(ls) - {CHUNK} + {STEP - 1}) // {STEP} + 1 END)) AS j FROM l),
r AS (SELECT path, extension, last_write_utc_ticks, (j * {STEP} + 1)::INT AS line_start, least(j * {STEP} + {CHUNK}, len(ls))::INT AS line_end, array_to_string(ls[j * {STEP} + 1 : j * {STEP} + {CHUNK}], chr(10)) AS raw FROM j),
{expand("r", "path", "raw", "x")},
c AS (SELECT {CHUNK_ID} AS chunk_id, path, extension, line_start, line_end, body, last_write_utc_ticks FROM x)"""
TERMS = f"""{CHUNKS},
t AS (SELECT *, regexp_extract_all(strip_accents(lower(path)), '{LETTERS}') AS pt, regexp_extract_all(strip_accents(lower(body)), '{LETTERS}') AS bt FROM c)"""


def _count(p: Phrase, terms: str) -> str:
    n = len(p.terms)
    tests = [f"{terms}[i + {k}] = '{t}'" for k, t in enumerate(p.terms[:-1])] + [f"starts_with({terms}[i + {n - 1}], '{p.terms[-1]}')"]
    return f"len(list_filter(range(1, len({terms}) - {n - 2}), lambda i: {' AND '.join(tests)}))"


def _holds(node, phrases: list[Phrase]) -> str:
    if isinstance(node, Phrase):
        return f"f{phrases.index(node)} > 0" if node.terms else "false"
    return "(" + (" AND " if isinstance(node, And) else " OR ").join(_holds(p, phrases) for p in node.parts) + ")"


def scores(text: str) -> str:
    """CTEs that end in s: chunks for which a query holds, with bm25."""
    tree = TREES[text]
    phrases = list(dict.fromkeys(p for p, _ in leaves(tree)))
    n = range(len(phrases))
    counts = ", ".join(f"{_count(p, 'pt')} + {_count(p, 'bt')} AS f{k}" for k, p in enumerate(phrases))
    total = []
    for p, gates in leaves(tree):
        if p.terms:
            k = phrases.index(p)
            raw = f"ln((n_chunks - n{k} + 0.5e0) / (n{k} + 0.5e0))"
            part = f"(CASE WHEN {raw} <= 0 THEN 1e-6 ELSE {raw} END) * f{k} * 2.2e0 / (f{k} + 1.2e0 * (0.25e0 + 0.75e0 * d / avgdl))"
            for g in gates:
                part = f"CASE WHEN {_holds(g, phrases)} THEN {part} ELSE 0e0 END"
            total.append(f"({part})")
    return f"""{TERMS},
m AS (SELECT * EXCLUDE (pt, bt), len(pt) + len(bt) AS d, {counts} FROM t),
g AS (SELECT count(*) AS n_chunks, sum(d)::DOUBLE / count(*) AS avgdl, {", ".join(f"count(*) FILTER (WHERE f{k} > 0) AS n{k}" for k in n)} FROM m),
s AS (SELECT m.*, -({" + ".join(total)}) AS bm25 FROM m, g WHERE {_holds(tree, phrases)})"""


ISO = "strftime(make_timestamp((last_write_utc_ticks - 621355968000000000) // 10), '%Y-%m-%dT%H:%M:%S') || '.' || lpad((last_write_utc_ticks % 10000000)::VARCHAR, 7, '0') || 'Z'"


def search(text: str, n: int = 15, order: str = "best_first", where: str = "true", fresh: bool = False) -> str:
    """Hits of a search: path, line_start, line_end, fts_score and chunk_char_count."""
    direction = "DESC" if order == "reference" else "ASC"
    return f"""WITH {scores(text)}
SELECT path, line_start, line_end, round(bm25, 6) AS fts_score, length(body)::INT AS chunk_char_count{", " + ISO + " AS last_write_utc_iso" if fresh else ""}
FROM s WHERE {where} ORDER BY round(bm25, 9) {direction}, chunk_id LIMIT {n}"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """A CTE body of literal rows."""
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_quoted(c) if isinstance(c, str) else str(c) for c in r) + ")" for r in rows) + f") AS v({names})"


def _tags(name: str, pattern: str, group: int = 1, cap: int | None = None, distinct: str | None = None, then: str = "x") -> str:
    found = f"list_filter(list_transform(regexp_extract_all(text, {_quoted(pattern)}, {group})" + (f"[1:{cap}]" if cap and not distinct else "") + ", lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
    if distinct:
        key = "lower(x)" if distinct == "case" else "x"
        keys = f"list_transform({found}, lambda x: {key})"
        found = f"list_filter({found}, lambda x, i: list_position({keys}, {key}) = i)" + (f"[1:{cap}]" if cap else "")
    return f"list_transform({found}, lambda x: '{MARK}{name}:' || {then})"


def _pairs(name: str, pattern: str, cap: int, glue: str) -> str:
    q = _quoted(pattern)
    return f"list_transform(list_zip(regexp_extract_all(text, {q}, 1)[1:{cap}], regexp_extract_all(text, {q}, 2)[1:{cap}]), lambda p: '{MARK}{name}:' || p[1] || '{glue}' || p[2])"


def _line(directive: str, rest: str) -> str:
    return rf"(?m)^\s*@{directive}\s+{rest}"


RAZOR_TAGS = " || ".join([
    f"['{MARK}kind:razor']", rf"CASE WHEN regexp_matches(text, '(?m)^\s*@code\b') THEN ['{MARK}razor:has_code_block'] ELSE [] END",
    _tags("page", _line("page", r"([^\r\n]+?)\s*$"), then="trim(x, '\"')"), _tags("layout", _line("layout", r"(\S+)\s*$")), _tags("namespace", _line("namespace", r"(\S+)\s*$"), cap=4),
    _tags("using", _line("using", r"([^\r\n]+?)\s*$"), cap=40), _tags("implements", _line("implements", r"([^\r\n]+?)\s*$")), _tags("inherits", _line("inherits", r"(\S+)\s*$")),
    _tags("typeparam", _line("typeparam", r"(\w+)\s*$")), _tags("handler", r"\b@(on[a-z]+)\b", distinct="case"), _tags("attribute", _line("attribute", r"\[([^\]]+)\]"), cap=24),
    _pairs("inject", _line("inject", r"(\S+)\s+(\S+)\s*$"), 32, " "),
    "list_filter(" + _tags("parameter", r"\[\s*Parameter(\([^\]]*\))?\s*\][\s\w.,<>\[\]]+\s(\w+)\s*\{", 2, cap=48) + ", lambda x: regexp_matches(x, ':[A-Z]'))",
    _tags("component", r"<([A-Z][A-Za-z0-9_.]+)\b", cap=50, distinct="exact"),
])
AXAML_TAGS = " || ".join([
    f"['{MARK}kind:axaml']", _tags("xclass", r'\bx:Class\s*=\s*"([^"]+)"'), _pairs("xmlns", r'xmlns\s*:\s*(\w+)\s*=\s*"([^"]+)"', 28, "="), _tags("staticresource", r"\{StaticResource\s+([^}]+)\}", cap=48),
    _tags("dynamicresource", r"\{DynamicResource\s+([^}]+)\}", cap=48), _tags("key", r'\bx:Key\s*=\s*"([^"]+)"', cap=64), _tags("xname", r'\bx:Name\s*=\s*"([^"]+)"', cap=80, distinct="case"),
    _tags("binding", r"\{Binding\s+([^}\s,]+)", cap=80, distinct="case"), _tags("classes", r'\bClasses\s*=\s*"([^"]+)"'), _tags("avares", "avares:[^\\s\"']+", 0),
])


def headers(rows: list[tuple], extension: str, tags: str) -> str:
    return f"""WITH f AS ({values(rows, 'path, extension, text')}), p AS (SELECT f.*, g.path AS pair FROM f LEFT JOIN f g ON g.path = f.path || '.cs' WHERE lower(f.extension) = '{extension}')
SELECT path, array_to_string((CASE WHEN pair IS NULL THEN [] ELSE ['{MARK}pair:' || pair] END) || {tags}, chr(10)) || chr(10) || chr(10) AS header FROM p"""


def embedding(text: str, dim: int = 64) -> str:
    """List of floats: the hash embedding of a text."""
    word = "(('0x' || substr(d, k * 4 + 3, 2) || substr(d, k * 4 + 1, 2))::INT / 32767.5e0 - 1)::FLOAT"
    digest = f"sha256(from_hex(sha256({text}) || lpad(lower(to_hex(b * 16)), 2, '0') || '000000'))"
    raw = f"flatten(list_transform(list_transform(range({(dim + 15) // 16}), lambda b: {digest}), lambda d: list_transform(range(16), lambda k: {word})))[1:{dim}]"
    return raw


def unit(v: str) -> str:
    return f"list_transform({v}, lambda x: (x * (1 / sqrt(list_sum(list_transform({v}, lambda y: y::DOUBLE * y)))::DOUBLE)::FLOAT)::FLOAT)"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]))"


def norm(v: str) -> str:
    return f"sqrt({dot(v, v)})"
