"""Line-first cleaning: rules judge every line, failing lines go, and a document that loses too much of its text is rejected.

A line that is not blank fails as
  boilerplate  it matches a licence, cookie, script or rights notice;
  navigation   it holds two "|" or more;
  symbols      over SYMBOLS of its characters are noise symbols;
  repeats      over REPEATS of its words equal the word before;
  punctuation  no sentence ends in it, or at its end.
Blank lines stay. A document is rejected when its failing lines hold more than LOSS of its characters, boilerplate among them, or when
nothing but blanks is left.

Null and empty texts are rejected; very long texts are judged whole, line by line; other columns, null or not and whatever their names, pass through, and
repeated rows are judged each by itself. No rows, no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispan.llm.common import apart

SYMBOLS, REPEATS, LOSS = 0.1, 0.3, 0.5
NOISE = "!#$%&*|<>{}[]\\^~=+@_/"
BOILERPLATE = ("licensed under", "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies", "enable javascript", "lorem ipsum")
NOISY = "[" + "".join("\\" + c for c in NOISE) + "]"
#: Ends of sentences, a blank or the line end after them; full-width ones need none.
SENTENCE = "[.!?…।॥؟۔።][\"')\\]»”]*([ \\t\\r]|$)|[。！？．｡]"
REPEAT = r"(?<![^ ])([^ ]++) (?=\1(?![^ ]))"


def failure(line: Column) -> Column:
    """Name of the first rule that a line fails; null for a line that stays."""
    size = F.char_length(line)
    words = F.regexp_count(line, F.lit(" ")) + 1
    low = F.lower(line)
    boilerplate = low.contains(BOILERPLATE[0])
    for phrase in BOILERPLATE[1:]:
        boilerplate = boilerplate | low.contains(phrase)
    return (
        F.when(F.trim(line) == "", None)
        .when(boilerplate, "boilerplate")
        .when((F.instr(line, "|") > 0) & (F.regexp_count(line, F.lit("[|]")) >= 2), "navigation")
        .when(F.regexp_count(line, F.lit(NOISY)) > size * SYMBOLS, "symbols")
        .when(F.regexp_count(line, F.lit(REPEAT)) > words * REPEATS, "repeats")
        .when(~line.rlike(SENTENCE), "punctuation")
    )


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with struct __quality(text, n_lines, n_removed, kept): the cleaned text and the verdict."""
    lines = F.transform(F.split(F.col(text), "\n"), lambda x: F.struct(x.alias("x"), failure(x).alias("why")))
    chars = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + F.char_length(x["x"]))
    step = docs.withColumn("__lines", lines)
    xs = F.col("__lines")
    lost = chars(F.filter(xs, lambda x: x["why"].isNotNull()))
    clean = F.array_join(F.transform(F.filter(xs, lambda x: x["why"].isNull()), lambda x: x["x"]), "\n")
    step = step.withColumn("__parts", F.struct(clean.alias("text"), lost.alias("lost"), chars(xs).alias("of"), F.size(xs).alias("n_lines"), F.size(F.filter(xs, lambda x: x["why"].isNotNull())).alias("n_removed")))
    p = F.col("__parts")
    kept = F.coalesce((F.trim(F.translate(p["text"], "\n", "")) != "") & (p["lost"] <= p["of"] * LOSS), F.lit(False))
    verdict = F.struct(p["text"].alias("text"), p["n_lines"].alias("n_lines"), p["n_removed"].alias("n_removed"), kept.alias("kept"))
    # A generator of one row: a filter on its result isn't pushed below it, where all of this would be worked out a second time.
    return step.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array(verdict)).alias("__quality"))


def cleaned(docs: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The documents that stay, with their cleaned text and, where there is such a column, its new length."""
    return apart(lambda d: _cleaned(d, text, chars), docs)


def _cleaned(docs: DataFrame, text: str, chars: str) -> DataFrame:
    out = judged(docs, text).where("__quality.kept").withColumn(text, F.col("__quality.text"))
    if chars in docs.columns:
        out = out.withColumn(chars, F.char_length(text).cast(docs.schema[chars].dataType))
    return out.drop("__quality")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_lines and n_removed of the documents that stay."""
    q = judged(docs.select("doc_id", "text"))
    return q.where("__quality.kept").select("doc_id", "__quality.text", "__quality.n_lines", "__quality.n_removed")


_WHY = rf"""CASE WHEN trim(x) = '' THEN NULL
  WHEN regexp_matches(lower(x), '{"|".join(BOILERPLATE)}') THEN 'boilerplate'
  WHEN length(x) - length(translate(x, '|', '')) >= 2 THEN 'navigation'
  WHEN length(x) - length(translate(x, '{NOISE}', '')) > length(x) * {SYMBOLS}e0 THEN 'symbols'
  WHEN len(list_filter(range(1, len(string_split(x, ' '))), lambda i: string_split(x, ' ')[i] = string_split(x, ' ')[i + 1] AND string_split(x, ' ')[i] <> ''))
    > (length(x) - length(translate(x, ' ', '')) + 1) * {REPEATS}e0 THEN 'repeats'
  WHEN NOT regexp_matches(x, '{SENTENCE.replace("'", "''").replace("$", chr(92) + "z")}') THEN 'punctuation' END"""

REPORT_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
w AS (SELECT doc_id, i, x, {_WHY} AS why FROM l),
d AS (SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE why IS NULL), '') AS text,
  coalesce(sum(length(x)) FILTER (WHERE why IS NOT NULL), 0) AS lost, coalesce(sum(length(x)), 0) AS total,
  count(*)::INT AS n_lines, (count(why))::INT AS n_removed FROM w GROUP BY doc_id)
SELECT doc_id, text, n_lines, n_removed FROM d WHERE trim(translate(text, chr(10), '')) <> '' AND lost <= total * {LOSS}e0
"""
