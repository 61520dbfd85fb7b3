"""Files to chunks: overlapping windows of lines, the first with its file's header, all with identifiers spelled out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispan.functions.text import chunk_id, expanded_body

CHUNK_LINES, OVERLAP_LINES, LEAST_LINES = 110, 15, 20


def windows(text: Column, chunk: int = CHUNK_LINES, overlap: int = OVERLAP_LINES) -> Column:
    """Array of (line_start, line_end, body): windows of chunk lines that share overlap lines, up to the first that reaches the last line."""
    size = max(LEAST_LINES, chunk)
    step = max(1, size - min(max(overlap, 0), size - 1))
    lines = F.split(F.regexp_replace(text, "\r\n|\r", "\n"), "\n")

    def cut(ls: Column) -> Column:
        n = F.size(ls)
        last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / F.lit(step))).cast("int")
        one = lambda j: F.struct((j * step + 1).alias("line_start"), F.least(j * step + size, n).alias("line_end"), F.array_join(F.slice(ls, j * step + 1, size), "\n").alias("body"))
        return F.transform(F.sequence(F.lit(0), last), one)

    return F.when(text != "", F.transform(F.array(lines), cut)[0])


def chunks(files: DataFrame, chunk: int = CHUNK_LINES, overlap: int = OVERLAP_LINES) -> DataFrame:
    """chunk_id, path, extension, line_start, line_end, body. files: path, extension, text and, if there is one, header."""
    header = F.col("header") if "header" in files.columns else F.lit("")
    cut = files.select("path", "extension", header.alias("header"), F.explode(windows(F.col("text"), chunk, overlap)).alias("w"))
    body = F.when(F.col("w.line_start") == 1, F.concat(F.coalesce("header", F.lit("")), F.col("w.body"))).otherwise(F.col("w.body"))
    rows = cut.select("path", "extension", F.col("w.line_start").alias("line_start"), F.col("w.line_end").alias("line_end"), body.alias("raw"))
    return rows.select(chunk_id(F.col("path"), F.col("line_start")).alias("chunk_id"), "path", "extension", "line_start", "line_end", expanded_body(F.col("raw")).alias("body"))
