"""What changes between two snapshots, and accounts of what was skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(listing: DataFrame, file_state: DataFrame) -> DataFrame:
    """Files that are new or whose size or time differs: one join instead of a look-up a file."""
    old = file_state.select("path", F.col("size_bytes").alias("__size"), F.col("last_write_utc_ticks").alias("__ticks"), F.lit(True).alias("__known"))
    rows = listing.join(old, "path", "left")
    same = F.col("__known").isNotNull() & F.col("size_bytes").eqNullSafe(F.col("__size")) & F.col("last_write_utc_ticks").eqNullSafe(F.col("__ticks"))
    return rows.where(~same).drop("__size", "__ticks", "__known")


def stale(file_state: DataFrame, seen: DataFrame) -> DataFrame:
    """States of files that weren't seen any more."""
    return file_state.join(seen.select("path"), "path", "left_anti")


def merged_state(file_state: DataFrame, updates: DataFrame, gone: DataFrame) -> DataFrame:
    """file_state after an upsert of updates and without what is gone."""
    columns = ["path", "size_bytes", "last_write_utc_ticks"]
    touched = updates.select("path").unionByName(gone.select("path")).distinct()
    return file_state.join(touched, "path", "left_anti").select(columns).unionByName(updates.select(columns))


def merged_chunks(chunks: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """chunks without those of touched files, with the new ones."""
    return chunks.join(touched.select("path").distinct(), "path", "left_anti").select(new.columns).unionByName(new)


def skip_counts(skips: DataFrame) -> DataFrame:
    """Number of files skipped for each reason."""
    return skips.groupBy("reason").agg(F.count("*").alias("n"))


def tallies(skips: DataFrame) -> DataFrame:
    """One row: skipped as too large, as binary, and otherwise."""
    return skips.agg(F.count_if(F.col("reason") == "too_large").alias("skipped_large"), F.count_if(F.col("reason") == "binary").alias("skipped_binary"), F.count_if(F.col("reason").isin("denylist", "gitignore", "io_error")).alias("skipped_excluded"))


def top_prefixes(skips: DataFrame, n: int = 12) -> DataFrame:
    """First path segments with the most skipped files; spellings that differ in case count together under the least of them."""
    first = F.substring_index("path", "/", 1)
    counts = skips.groupBy(F.lower(first).alias("key")).agg(F.min(first).alias("prefix"), F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "key").limit(n).select("prefix", "n")


def sample(skips: DataFrame, n: int = 50) -> DataFrame:
    """The first n skipped files by path."""
    return skips.select("path", "reason").orderBy("path", "reason").limit(n)


def first_chunks(chunks: DataFrame, chars: int = 900) -> DataFrame:
    """First chunk of every path with an excerpt of its body; min_by needs no sort."""
    cols = F.struct("chunk_id", "extension", "line_start", "line_end", F.substring("body", 1, chars).alias("excerpt"))
    return chunks.groupBy("path").agg(F.min_by(cols, "line_start").alias("c")).select("path", "c.*")
