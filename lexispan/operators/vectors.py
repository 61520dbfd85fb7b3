"""Vectors of chunks: embedding, upkeep, exact cosine top-k, and its fusion with lexical hits.

Cosine is brute force in one scan with a bounded top-k: no shuffle but that of k rows a task. Allowed extensions are filtered before the top-k.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispan.functions.vectors import LEAST_NORM, cosine, hash_embedding, norm

CHARS, LEAST_K, MOST_K = 4000, 5, 200
EMBEDDERS: dict[str, Callable[..., Column]] = {"dummy": lambda text, dim=0, **_: hash_embedding(text, dim or 64)}


def embedder(name: str | Callable[..., Column] | None) -> Callable[..., Column]:
    """Registered embedder of a name, or a function as it is; an unknown name is the hash embedding."""
    if callable(name):
        return name
    return EMBEDDERS.get((name or "dummy").strip().lower(), EMBEDDERS["dummy"])


def embed(chunks: DataFrame, extensions: Sequence[str] | None = None, name: str | Callable[..., Column] = "dummy", dim: int = 0, now_ticks: int = 0, **options) -> DataFrame:
    """chunk_id, dim, norm, vec and updated_at_utc_ticks of the chunks with an allowed extension, of the first CHARS characters of each."""
    rows = chunks if extensions is None else chunks.where(F.lower("extension").isin([e.lower() for e in extensions]))
    vec = embedder(name)(F.substring("body", 1, CHARS), dim=dim, **options)
    # A generator of one row: what is derived from the vector, and filters on that, don't work it out again.
    return rows.select("chunk_id", F.explode(F.array(vec)).alias("vec")).select("chunk_id", F.size("vec").alias("dim"), norm(F.col("vec")).alias("norm"), "vec", F.lit(now_ticks).cast("long").alias("updated_at_utc_ticks"))


def prune(vectors: DataFrame, chunks: DataFrame, extensions: Sequence[str] | None) -> DataFrame:
    """Vectors whose chunk is there and has an allowed extension; an empty list of extensions leaves none."""
    if extensions is not None and not extensions:
        return vectors.where(F.lit(False))
    alive = chunks if extensions is None else chunks.where(F.lower("extension").isin([e.lower() for e in extensions]))
    return vectors.join(alive.select("chunk_id"), "chunk_id", "left_semi")


def top_k(vectors: DataFrame, query: Sequence[float], k: int, chunks: DataFrame | None = None, extensions: Sequence[str] | None = None) -> DataFrame:
    """chunk_id and sim of the k (5 to 200) nearest vectors; those of another length or without a norm don't count. Ties go by chunk_id."""
    k = max(LEAST_K, min(MOST_K, k))
    rows = vectors.where((F.col("dim") == len(query)) & (F.col("norm") > LEAST_NORM))
    if extensions is not None and chunks is not None:
        rows = rows.join(chunks.where(F.lower("extension").isin([e.lower() for e in extensions])).select("chunk_id"), "chunk_id", "left_semi")
    sims = rows.select("chunk_id", cosine(F.col("vec"), F.col("norm"), query).alias("sim"))
    return sims.orderBy(F.round("sim", 9).desc(), "chunk_id").limit(k)


def fused(lexical: DataFrame, near: DataFrame, alpha: float, beta: float, n: int) -> DataFrame:
    """chunk_id, hit_kind, fts_score, vec_score and rank_score of the n best of both.

    lexical: chunk_id, bm25; near: chunk_id, sim. In both: alpha times one plus beta times the other; in one: its score as it is."""
    both = lexical.select("chunk_id", F.col("bm25").alias("fts_score")).join(near.select("chunk_id", F.col("sim").alias("vec_score")), "chunk_id", "full_outer")
    fts, vec = F.col("fts_score"), F.col("vec_score")
    rank = F.when(fts.isNotNull() & vec.isNotNull(), alpha * fts + beta * vec).otherwise(F.coalesce(fts, vec))
    kind = F.when(fts.isNotNull(), "text_fts").otherwise("text_vector")
    rows = both.select("chunk_id", kind.alias("hit_kind"), "fts_score", "vec_score", rank.alias("rank_score"))
    return rows.orderBy(F.round("rank_score", 9).desc(), "chunk_id").limit(n)
