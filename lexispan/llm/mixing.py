"""Mixing sources to target weights by systematic sampling.

Every source gets the share weight / sum of weights of all characters. Its documents expect share / (characters of the source)
copies each; in units of a millionth they are summed up within the source, from one random offset (drawn by SEED, so that a run can be repeated), and a document is emitted once for
every whole copy that its stretch of the sum crosses. Whole numbers throughout: any engine gives the same rows.

The sum runs in the order of (doc_id modulo BUCKETS, doc_id): sums of the buckets come first, then each bucket is summed up from
where the one before ends, so no task holds a whole source, however hot. Rows of one doc_id follow each other by n_chars and text.
A null source is a source of its own, a null doc_id is in bucket -1, a null text has no characters, and a source without characters
or with weight 0 gives no rows. Repeated rows count each by itself. No rows, no result.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispan.llm.common import apart

BUCKETS, UNIT, SEED = 1024, 1_000_000, 1


def offset_of(seed: int) -> int:
    """A random start of the sums, from 0 to UNIT - 1."""
    return random.Random(seed).randrange(UNIT)


OFFSET = offset_of(SEED)
#: Production weights; any source not named has weight 1.
WEIGHTS = {"src0": 4, "src1": 2, "src2": 2}


def measured(docs: DataFrame) -> DataFrame:
    """docs with the length of each text and its hash, which is all that drawing needs of it."""
    return docs.withColumns({"__size": F.coalesce(F.char_length("text"), F.lit(0)).cast("long"), "__hash": F.xxhash64("text")})


def sampled(docs: DataFrame, weights: dict[str, int] | None = None, offset: int = OFFSET) -> DataFrame:
    """Rows of docs, each as often as it is drawn, with column __copy counted from 1. docs has no columns in "__" of its own; mixed takes care of those."""
    return drawn(measured(docs), weights, offset).drop("__size", "__hash")


def mixed(docs: DataFrame, weights: dict[str, int] | None = None, offset: int = OFFSET) -> DataFrame:
    """Rows of docs, each as often as it is drawn, with the columns of docs."""
    return apart(lambda d: sampled(d, weights, offset).drop("__copy"), docs)


def drawn(docs: DataFrame, weights: dict[str, int] | None = None, offset: int = OFFSET) -> DataFrame:
    """As sampled, of a result of measured."""
    weights = WEIGHTS if weights is None else weights
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    weight = F.lit(1)
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, F.lit(int(w))).otherwise(weight)
    keyed = docs.select("*", source.alias("__source"), F.coalesce(F.pmod("doc_id", F.lit(BUCKETS)), F.lit(-1)).alias("__bucket"), weight.cast("long").alias("__weight"))
    parts = keyed.groupBy("__source", "__bucket").agg(F.count("*").alias("n"), F.sum("__size").alias("chars"), F.max("__weight").alias("weight"))
    sources = parts.groupBy("__source").agg(F.sum("chars").cast("decimal(38,0)").alias("chars"), F.max("weight").cast("decimal(38,0)").alias("weight")).where("chars > 0")
    total = sources.agg(F.sum("chars").cast("decimal(38,0)").alias("all"), F.sum("weight").cast("decimal(38,0)").alias("weights"))
    rates = sources.crossJoin(F.broadcast(total)).select("__source", F.expr(f"(`all` * weight * {UNIT}BD) div (weights * chars)").alias("__rate"))
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.join(rates, "__source").select("__source", "__bucket", "__rate", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    # One row for each bucket of a source: as many as sources times BUCKETS, which the optimizer may broadcast by its own size check.
    within = Window.partitionBy("__source", "__bucket").orderBy("doc_id", "__size", "__hash")
    ranked = keyed.withColumn("__rank", F.row_number().over(within).cast("long")).join(starts, ["__source", "__bucket"])
    crossed = F.expr(f"(({offset}L + (__before + __rank) * __rate) div {UNIT}L) - (({offset}L + (__before + __rank - 1) * __rate) div {UNIT}L)")
    chosen = ranked.withColumn("__copies", crossed).where(F.col("__copies") > 0)
    return chosen.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source and copy of every drawn document."""
    return drawn(measured(docs.select("doc_id", "source", "text")).drop("text")).select("doc_id", "source", F.col("__copy").alias("copy"))


MANIFEST_SQL = f"""
WITH d AS (SELECT doc_id, source, doc_id % {BUCKETS} AS b, CASE source {" ".join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS.items())} ELSE 1 END AS weight, length(text)::HUGEINT AS size FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS chars, max(weight)::HUGEINT AS weight FROM d GROUP BY source),
r AS (SELECT source, ((SELECT sum(chars) FROM s)::HUGEINT * weight * {UNIT} // ((SELECT sum(weight) FROM s)::HUGEINT * chars))::BIGINT AS rate FROM s WHERE chars > 0),
k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY b, doc_id) AS k FROM d),
c AS (SELECT doc_id, source, ({OFFSET} + k * rate) // {UNIT} - ({OFFSET} + (k - 1) * rate) // {UNIT} AS copies FROM k JOIN r USING (source))
SELECT doc_id, source, unnest(range(1, copies + 1))::INT AS copy FROM c WHERE copies > 0
"""
