"""Longest-processing-time scheduling: groups that must stay together, largest first, go to the least loaded of SHARDS shards.

Here a group is all copies of one text, and its size the characters of all of them. Groups come by size downwards, then by key;
the heap holds (load, shard), so of equal loads the lowest shard takes the group.

Only the histogram of sizes reaches the driver: groups of one size are interchangeable for the heap, which for each size pops
shards until its groups are placed, and once every load lies within one group of the others it goes round in a fixed order. The
sequence of shards of each size is all that goes back; a group finds its shard by its rank within its size. The histogram has as
many rows as there are distinct sizes, which grow far slower than the groups.

A null text is a group of its own key "null" and, as an empty text, of size 0; groups of size 0 go by the same rule after all
others. Null doc_ids and repeated rows are placed as any other row. No rows, no result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispan.llm.common import apart

SHARDS = 32
PLAN = T.StructType([T.StructField("__size", T.LongType()), T.StructField("__first", T.ArrayType(T.IntegerType())), T.StructField("__round", T.ArrayType(T.IntegerType()))])


def schedule(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int], list[int]]]:
    """For each (size, number of groups), sizes downwards: shards of the first groups, one by one, then the order that repeats."""
    heap = [(0, s) for s in range(shards)]
    plan = []

    def pop() -> tuple[int, int]:
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        return load + size, shard

    for size, count in sorted(histogram, reverse=True):
        if size == 0:  # no load changes any more: the least loaded takes them all
            plan.append((size, [], [heap[0][1]]))
            continue
        first: list[int] = []
        most = max(heap)
        while count and (count <= shards or (heap[0][0] + size, heap[0][1]) < most):
            most = max(most, raised := pop())
            first.append(raised[1])
            count -= 1
        # From here on every shard is popped once before any is popped twice, so the order of (load, shard) repeats.
        order = sorted(heap) if count else []
        if count:
            rounds, rest = divmod(count, shards)
            heap[:] = [(load + size * (rounds + (k < rest)), shard) for k, (load, shard) in enumerate(order)]
            heapq.heapify(heap)
        plan.append((size, first, [shard for _, shard in order]))
    return plan


def keyed_by_text(docs: DataFrame) -> DataFrame:
    """docs with columns __key, alike for all copies of a text, and __chars."""
    key = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null"))
    return docs.withColumns({"__key": key, "__chars": F.coalesce(F.char_length("text"), F.lit(0)).cast("long")})


def placed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with column __shard."""
    return apart(lambda d: homed(keyed_by_text(d), shards).drop("__key", "__chars"), docs)


def homed(keyed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """keyed, a result of keyed_by_text, with column __shard."""
    groups = keyed.groupBy("__key").agg(F.sum("__chars").alias("__size"))
    histogram = groups.groupBy("__size").agg(F.count("*").alias("n"))
    plan = keyed.sparkSession.createDataFrame(schedule([(r[0], r[1]) for r in histogram.collect()], shards), PLAN)
    rank = (F.row_number().over(Window.partitionBy("__size").orderBy("__key")) - 1).alias("__rank")
    turn = F.col("__rank") - F.size("__first")
    shard = F.when(turn < 0, F.get("__first", F.col("__rank"))).otherwise(F.get("__round", F.when(F.size("__round") > 0, turn % F.size("__round"))))
    homes = groups.select("__key", "__size", rank).join(plan, "__size").select("__key", shard.alias("__shard"))
    return keyed.join(homes, "__key")


def assignment(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, shard and n_chars of every document."""
    narrow = keyed_by_text(docs.select("doc_id", "text")).drop("text")  # texts stay out of the shuffles
    return homed(narrow, shards).select("doc_id", F.col("__shard").alias("shard"), F.col("__chars").cast("int").alias("n_chars"))


ASSIGNMENT_SQL = f"""
WITH RECURSIVE g AS (SELECT md5(text) AS k, sum(length(text))::BIGINT AS size FROM documents GROUP BY 1),
o AS (SELECT k, size, row_number() OVER (ORDER BY size DESC, k) AS i FROM g),
r AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS k, -1 AS shard, list_transform(range({SHARDS}), lambda x: 0::BIGINT) AS loads
  UNION ALL
  SELECT o.i, o.k, (list_position(r.loads, list_min(r.loads)) - 1)::INT,
    list_transform(r.loads, lambda v, j: v + CASE WHEN j = list_position(r.loads, list_min(r.loads)) THEN o.size ELSE 0 END)
  FROM r JOIN o ON o.i = r.i + 1)
SELECT doc_id, r.shard, length(text)::INT AS n_chars FROM documents JOIN r ON r.k = md5(text)
"""
