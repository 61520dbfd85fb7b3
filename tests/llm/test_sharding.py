import heapq
import random

from lexispan.llm import sharding


def plain(sizes, shards):
    heap, out = [(0, s) for s in range(shards)], []
    for size in sorted(sizes, reverse=True):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out.append((size, shard))
    return out


def expanded(plan, histogram):
    counts = dict(histogram)
    return [(size, first[k] if k < len(first) else order[(k - len(first)) % len(order)]) for size, first, order in plan for k in range(counts[size])]


def test_schedule_is_the_heap():
    rng = random.Random(1)
    for _ in range(300):
        shards = rng.randint(1, 7)
        sizes = [rng.choice([0, 1, 2, 3, 50, 1000, rng.randint(0, 20)]) for _ in range(rng.randint(0, 200))]
        histogram = [(s, sizes.count(s)) for s in set(sizes)]
        assert expanded(sharding.schedule(histogram, shards), histogram) == plain(sizes, shards)


def test_groups_stay_together(spark):
    rows = [(1, "aa", 9), (2, "aa", 9), (None, "b", 9), (4, None, 9), (5, None, 9), (6, "", 9), (6, "", 9), (7, "long " * 5000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = sharding.placed(docs, 3).collect()
    assert len(out) == len(rows) and {"doc_id", "text", "shard", "__shard"} == set(out[0].asDict())
    homes = {}
    for r in out:
        homes.setdefault(r["text"], set()).add(r["__shard"])
    assert all(len(v) == 1 and None not in v for v in homes.values())
    assert homes["long " * 5000] == {0} and homes["aa"] == {1} and homes["b"] == {2}


def test_empty(spark):
    assert sharding.assignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0
