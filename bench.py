"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON.

An index is built once (rebuild); searches then run against its tables, as they do in use.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lexispan import catalog  # noqa: E402
from lexispan.operators import chunking, lexical, reindex, vectors  # noqa: E402

SF, CPUS, RUNS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "5"))
SEARCHES = {"bm25_1_term": "the", "bm25_3_terms": "the src1 en", "bm25_8_terms": "the of and to in is that it"}


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    out: dict[str, float] = {}
    at = tempfile.mkdtemp(prefix="bench-")

    def clock(name: str, work, runs: int = RUNS) -> None:
        times = []
        for _ in range(runs):
            began = time.time()
            work()
            times.append(time.time() - began)
        out[name] = round(statistics.median(times), 3)

    noop = lambda df: df.write.format("noop").mode("overwrite").save()

    def rebuild() -> None:
        lexical.store(chunking.chunks(catalog.files(spark, SF), catalog.CHUNK, catalog.OVERLAP), at)

    try:
        clock("rebuild", rebuild, 3)
        c, index, stats = (spark.read.parquet(f"{at}/{t}") for t in ("chunks", "postings", "corpus"))
        catalog.files(spark, SF).select("path", "size_bytes", "last_write_utc_ticks").write.parquet(f"{at}/state")
        state, now = spark.read.parquet(f"{at}/state"), catalog.files(spark, SF)
        for share in (0, 1, 10):
            touched = F.pmod(F.xxhash64("path"), F.lit(100)) < share
            new = now.withColumn("last_write_utc_ticks", F.col("last_write_utc_ticks") + touched.cast("long"))

            def incremental(new=new) -> None:
                some = reindex.changed(new, state)
                fresh = chunking.chunks(some, catalog.CHUNK, catalog.OVERLAP)
                noop(reindex.merged_chunks(c, fresh, some.select("path").unionByName(reindex.stale(state, new).select("path"))))

            clock(f"reindex_{share}_percent", incremental, 3)
        for name, text in SEARCHES.items():
            clock(name, lambda text=text: lexical.search(c, index, stats, text).collect())
        query = catalog._query_vector(spark, SF)
        v = catalog.stored(spark, SF)
        for k in (5, 50, 200):
            clock(f"cosine_topk_{k}", lambda k=k: vectors.top_k(v, query, k).collect())
        clock("embed", lambda: vectors.embed(c).write.mode("overwrite").parquet(f"{at}/vectors"), 2)
        own = spark.read.parquet(f"{at}/vectors")
        q = spark.range(1).select(vectors.embedder("dummy")(F.lit("the src1"))).first()[0]
        clock("hybrid_fusion", lambda: vectors.fused(lexical.top(lexical.scored(index, stats, lexical.parse("the src1")), 15), vectors.top_k(own, q, 50), 0.5, 0.5, 15).collect())
    finally:
        spark.stop()
        shutil.rmtree(at, ignore_errors=True)
    print(json.dumps({"metric": "retrieval queries, sum of medians", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": SF}))


if __name__ == "__main__":
    main()
