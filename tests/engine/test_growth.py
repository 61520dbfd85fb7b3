import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lexispan import catalog, service
from lexispan.functions import text as X
from lexispan.operators import lexical
from lexispan.plans.query import parse


@pytest.fixture(scope="module")
def chunks(spark):
    bodies = ["the quick brown fox, the quicker fox", "of the of then of  the", "getHTTPResponse XMLHttpRequest snake_case plain The", "", "ö of-the größe", "a1 v2Api fooBar_bazQux fox quick"]
    rows = [(k, None if k == 4 else f"docs/The/d{k}.md", b) for k, b in enumerate(bodies)] + [(9, "x.md", None)]
    return spark.createDataFrame(rows, "chunk_id long, path string, body string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text", ["the", "the quick", "of.the", "thanThe ofTo", "getHTTPResponse", "quick.brown.fo", "the of.the snake_case"])
def test_a_scan_scores_as_the_index_does(spark, chunks, text):
    c = chunks.where("path IS NOT NULL AND body IS NOT NULL")
    rows = lambda df: sorted((r["chunk_id"], round(r["bm25"], 9)) for r in df.collect())
    want = rows(lexical.scored(lexical.postings(c), lexical.corpus_stats(lexical.chunk_stats(c)), parse(text)))
    assert rows(lexical.scanned(c, parse(text))) == want


def test_a_search_without_an_index_cuts_terms_once(spark):
    c = catalog.chunks(spark, "/root/testdata/sf0.001")
    df = lexical.scanned(c, parse("the src1"))
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert final.count("Generate inline") == 1 and "ReusedExchange" in final


def test_postings_of_numpy_are_those_of_expressions(spark, chunks, monkeypatch):
    monkeypatch.setattr(lexical, "HELD", 5)
    rows = lambda df: sorted(map(str, (tuple(r[c] for c in ("term", "col", "chunk_id", "tf", "positions", "n_tokens")) for r in df.collect())))
    want = rows(lexical.postings(chunks))
    assert len(want) > 30 and rows(lexical.listed(chunks)) == want and rows(lexical.spread(lexical.grouped(chunks))) == want
    # Terms are put in order once: no filter asks for them before.
    assert plan(lexical.postings(chunks)).count("sort_array") == 1


def test_frequencies_also_with_copies_of_documents(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    d.unionByName(d.limit(7)).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    query, sql = catalog.QUERIES["tokenize_terms"]
    assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(db.execute(sql).fetchall())


def test_only_words_that_may_have_parts_are_taken_apart(spark):
    texts = ["The quick BROWN fooBar v2 a_b _x x_ HTTP2Server getHTTP aB ABc größeFoo fooBar ä_b Plain9 x1y2 A aBöc", "", "___ __a a__b ALL CAPS lower Ünder_score 9abc a9"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    names = F.array_distinct(F.regexp_extract_all("t", F.lit(X.IDENTIFIER), F.lit(0)))
    several = F.filter(F.transform(names, X.identifier_parts), lambda x: F.size(x) > 1)
    want = F.array_distinct(F.transform(several, lambda x: F.array_join(x, " ")))
    for r in rows.select(want.alias("want"), X.expansions(F.col("t")).alias("got"), "t").collect():
        assert r["got"] == r["want"]
    assert re.findall(X.SEVERAL.replace("*+", "*").replace("++", "+"), texts[0])[:3] == ["fooBar", "v2", "a_b"]


def test_files_are_opened_once_and_by_many_tasks(spark, tmp_path, monkeypatch):
    for k in range(40):
        (tmp_path / f"f{k}.md").write_text(f"the text of {k}")
    times, parts, opened = spark.sparkContext.accumulator(0), [], service.source.opened

    def seen(rows, probe):
        parts.append(rows.rdd.getNumPartitions())
        count = lambda batches: (times.add(b.num_rows) or b for b in batches)
        return opened(rows.mapInArrow(count, rows.schema), probe)

    monkeypatch.setattr(service.source, "opened", seen)
    assert service.Index(spark, str(tmp_path)).rebuild().files_indexed == 40
    assert times.value == 40 and parts == [spark.sparkContext.defaultParallelism]
