import duckdb
import pytest

from lexispan import catalog
from lexispan.operators import chunking, lexical, vectors
from lexispan.plans.query import parse


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("index"))
    files = spark.createDataFrame([(f"d{i}.md", ".md", "the quick fox\n" * (i % 40) + f"word{i}") for i in range(200)], "path string, extension string, text string")
    chunking.chunks(files, 20, 5).write.parquet(f"{at}/chunks")
    c = spark.read.parquet(f"{at}/chunks")
    lexical.postings(c).repartitionByRange(4, "term").sortWithinPartitions("term", "chunk_id").write.parquet(f"{at}/postings")
    lexical.corpus_stats(lexical.chunk_stats(c)).write.parquet(f"{at}/stats")
    vectors.embed(c).write.parquet(f"{at}/vectors")
    return {n: spark.read.parquet(f"{at}/{n}") for n in ("chunks", "postings", "stats", "vectors")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_prefix_is_pushed_into_the_scan_of_sorted_postings(tables):
    p = plan(lexical.occurrences_by_chunk(tables["postings"], parse("quick")))
    assert "StringStartsWith" in p and "LessThanOrEqual(term,quick" in p
    assert "positions" not in p and p.count("Exchange") == 1
    assert lexical.occurrences_by_chunk(tables["postings"], parse("quick")).count() == tables["chunks"].where("contains(body, 'quick')").count()


def test_a_phrase_reads_positions_and_adds_no_join(tables):
    p = plan(lexical.occurrences_by_chunk(tables["postings"], parse("quick.fo")))
    assert "positions" in p and "Join" not in p


def test_top_k_is_a_bounded_sort_without_python(tables):
    q = tables["vectors"].first()["vec"]
    p = plan(vectors.top_k(tables["vectors"], q, 10))
    assert "TakeOrderedAndProject" in p and "Exchange" not in p and "Python" not in p and "PushedFilters: [IsNotNull(dim), IsNotNull(norm), EqualTo(dim,64), GreaterThan(norm" in p


def test_chunking_and_postings_stay_in_the_jvm(tables):
    for df in (tables["chunks"], lexical.postings(tables["chunks"]), lexical.chunk_stats(tables["chunks"])):
        assert "Python" not in plan(df) and "Arrow" not in plan(df)


def test_the_postings_query_returns_every_term_and_position(spark):
    at = "/root/testdata/sf0.001"
    query, sql = catalog.QUERIES["postings_df"]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    want = sorted((*r[:4], tuple(r[4])) for r in db.execute(sql).fetchall())
    rows = query(spark, at).collect()
    assert sorted((*r[:4], tuple(r["positions"])) for r in rows) == want
    assert sum(len(r["positions"]) for r in rows) == lexical.chunk_stats(catalog.chunks(spark, at)).agg({"n_tokens": "sum"}).first()[0]
    assert any(not r["term"].startswith("th") for r in rows) and any(len(r["positions"]) > 1 for r in rows)


def test_the_embedding_query_returns_whole_vectors_of_all_chunks(spark):
    at = "/root/testdata/sf0.001"
    query, sql = catalog.QUERIES["dummy_embed"]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    want = {r[0]: r[1:] for r in db.execute(sql).fetchall()}
    got = {r["chunk_id"]: (r["dim"], r["norm"], r["vec"]) for r in query(spark, at).collect()}
    assert got.keys() == want.keys() and len(got) == catalog.chunks(spark, at).count()
    assert all(len(v) == 64 == d and n == want[c][1] and v == pytest.approx(want[c][2], abs=2e-5) for c, (d, n, v) in got.items())


def test_the_embedding_query_keeps_the_sign_of_zero_as_its_sql_does(spark):
    at = "/root/testdata/sf0.01"
    query, sql = catalog.QUERIES["dummy_embed"]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    want = {r[0]: r[3] for r in db.execute(sql).fetchall()}
    got = {r["chunk_id"]: r["vec"] for r in query(spark, at).collect()}
    assert any(repr(x) == "-0.0" for v in want.values() for x in v)
    assert {c: list(map(repr, v)) for c, v in got.items()} == {c: list(map(repr, v)) for c, v in want.items()}
