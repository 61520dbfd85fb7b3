import random
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispan.functions import text as X
from lexispan.functions.snippet import snippet
from lexispan.operators import chunking, lexical
from lexispan.plans import query as Q

SPLITS = {"PlanBoardLeaf": "Plan Board Leaf", "BoardLeaf": "Board Leaf", "XMLHttpRequest": "XML Http Request", "getHTTPResponse": "get HTTP Response", "plain": "plain", "snake_case_id": "snake case id", "fooBar_bazQux": "fooBar bazQux", "_fooBar": "_foo Bar", "abc123": "abc 123", "2fa": "2 fa", "ABC": "ABC", "aB": "a B", "___": "___"}


def test_identifiers(spark):
    rows = spark.createDataFrame([(k,) for k in SPLITS], "i string").select("i", X.identifier_parts(F.col("i")).alias("p")).collect()
    assert {r["i"]: " ".join(r["p"]) for r in rows} == SPLITS
    assert {k: " ".join(Q.split_identifier(k)) for k in SPLITS} == SPLITS


def test_random_identifiers_split_alike(spark):
    rng = random.Random(1)
    names = list({"".join(rng.choice("aBcDE12_é") for _ in range(rng.randint(1, 9))) for _ in range(2000)})
    rows = spark.createDataFrame([(n,) for n in names], "i string").select("i", X.identifier_parts(F.col("i")).alias("p")).collect()
    assert all(r["p"] == Q.split_identifier(r["i"]) for r in rows)


def test_body_keeps_its_text_and_gets_the_parts(spark):
    body = "class PlanBoardLeaf { int plain; PlanBoardLeaf x_y; }"
    out = spark.createDataFrame([(body,), ("nothing here",), ("",)], "b string").select(X.expanded_body(F.col("b"))).collect()
    assert [r[0] for r in out] == [body + "\n__lex_camel:\nPlan Board Leaf\nx y\n", "nothing here", ""]


def test_queries():
    assert Q.parse("BoardLeaf").tree == Q.Or((Q.Phrase(("boardleaf",)), Q.And((Q.Phrase(("board",)), Q.Phrase(("leaf",))))))
    assert Q.parse("  \t ").tree is None and Q.parse(None).tree is None and Q.parse('""').tree is None
    assert Q.parse("it's").tree == Q.Phrase(("its",)) and Q.parse("***").tree == Q.Phrase(())
    assert Q.parse("foo.bar NOT").tree == Q.And((Q.Phrase(("foo", "bar")), Q.Phrase(("not",))))
    assert len(Q.parse(" ".join(f"t{'x' * i}" for i in range(30))).tree.parts) == 24


def loop(text, chunk, overlap):
    if not text:
        return []
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    size = max(20, chunk)
    step = max(1, size - min(max(overlap, 0), size - 1))
    out, i = [], 0
    while True:
        out.append((i + 1, min(i + size, len(lines)), "\n".join(lines[i : i + size])))
        if i + size >= len(lines):
            return out
        i += step


def test_windows_are_those_of_the_loop(spark):
    rng = random.Random(2)
    texts = ["", "a", "a\n", "\n" * 19, "\n" * 20, "a\r\nb\rc", *["\n".join(str(k) for k in range(n)) for n in (20, 21, 109, 110, 111, 206)]]
    texts += ["".join(rng.choice(["x", "\n", "\r\n", "\r"]) for _ in range(rng.randint(0, 300))) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").cache()
    for chunk, overlap in ((110, 15), (20, 5), (5, 0), (30, 99), (25, -3)):
        rows = df.select("i", F.explode(chunking.windows(F.col("t"), chunk, overlap)).alias("w")).collect()
        got = {}
        for r in rows:
            got.setdefault(r["i"], []).append(tuple(r["w"]))
        assert all(got.get(i, []) == loop(t, chunk, overlap) for i, t in enumerate(texts))


BODIES = ["the cat sat on the mat. The dog ran: fast. a b c d e f g h i j k l m n o p q r s t u v w x y z the end", "PlanBoard leaf", "board plan leaf", "foo bar baz", "foo x bar", "bar foo barn foo barn", "Überall naïve Ñandú æther", "the the the the the", "a.b_c-d e", "", "no match here " * 30 + "the cat. the dog", "theory of the them"]


def fts(queries):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table c using fts5(path, extension unindexed, ls unindexed, le unindexed, body, tokenize='unicode61 remove_diacritics 1')")
    for i, b in enumerate(BODIES):
        con.execute("insert into c(rowid, path, body) values (?, ?, ?)", (i, f"src/f{i}.md", b))
    for q in queries:
        yield {r[0]: r[1:] for r in con.execute("select rowid, bm25(c), snippet(c, ?, ?, ?, ?, ?) from c where c match ?", (4, "[", "]", " … ", 24, q))}


SEARCHES = {"the": '"the"*', "the cat": '"the"* AND "cat"*', "foo.bar": '"foo.bar"*', "f1": '"f1"* OR ("f"* AND "1"*)', "nai": '"nai"*', "the end mat": '"the"* AND "end"* AND "mat"*', "src": '"src"*', "nandu": '"nandu"*', "zzz": '"zzz"*'}


def test_search_against_an_fts_index(spark):
    try:
        wanted = dict(zip(SEARCHES, fts(SEARCHES.values())))
    except sqlite3.OperationalError:
        pytest.skip("no full-text module")
    c = spark.createDataFrame([(i, f"src/f{i}.md", ".md", 1, 1, b) for i, b in enumerate(BODIES)], "chunk_id long, path string, extension string, line_start int, line_end int, body string").cache()
    index, stats = lexical.postings(c).cache(), lexical.corpus_stats(lexical.chunk_stats(c)).cache()
    for text, want in wanted.items():
        q = Q.parse(text)
        got = {r["chunk_id"]: r["bm25"] for r in lexical.scored(index, stats, q).collect()}
        assert set(got) == set(want), text
        assert all(abs(got[i] - want[i][0]) < 1e-9 for i in got), text
        assert all(snippet(BODIES[i], q.phrases) == want[i][1] for i in got), [(snippet(BODIES[i], q.phrases), want[i][1]) for i in got if snippet(BODIES[i], q.phrases) != want[i][1]]
    assert lexical.search(c, index, stats, "***").count() == 0 and lexical.search(c, index, stats, "").count() == 0
    best = lexical.search(c, index, stats, "the", 3).collect()
    worst = lexical.search(c, index, stats, "the", 3, order="reference").collect()
    assert best[0]["rank_score"] < worst[0]["rank_score"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.: \n[]é", max_size=200))
def test_snippets_keep_the_text(body):
    s = snippet(body, [Q.Phrase(("a",))])
    assert s is not None and (s.startswith(" … ") or s.endswith(" … ") or s.replace("[", "").replace("]", "") == body.replace("[", "").replace("]", ""))
