import random

import numpy as np
import pyarrow as pa
import pytest

from lexispan.llm import jaccard
from lexispan.llm.common import gram_sets, utf8


def alike(sets, threshold):
    n = range(len(sets))
    return {(i, j) for i in n for j in n if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold}


def components(n, pairs):
    home = list(range(n))
    for _ in range(n):
        for i, j in pairs:
            home[i] = home[j] = min(home[i], home[j])
    return home


def test_tree_is_exact():
    rng = random.Random(3)
    for _ in range(150):
        base = [rng.sample(range(60), rng.randint(1, 25)) for _ in range(rng.randint(1, 4))]
        sets = []
        for _ in range(rng.randint(1, 14)):
            s = set(rng.choice(base))
            for _ in range(rng.randint(0, 8)):
                s ^= {rng.randrange(80)}
            if s:
                sets.append(s)
        tree = jaccard.Tree([np.array(sorted(s), dtype=np.uint64) for s in sets])
        for threshold in (0.5, 0.8, 0.3):
            for i, s in enumerate(sets):
                want = {j for j, t in enumerate(sets) if len(s & t) / len(s | t) >= threshold}
                assert set(tree.alike(np.array(sorted(s), dtype=np.uint64), threshold)) == want and i in want


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def corpus():
    rng = random.Random(7)
    base = [words(rng, rng.choice([8, 80, 300])) for _ in range(25)]
    rows, k = [], 0
    for b in base:
        for _ in range(rng.choice([1, 1, 2, 4])):
            rows.append((k, " ".join(w if rng.random() > 0.04 else "zz" for w in b), "s"))
            k += 1
    copy = rows[0][1]
    return rows + [(k, copy, "s"), (k, copy, "s"), (None, copy, "s"), (k + 1, None, "s"), (k + 2, "", "s"), (k + 3, "", "s"), (k + 4, "one", "s"), (k + 5, "One!", "s"), (k + 6, "long " * 40000, "s")]


def at_the_threshold():
    """Pairs on their own, around the threshold, of several sizes, with a passage that many share, and short texts of frequent words."""
    rng = random.Random(11)
    passage, rows = words(rng, 30), []
    for k in range(120):
        size = rng.choice([4, 10, 40, 150])
        a = words(rng, size) + (passage if k % 3 == 0 else [])
        edits = rng.choice([0.1, 0.14, 0.17, 0.2])
        b = [w if rng.random() > edits else f"x{rng.randrange(4000)}" for w in a]
        rows += [(2 * k, " ".join(a), "s"), (2 * k + 1, " ".join(b), "s")]
    frequent = ["the", "of", "and", "to"]
    return rows + [(1000 + k, " ".join(rng.choice(frequent) for _ in range(rng.randint(1, 5))), "s") for k in range(60)]


def expected(rows, threshold=jaccard.THRESHOLD):
    grams, at = gram_sets(*utf8(pa.array([r[1] for r in rows])), jaccard.N)
    sets = [set(grams[at[i] : at[i + 1]].tolist()) for i in range(len(rows))]
    pairs = alike(sets, threshold)
    home = components(len(rows), pairs)
    members = {}
    for i, h in enumerate(home):
        members.setdefault(h, []).append(i)
    out = []
    for some in members.values():
        ids = [rows[i][0] for i in some if rows[i][0] is not None]
        if len(some) > 1:
            out += [(rows[i][0], min(ids), len({rows[j][1] for j in some if (i, j) in pairs} - {rows[i][1]})) for i in some]
    return sorted(out, key=str), home


@pytest.mark.parametrize("rows", [corpus(), at_the_threshold()])
def test_groups_and_thinned_against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, paths string").repartition(3)
    want, home = expected(rows)
    assert sorted(map(tuple, jaccard.groups(docs).collect()), key=str) == want
    kept = jaccard.thinned(docs)
    assert kept.columns == docs.columns
    left = [r["doc_id"] for r in kept.collect()]
    assert len(left) == len(set(home)) and len(set(left)) == len(left)


@pytest.mark.parametrize("few, held", [(0, 1 << 20), (0, 3), (64, 3)])
def test_buckets_of_too_many_pairs(spark, monkeypatch, few, held):
    """Every bucket of several classes, or of several sets, is too large and walked in blocks."""
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "HELD", held)
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 5)
    rows = at_the_threshold()[150:]
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string, paths string")).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)[0]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.groups(docs).count() == 0 and jaccard.thinned(docs).count() == 0
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " . ")], "doc_id long, text string")
    assert jaccard.groups(docs).count() == 0 and jaccard.thinned(docs).count() == 3


def test_pairs_that_share_a_gram_or_two_are_not_looked_at(spark, monkeypatch):
    """Buckets of all sizes hold pairs of different texts; their marks are read for those only that share SHARED buckets."""
    rng, seen, sieve = random.Random(5), [], jaccard.sieved
    phrases = [" ".join(words(rng, 2)) for _ in range(40)]
    rows = [(k, " ".join(f"u{k}x{i}" for i in range(40)) + " " + phrases[k % 40], "s") for k in range(400)]
    rows += [(1000 + k, t, s) for k, t, s in at_the_threshold()[:80]]
    monkeypatch.setattr(jaccard, "sieved", lambda pairs, *a: (seen.append(pairs.count()), sieve(pairs, *a))[1])
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string, paths string")).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)[0]
    assert sum(seen) < 400


def test_rows_without_a_label_stay_out_of_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    rows = spark.range(20000).selectExpr("xxhash64(id) AS v", "id")
    labels = rows.where("id % 100 = 0 AND id < 10000").selectExpr("v", "id + 1 AS c")
    got = {r["id"]: r["c"] for r in jaccard._labelled(rows, labels, ["v"]).collect()}
    assert got == {i: i + 1 if i % 100 == 0 and i < 10000 else None for i in range(20000)}
    met = rows.where(jaccard._met(labels)("v"))
    assert met.join(labels, "v", "left_semi").count() == 100 and met.count() < 300


def test_thinned_with_labels_too_many_to_be_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, paths string")
    want = sorted(map(tuple, jaccard.thinned(docs).collect()), key=str)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    got = jaccard.thinned(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == want


def test_buckets_open_in_rounds_and_only_for_grams_of_several_texts(spark, monkeypatch):
    rng, opened, buckets = random.Random(13), [], jaccard.buckets
    alone = [(2000 + k, " ".join(f"own{k}x{rng.randrange(10**6)}" for _ in range(200)), "s") for k in range(100)]
    rows = at_the_threshold() + alone
    monkeypatch.setattr(jaccard, "ROUND", 12000)
    monkeypatch.setattr(jaccard, "GATHERED", 3000)
    monkeypatch.setattr(jaccard, "buckets", lambda e, threshold: opened.append(e.count()) or buckets(e, threshold))
    docs = spark.createDataFrame(rows, "doc_id long, text string, paths string")
    assert sorted(map(tuple, jaccard.groups(docs).collect()), key=str) == expected(rows)[0]
    grams, at = gram_sets(*utf8(pa.array([r[1] for r in rows])), jaccard.N)
    # Half of each set and SHARED - 1 more are its prefix without a look at the others' grams.
    assert len(opened) == -(-len(grams) // jaccard.ROUND) > 2 and sum(opened) < 0.5 * sum(n / 2 for n in np.diff(at))
    assert max(opened) < 2 * sum(opened) / len(opened)


def test_no_table_but_the_labels_outlives_the_search_for_classes(spark, tmp_path):
    rows = [(k, t, "s") for k, t in enumerate(["a b c d e f", "a b c d e g", "x y z", "x y z q", "alone here"])]
    texts = jaccard._texts(spark.createDataFrame(rows, "doc_id long, text string, paths string"))
    assert jaccard.classes(texts, f"file://{tmp_path}").count() == 4
    assert [p.name for p in tmp_path.iterdir()] == ["labels"]
