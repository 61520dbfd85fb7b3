import itertools
import random

import numpy as np
import pyarrow as pa

from lexispan.llm import toxicity as T


def test_marginals_against_all_paths():
    rng = np.random.default_rng(1)
    size = np.array([1, 5, 3, 7])
    first = np.cumsum(size) - size
    e, a = rng.normal(0, 2, size.sum()), rng.normal(0, 1, 5)
    r, q = T.forward_backward(e, a, first, size)
    got = T.sigmoid(r + q)
    for f, n in zip(first, size):
        total, on = 0.0, np.zeros(n)
        for path in itertools.product([0, 1], repeat=n):
            s = path[0] * a[4] + sum(e[f + i] for i in range(n) if path[i]) + sum(a[2 * x + y] for x, y in zip(path, path[1:]))
            total += np.exp(s)
            on += np.exp(s) * np.array(path)
        assert np.allclose(got[f : f + n], on / total)


def corpus(rng, n, stem="zorq"):
    syllables = ["an", "er", "th", "ou", "é", "st", "in", "le"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    texts, toxic = [], []
    for k in range(n):
        words = [word() for _ in range(rng.randint(20, 120))]
        bad = k % 4 == 0
        if bad:
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(["meany", "rotter", stem + word()])
        texts.append(" ".join(w + ("." if rng.random() < 0.1 else "") for w in words))
        toxic.append(bad)
    return texts, toxic


def test_held_out_accuracy_and_offsets():
    rng = random.Random(4)
    model = T.train(*corpus(rng, 800))
    texts, toxic = corpus(rng, 400)
    score, flag, begin, end, row = T.score(pa.array(texts), model)
    assert np.mean(flag == np.array(toxic)) > 0.98
    words = [texts[i][b:e] for b, e, i in zip(begin, end, row)]
    assert np.mean([w.split()[0].startswith(("meany", "rotter", "zorq")) for w in words]) > 0.98


def test_edges(spark):
    rng = random.Random(6)
    texts, toxic = corpus(rng, 500)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(600, None, "x"), (601, "", "x"), (None, "!!!", "x"), (602, "meany " * 30000, "x"), (602, "meany " * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic)] + [(None, 1, 1), (3, 1, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    out = T.scored(docs, labels).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert by[600]["score"] is None and not by[600]["toxic"] and by[601]["score"] == 0 and by[None]["score"] == 0
    assert by[602]["toxic"] and by[602]["spans"][0]["begin"] == 0
    kept = T.clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r["toxic"] for r in out)
    none = labels.where("toxic = 0")
    assert not any(r["toxic"] for r in T.scored(docs, none).collect())
    empty = spark.createDataFrame([], docs.schema)
    assert T.scored(empty, labels).count() == 0 and T.clean(docs, labels.limit(0)).count() == len(rows)
