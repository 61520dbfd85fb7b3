import random

import numpy as np
import pyarrow as pa
import pytest

from lexispan.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(pieces.default_model())


@pytest.fixture(scope="module")
def table(vocabulary):
    v = vocabulary
    raw = v.text.tobytes()
    skip = set(v.byte_ids.tolist())
    return {raw[v.text_at[i] : v.text_at[i + 1]]: i for i in range(len(v.text_at) - 1) if i not in skip and v.text_at[i] < v.text_at[i + 1]}


def plain(text, v, table):
    """Best path over the whole text, a position at a time."""
    raw = (" " + text).encode()
    best, came = [0.0] + [-1e300] * len(raw), [None] * (len(raw) + 1)
    for i in range(len(raw)):
        if best[i] == -1e300:
            continue
        step = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
        if best[i] + step * v.byte_score > best[i + step]:
            best[i + step], came[i + step] = best[i] + step * v.byte_score, (i, None)
        for k in range(i + 1, min(len(raw), i + 48) + 1):
            p = table.get(raw[i:k])
            if p is not None and best[i] + v.score[p] > best[k]:
                best[k], came[k] = best[i] + v.score[p], (i, p)
    return best[-1]


TEXTS = ["Hello world", "  two  blanks\nand\tmore ", "naïve ñandú 東京 🙂 \u0000", "▁marker ▁", "a" * 300, "x" * 5000 + " y", "\n\n", " ", "the of and"]


def test_best_path_and_round_trip(vocabulary, table):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice(["th", "er", " ", "é", "Q", "\n", "ing", "大", ".", " "]) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    ids, at = pieces.Encoder(vocabulary).encode(texts)
    for k, t in enumerate(texts):
        mine = ids[at[k] : at[k + 1]]
        assert pieces.decoded(mine.tolist(), vocabulary) == t
        score = sum(vocabulary.byte_score if i in vocabulary.byte_ids else vocabulary.score[i] for i in mine)
        assert abs(score - plain(t, vocabulary, table)) < 1e-6


def test_cache_restart_gives_the_same(vocabulary, monkeypatch):
    first = pieces.Encoder(vocabulary)
    a = [first.encode([t])[0] for t in TEXTS]
    monkeypatch.setattr(pieces, "CACHE", 1)
    second = pieces.Encoder(vocabulary)
    assert all(np.array_equal(x, second.encode([t])[0]) for x, t in zip(a, TEXTS))


def test_rows(spark):
    rows = [(1, "abc def", "x"), (1, "abc def", "y"), (2, None, None), (3, "", ""), (None, "▁ é\n", "z")]
    out = pieces.encoded(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert len(out) == 5 and all(r["round_trip"] for r in out)
    assert sorted((r["doc_id"] or 0, r["n_tokens"] > 0, r["ids"] is None) for r in out) == [(0, True, False), (1, True, False), (1, True, False), (2, False, True), (3, False, False)]
    assert pieces.encoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lists_are_decoded_together():
    from lexispan.llm import pieces as P

    v = P.load(P.default_model())
    texts = ["plain words", None, "", " ä ▁ 漢字 \n\n  x", "z" * 300]
    ids, at = P.Encoder(v).encode(texts)
    lists = [None if t is None else ids[a:b].tolist() for t, a, b in zip(texts, at, at[1:])] + [[int(v.byte_ids[0xE6])]]
    col = pa.array([[1, 2], *lists], pa.list_(pa.int32())).slice(1)
    assert P.texts_of(col, v) == [None if x is None else P.decoded(x, v) for x in lists] == [*texts, "\ufffd"]
