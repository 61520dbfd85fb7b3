import random

import duckdb
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from lexispan.llm import jaccard, mixing, pieces, quality
from lexispan.llm.common import gram_sets, utf8

pytest.importorskip("public_tokenizers")


def corpus(rng):
    syllables = ["an", "er", "th", "ou", "é", "st", "in", "le"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(6, 14))).capitalize() + "."
    rows, toxic = [], {}
    for k in range(400):
        text = [sentence() for _ in range(rng.randint(2, 8))]
        if toxic.setdefault(k, k % 5 == 0):
            text = [s[:-1] + f" {rng.choice(['meany', 'rotter'])} {word()}." for s in text]
        elif k % 7 == 0:
            text += ["a | b | c | d"] * (1 if k % 2 else 40)
        rows.append((k, "\n".join(text), "en", f"src{rng.choice([0, 0, 0, 1, 2, 9])}"))
    for k in range(0, 60):
        base = rows[k * 3][1].split(" ")
        rows.append((1000 + k, " ".join(w if rng.random() > 0.02 else word() for w in base), "en", "src1"))
        toxic[1000 + k] = toxic[k * 3]
    rows += [(2000, rows[1][1], "en", "src0"), (2001, "", "en", "src0"), (2002, None, "en", None), (2003, rows[2][1], None, None)]
    return [(*r, len(r[1] or "")) for r in rows], toxic


def test_whole_run_against_single_steps(spark, tmp_path):
    rows, toxic = corpus(random.Random(8))
    docs = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    docs.to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame([(k, 1, int(v)) for k, v in toxic.items()], columns=["doc_id", "quality", "toxic"]).to_parquet(tmp_path / "labels.parquet")
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r["ids"]))
    con = duckdb.connect()
    con.register("documents", docs[docs.text.notna()])
    left = con.execute(quality.REPORT_SQL).df().merge(docs[["doc_id", "source"]], on="doc_id").sort_values("doc_id").reset_index(drop=True)
    assert 0 < len(left) < len(docs)
    left = left[[not any(w in t.lower() for w in ("meany", "rotter")) for t in left.text]].reset_index(drop=True)
    grams, at = gram_sets(*utf8(pa.array(left.text.tolist())), jaccard.N)
    sets = [set(grams[at[i] : at[i + 1]].tolist()) for i in range(len(left))]
    home = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= jaccard.THRESHOLD * len(sets[i] | sets[j]):
                a, b = home[i], home[j]
                home = [min(a, b) if h in (a, b) else h for h in home]
    left = left[[home[i] == i for i in range(len(left))]]
    con.register("documents", left[["doc_id", "source", "text"]])
    drawn = con.execute(mixing.MANIFEST_SQL).df()
    want = drawn.groupby("doc_id").size().to_dict()
    named = left[left.source.notna()].doc_id
    assert {k: len(v) for k, v in got.items() if k in set(named)} == {k: n for k, n in want.items() if k in set(named)}
    encoder, text = pieces.Encoder(pieces.load(pieces.default_model())), dict(zip(left.doc_id, left.text))
    for k, ids in got.items():
        assert len(set(ids)) == 1 and list(ids[0]) == encoder.encode([text[k]])[0].tolist()


def test_stages_pass_documents_on(spark, tmp_path):
    rows, toxic = corpus(random.Random(9))
    own = ["__v", "__size", "__copy", "__quality", "__source", "__turn", "__ids"]
    docs = spark.createDataFrame([(*r, *(c + str(r[0]) for c in own)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in own))
    pd.DataFrame([(k, 1, int(v)) for k, v in toxic.items()], columns=["doc_id", "quality", "toxic"]).to_parquet(tmp_path / "labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name.startswith("SentencePiece") or out.columns == docs.columns, name
        assert name.startswith("SentencePiece") or all(r[c] == c + str(r["doc_id"]) for r in out.collect() for c in own), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
