import random

import duckdb
import numpy as np
import pandas as pd

from lexispan.llm import langid, mixing, quality


def test_quality_against_sql(spark):
    rng = random.Random(1)
    lines = ["A sentence ends here.", "no end", "a | b | c", "Licensed under MIT", "the the the the x.", "###!! @@ b.", "", "  ", "Über «quote!»", 'He said "so."', "one | two.", "LOREM IPSUM dolor.", "\ttab. ", "§ 5 …", "文章在这里。", "वाक्य यहाँ है।", "جملة؟"]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 8)))) for k in range(400)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = sorted(con.execute(quality.REPORT_SQL).fetchall())
    got = sorted(tuple(r) for r in quality.report(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "n_lines", "n_removed").collect())
    names = [d[0] for d in con.execute(quality.REPORT_SQL).description]
    assert got == sorted(tuple(r[names.index(c)] for c in ("doc_id", "text", "n_lines", "n_removed")) for r in want)


def test_quality_edges(spark):
    rows = [(None, "Fine text here.", "a"), (1, None, "a"), (2, "", "a"), (2, "Fine text here.", "a"), (2, "Fine text here.", "a"), (3, "A long one. " * 30000, "a"), (4, "|" * 50 + "\nFine.", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    out = quality.cleaned(docs)
    assert out.columns == docs.columns and sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 2, 2, 3]
    assert quality.cleaned(docs.limit(0)).count() == 0 and quality.report(docs).count() == 4


def test_boilerplate_is_loss_and_sentences_end_in_any_script(spark):
    notice = "All rights reserved by the holders of the rights.\n"
    rows = [(1, notice * 9 + "Fine text here."), (2, notice + "A text that is long enough to be worth the notice before it. " * 3), (3, "这是一个句子。\n另一个句子！"), (4, "यह एक वाक्य है।"), (5, "هل هذه جملة؟"), (6, "no end at all")]
    out = {r["doc_id"]: r["text"] for r in quality.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(out) == [2, 3, 4, 5] and "rights" not in out[2] and out[3] == rows[2][1]


def test_the_offset_is_drawn_by_seed():
    assert len({mixing.offset_of(s) for s in range(50)}) > 45 and all(0 <= mixing.offset_of(s) < mixing.UNIT for s in range(50)) and mixing.offset_of(mixing.SEED) == mixing.OFFSET


def test_mixing_is_one_systematic_draw_a_source(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(50)]), rng.choice([None, "src0", "src1", "z", ""]), rng.choice([None, "", "x" * rng.randint(1, 300)]), 7) for _ in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, copies int")
    out = mixing.sampled(docs).collect()
    chars = {}
    for _, s, t, _ in rows:
        chars[s] = chars.get(s, 0) + len(t or "")
    weight = {s: mixing.WEIGHTS.get(s, 1) for s in chars}
    for s, n in chars.items():
        rate = sum(chars.values()) * weight[s] * mixing.UNIT // (sum(weight.values()) * n)
        mine = [r for r in out if r["source"] == s]
        total = sum(1 for r in rows if r[1] == s)
        assert len(mine) == (mixing.OFFSET + total * rate) // mixing.UNIT - mixing.OFFSET // mixing.UNIT
    assert set(docs.columns) | {"__copy"} == set(mixing.sampled(docs).columns)
    assert mixing.sampled(docs.limit(0)).count() == 0 and mixing.sampled(docs, {"src0": 0, "src1": 0, "z": 0, "": 0}).where("source IS NOT NULL").count() == 0


def words(rng, stems, n):
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_held_out_accuracy_and_plain_scores(spark):
    rng = random.Random(3)
    stems = {"a": ["th", "er", "ing", "on"], "b": ["ción", "os", "qu", "er"], "c": ["ß", "ung", "ei", "on"]}
    rows = [(k, words(rng, stems[lang], rng.randint(5, 60)), lang) for k in range(300) for lang in [rng.choice("abc")]]
    names, logp = langid.train([r[1] for r in rows[:150]], [r[2] for r in rows[:150]])
    letter, lower = langid._tables()
    got, _ = langid.score([r[1] for r in rows[150:]], names, logp, letter, lower)
    assert np.mean([g == r[2] for g, r in zip(got, rows[150:])]) > 0.97
    for g, r in zip(got, rows[150:180]):
        f, _ = langid.features([r[1]], letter, lower)
        assert g == names[int(np.argmax([logp[k][f].sum() for k in range(len(names))]))]
    extra = [(900, None, "a"), (901, "", "b"), (902, "123 !!", None), (None, "thering", None), (903, "ung" * 60000, "c"), (903, "ung" * 60000, "c")]
    docs = spark.createDataFrame([(*r, "m") for r in rows + extra], "doc_id long, text string, lang string, margin string")
    out = langid.identified(docs).collect()
    by = {r["doc_id"]: r["language"] for r in out}
    assert len(out) == len(rows) + 6 and by[900] is by[901] is by[902] is None and by[None] == "a" and by[903] == "c"
    assert langid.identified(docs.limit(0)).count() == 0 and langid.identified(docs.where("lang IS NULL")).where("language IS NOT NULL").count() == 0
