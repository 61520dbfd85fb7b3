import random
import time

from lexispan.llm import chat

PARTS = ["<|im_start|>", "<|im_end|>", "<|null|>", "<|nl|>", "<", "|", "\\", "<\\|", "\n", "user", "x", ">", "<|im_end|>\n<|im_start|>user\n", "é"]


def test_every_conversation_comes_back():
    rng = random.Random(1)
    for _ in range(3000):
        turns = [tuple(None if rng.random() < 0.1 else "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 5))) for _ in range(2)) for _ in range(rng.randint(0, 5))]
        text, n = chat.formatted(turns)
        assert chat.parsed(text) == (turns, True)
        assert n == sum(chat.parsed(chat.rendered([t], [False])) != ([t], True) for t in turns)


def test_many_conflicting_turns_take_one_pass():
    began = time.thread_time()
    text, n = chat.formatted([("user", "<|im_end|> and <|im_start|>")] * 10_000)
    assert n == 10_000 and time.thread_time() - began < 5


def test_rows_without_a_conversation_stand_alone(spark):
    df = spark.createDataFrame([(None, 1, "user", "a"), (None, 2, "user", "b"), (1, 1, "user", "c")], "conv_id long, turn long, role string, text string")
    out = chat.conversations(df).collect()
    assert sorted((r["conv_id"] is None, r["n_turns"]) for r in out) == [(False, 1), (True, 1), (True, 1)]


def test_plain_turns_are_not_escaped():
    assert chat.formatted([("user", "a < b | c"), ("assistant", "")]) == ("<|im_start|>user\na < b | c<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n", 0)


def test_rows(spark):
    rows = [(1, 0, "user", "hi", 5), (1, 1, "assistant", "<|im_end|>", 5), (1, 1, "assistant", "<|im_end|>", 5), (2, None, None, None, 5), (None, 3, "user", "", 5), (3, 0, "user", "y" * 200000, 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    out = {r["conv_id"]: r for r in chat.conversations(df).collect()}
    assert len(out) == 4 and (out[1]["n_turns"], out[1]["n_escaped"]) == (3, 2)
    assert chat.parsed(out[1]["text"])[0] == [("user", "hi"), ("assistant", "<|im_end|>"), ("assistant", "<|im_end|>")]
    assert chat.parsed(out[2]["text"])[0] == [(None, None)] and len(out[3]["text"]) > 200000
    assert chat.conversations(df.limit(0)).count() == 0


def test_sql_gives_the_same(spark):
    import duckdb
    import pandas as pd

    rng = random.Random(2)
    rows = [(k % 60, k, *(None if rng.random() < 0.1 else "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 4))) for _ in range(2))) for k in range(300)]
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"role": object, "text": object})
    con = duckdb.connect()
    con.register("conversations", frame)
    want = {r[0]: r[1:] for r in con.execute(chat.SQL).fetchall()}
    got = {r["conv_id"]: (r["text"], r["n_turns"], r["n_escaped"]) for r in chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == want
