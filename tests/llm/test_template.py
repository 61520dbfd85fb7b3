import json
import random
import time
from collections import Counter, defaultdict

from lexispan.llm import template as T


def page(rng, k):
    items = "".join(f'<li><a href="/{rng.random()}">n{rng.randrange(9**6)}</a></li>' for _ in range(rng.randint(1, 5)))
    body = "".join(f"<p>{' '.join(f'w{rng.randrange(9**6)}' for _ in range(rng.randint(1, 8)))} &amp; x</p>" for _ in range(rng.randint(0, 6)))
    return f"<html><head><title>t{k}</title><script>if (a<b) '</p>'</script></head><body><ul>{items}</ul><div class='m'>Posted by a{k}</div>{body}<!-- c --><i>end</i></body></html>"


def brute(pages, host):
    """Classes and slots of one host from whole vectors."""
    vectors, first = defaultdict(dict), Counter()
    for i, p in enumerate(pages):
        keys = T.tokens(p)[0]
        for k, n in Counter(keys).items():
            vectors[k][i] = n
            first[k] += keys.index(k)
    groups = defaultdict(list)
    for k, v in vectors.items():
        if len(v) >= T.SUPPORT * len(pages):
            groups[tuple(sorted(v.items()))].append(k)
    return [sorted(g, key=lambda k: first[k]) for g in groups.values() if len(g) >= T.SIZE]


def test_tokens_skip_scripts_and_quotes():
    keys, words = T.tokens("<a title='x>y' href=\"z\">A</a><script>1 < 2 </p></script><br/>B <p>C<p>D < E")
    assert [w for w in words if w] == ["A", "B", "C", "D", "<", "E"] and "p D" in keys and "<a @title='x>y'" in keys
    assert T.tokens("") == ([], []) and T.tokens("<a b='")[1] == ["<a", "b='"]


def test_template_against_whole_vectors(spark):
    rng = random.Random(3)
    rows = [(k, f"http://one.example/{k}", page(rng, k), "s") for k in range(60)]
    rows += [(100, "http://few.example/", "<p>a b</p>", "s"), (101, None, "<p>c</p>", "s"), (102, "http://one.example:80/x", None, "s"), (103, "nonsense", "", "s"), (104, "http://few.example/", "z " * 50000, "s"), (None, "http://few.example/", "q", "s"), (100, "http://few.example/", "<p>a b</p>", "s")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, slots string").repartition(5)
    out = T.extracted(df).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    known = T._Classes(sorted(brute([r[2] for r in rows[:60]], "one"), key=lambda c: -len(c)))
    for k in range(60):
        got = [(s["slot"], s["text"]) for s in by[k]["slots"]]
        assert [t for _, t in got] == [t for _, t in T.slots(rows[k][2], known)]
        assert [t for _, t in got][0] == f"t{k}" and f"a{k}" in [t for _, t in got]
        assert not any("Posted" in t or "end" in t.split() for _, t in got)
    assert [s["text"] for s in by[100]["slots"]] == ["a b"] and by[102]["slots"] is None and by[103]["slots"] == []
    assert by[101]["host"] is None and len(by[104]["slots"][0]["text"]) == 99999
    assert T.extracted(df.limit(0)).count() == 0


def test_crossing_classes_fall():
    lists = [["a", "b", "c", "d"], ["e", "f", "g"], ["h", "i", "j"]]
    facts = [(c, -1, 0, 10) for c in range(3)] + [(1, 0, 1, 10), (0, 1, -1, 10), (2, 0, -1, 10), (0, 2, -1, 10), (1, 2, -1, 10), (2, 1, -1, 10)]
    assert T.nested(lists, facts) == [lists[0], lists[1]]
    assert T.nested(lists, [(0, -1, 1, 10), (1, -1, 0, 10)]) == [lists[1]]


def test_hostile_markup_takes_time_in_proportion():
    for part in ("<script ", "<!--", "<a ", "<a \"", "<a>", "</b>", "<style>"):
        began = time.thread_time()
        T.tokens("<a>" * 1000 + part * (1_000_000 // len(part)))
        assert time.thread_time() - began < 8, part
    assert T.tokens("a <script> b <p>c")[1] == ["a", None] and T.tokens("a<!-- b <p>c")[1] == ["a", None]


def test_relations_of_many_classes(spark):
    """Against comparing every class with every other at each of its tokens."""
    rng = random.Random(5)
    lists = [[f"{c}.{i}" for i in range(3)] for c in range(5)]
    pages = []
    for _ in range(40):
        seq = []
        for c in rng.sample(range(5), 5):
            at = sorted(rng.randrange(len(seq) + 1) for _ in range(3))
            for k, p in enumerate(at):
                seq.insert(p + k, f"{c}.{k}")
        pages.append(seq)
    want = Counter()
    for seq in pages:
        gap, where = dict.fromkeys(range(5), -1), {}
        for k in seq:
            c, i = map(int, k.split("."))
            gap[c] = i if i < 2 else -1
            for a in range(5):
                if a != c and where.setdefault((c, a), gap[a]) != gap[a]:
                    where[c, a] = -1
        want.update((c, a, g) for (c, a), g in where.items())
    rows = [(k, "h", " ".join(x), json.dumps([[" " + t for t in x] for x in lists])) for k, x in enumerate(pages)]
    got = T.relations(spark.createDataFrame(rows, "page_id long, host string, html string, payload string")).where("outer >= 0").collect()
    assert {(r["inner"], r["outer"], r["gap"]): r["n"] for r in got} == dict(want)
