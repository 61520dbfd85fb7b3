import os

import pytest
from pyspark.sql import functions as F

from lexispan import settings as S
from lexispan.functions import wordpiece as W
from lexispan.functions.vectors import hash_embedding
from lexispan.operators import reindex, vectors
from lexispan.service import Index, scope_folder
from lexispan.sources import files as source
from lexispan.sources.ignore import compiled, ignored
from lexispan.streaming.observer import feed_counts, ingest, watched


def put(root, **files):
    for name, text in files.items():
        path = os.path.join(root, name.replace("__", "/").replace("_dot_", "."))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


@pytest.fixture
def workspace(tmp_path):
    root = str(tmp_path)
    put(root, src__PlanBoardLeaf_dot_cs="class PlanBoardLeaf {}", docs__a_dot_md="alpha beta\n" * 30, docs__b_dot_md="beta gamma", docs__empty_dot_md="", docs__bin_dot_md=b"a\0b", docs__big_dot_md="x" * 600000, bin__out_dot_md="beta", keep__skip_dot_json="beta", note_dot_txt="beta", utf_dot_md=b"\xef\xbb\xbf" + "beta ñ".encode())
    put(root, _dot_gitignore="*.json\n")
    return root


def paths(response):
    return sorted({h["path"] for h in response.hits})


def test_rebuild_search_reindex(spark, workspace):
    told = []
    index = Index(spark, workspace)
    assert index.search("beta").error and not index.status().exists and index.reindex_vectors()[1] and index.draft_doc("t", ["a"]).error
    s = index.rebuild([lambda df: told.extend(r["path"] for r in df.collect()), lambda df: 1 / 0])
    assert sorted(told) == ["docs/a.md", "docs/b.md", "docs/empty.md", "src/PlanBoardLeaf.cs", "utf.md"]
    assert s.files_indexed == 4 and s.skipped_reason_counts == {"too_large": 1, "binary": 1, "gitignore": 1} and (s.skipped_large, s.skipped_binary, s.skipped_excluded) == (1, 1, 1)
    for q in ("PlanBoardLeaf", "BoardLeaf", "boardl"):
        assert paths(index.search(q)) == ["src/PlanBoardLeaf.cs"] or q == "boardl"
    assert paths(index.search("beta")) == ["docs/a.md", "docs/b.md", "utf.md"] and "[beta]" in index.search("beta").hits[0]["snippet"]
    assert paths(index.search("beta", path_prefix="DOCS\\", exclude_prefixes=["docs/b"])) == ["docs/a.md"] and paths(index.search("beta", extensions=["cs"])) == []
    before = {(r["path"], r["line_start"]): r["body"] for r in index.table("chunks").collect()}
    os.remove(os.path.join(workspace, "docs/b.md"))
    put(workspace, docs__a_dot_md="delta", docs__new_dot_md="beta new")
    index.reindex()
    assert paths(index.search("beta")) == ["docs/new.md", "utf.md"] and paths(index.search("delta")) == ["docs/a.md"]
    after = {(r["path"], r["line_start"]): r["body"] for r in index.table("chunks").collect()}
    assert after[("utf.md", 1)] == before[("utf.md", 1)]
    again = Index(spark, workspace)
    again.rebuild()
    assert {(r["path"], r["line_start"]): r["body"] for r in again.table("chunks").collect()} == after
    status = index.status()
    assert status.exists and status.document_count == len(after) and status.reindex_state == "idle" and not status.may_be_stale and status.settings["chunk_lines"] == 110
    hit = index.search("delta").hits[0]
    assert index.explain_hit(hit["hit_id"]).hit["snippet"] == "delta" and index.explain_hit(5).error == "Hit not found: 5" and hit["last_write_utc_iso"].endswith("Z")
    draft = index.draft_doc("Title", ["/docs\\a.md", "gone.md"]).markdown
    assert "### `docs/a.md`\n- extension: `.md`\n- lines: 1..1\n\n```\ndelta\n```" in draft and "no indexed content" in draft and index.draft_doc("t", []).error


def test_vectors_and_fusion(spark, workspace):
    index = Index(spark, workspace)
    index.rebuild()
    assert index.reindex_vectors()[1]
    put(workspace, _dot_lexispan__settings_dot_toml='[semantic]\nenabled = true\nvec_remove_extensions = ["cs"]\n')
    n, err = index.reindex_vectors()
    assert err is None and n == index.table("chunks").where("extension <> '.cs'").count() == index.reindex_vectors()[0]
    both = index.search_hybrid("beta gamma", True, 0.5, 0.5, 5)
    kinds = {h["path"]: h["hit_kind"] for h in both.hits}
    assert kinds["docs/b.md"] == "text_fts" and "text_vector" in kinds.values() and "src/PlanBoardLeaf.cs" not in kinds
    assert paths(index.search_hybrid("beta gamma", False, 0.5, 0.5, 5)) == paths(index.search("beta gamma"))
    assert {h["hit_kind"] for h in index.search_hybrid("", True, 1, 1, 5).hits} == {"text_vector"}
    put(workspace, docs__b_dot_md="other words")
    index.reindex()
    assert index.table("vectors").count() == n - 1


def test_scopes_and_settings(tmp_path):
    a = scope_folder("i", "/w", "x/My App.sln")
    assert a.startswith("i/My-App--") and len(a.rpartition("--")[2]) == 12 and scope_folder("i", "/w", " ") == "i" and scope_folder("i", "/w", "/w/x/My App.sln") == a
    s = S.overlaid('[fts]\ninclude_extensions = []\nexclude_extensions = ["cs", "MD"]\nchunk_overlap_lines = 0\nmax_indexed_file_bytes = -1\n[semantic]\nvec_extensions_mode = "custom"\nvec_extensions = ["py", " .TS "]\nvec_add_extensions = ["py", "go"]\n')
    assert ".cs" in s.extensions() and ".md" not in s.extensions() and s.vector_extensions() == [".py", ".ts", ".go"]
    assert s.effective()["chunk_overlap_lines"] == 15 and s.effective()["max_indexed_file_bytes"] == 524288
    assert ".cs" not in S.overlaid("[fts]\ninclude_cs_in_fts = false\n").extensions()
    assert S.overlaid("[fts").error.startswith("TOMLDecodeError: ") and S.load(str(tmp_path)).source == "default"


def test_ignore_rules(spark):
    cases = [
        (["*.log"], {"a.log": True, "x/a.log": True, "a.logs": False}),
        (["/a.txt", "b/"], {"a.txt": True, "x/a.txt": False, "b": False, "b/c": True, "x/b/c/d": True}),
        (["x/**/y", "**/z", "q/**"], {"x/y": True, "x/1/2/y": True, "z": True, "1/z/f": True, "q/1": True, "q": False}),
        (["*", "!keep.md", "# c", "", "\\#x"], {"a": True, "keep.md": False, "#x": True}),
        (["a?c", "[ab]1", "[!ab]2", "a.b"], {"abc": True, "ac": False, "a1": True, "a2": False, "c2": True, "aXb": False, "a.b": True}),
    ]
    for rules, want in cases:
        rows = spark.createDataFrame([(k,) for k in want], "p string").select("p", ignored(F.col("p"), rules).alias("i")).collect()
        assert {r["p"]: r["i"] for r in rows} == want, rules
    assert compiled(["", "# x", "/"]) == []


def test_scan(spark, workspace):
    put(workspace, a__BIN__x_dot_md="x", a__OBJ_dot_MD="x", _dot_editorconfig="x", ex__direct_dot_md="x", ex__sub__y_dot_md="x")
    s = S.Settings(exclude_roots=["ex", "..", "/tmp", "nowhere"])
    names = {r["path"]: r["extension"] for r in source.listing(spark, workspace, s).collect()}
    assert names["a/OBJ.MD"] == ".MD" and names[".editorconfig"] == ".editorconfig" and "a/BIN/x.md" not in names and "ex/direct.md" not in names and "note.txt" not in names
    faithful = {r[0] for r in source.walk(workspace, S.Settings(exclude_roots=["ex"]), True)}
    assert "ex/direct.md" in faithful and "ex/sub/y.md" not in faithful
    assert source.decoded(b"\xef\xbb\xbfx") == "x" and source.decoded(b"\xff\xfea\0") == "a" and source.decoded(b"\xff") == "�"
    skips = spark.createDataFrame([("A/x", "binary"), ("a/y", "binary"), ("b", "io_error")], "path string, reason string")
    assert [tuple(r) for r in reindex.top_prefixes(skips).collect()] == [("A", 2), ("b", 1)]


def plain_embedding(text, dim):
    import hashlib

    import numpy as np

    h = hashlib.sha256(text.encode()).digest()
    raw = b"".join(hashlib.sha256(h + j.to_bytes(4, "little")).digest() for j in range(0, dim, 16))
    v = (np.frombuffer(raw, "<u2")[:dim] / 32767.5 - 1).astype(np.float32)
    return v * np.float32(1 / np.sqrt((v.astype(np.float64) ** 2).sum()))


def test_hash_embedding(spark):
    texts = ["", "abc", "ünï", "x" * 5000]
    for dim in (64, 20, 256, 5):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hash_embedding(F.col("t"), dim).alias("v")).collect()
        for r in rows:
            want = plain_embedding(r["t"], max(16, dim))
            assert len(r["v"]) == len(want) and max(abs(a - b) for a, b in zip(r["v"], want)) < 1e-6


def test_top_k_and_upkeep(spark):
    v = spark.createDataFrame([(1, 2, 1.0, [1.0, 0.0]), (2, 2, 0.0, [0.0, 0.0]), (3, 3, 1.0, [1.0, 0.0, 0.0]), (4, 2, 1.0, [0.6, 0.8]), (5, 2, 2.0, [2.0, 0.0]), (9, 2, 1.0, [0.0, 1.0])], "chunk_id long, dim int, norm double, vec array<float>")
    c = spark.createDataFrame([(i, e) for i, e in ((1, ".md"), (2, ".md"), (4, ".cs"), (5, ".MD"))], "chunk_id long, extension string")
    assert [r["chunk_id"] for r in vectors.top_k(v, [1.0, 0.0], 1).collect()] == [1, 5, 4, 9]
    assert sorted(r["chunk_id"] for r in vectors.top_k(v, [1.0, 0.0], 9, c, [".md"]).collect()) == [1, 5]
    assert sorted(r["chunk_id"] for r in vectors.prune(v, c, [".md"]).collect()) == [1, 2, 5] and vectors.prune(v, c, []).count() == 0
    lex = spark.createDataFrame([(1, -3.0), (7, -1.0)], "chunk_id long, bm25 double")
    near = spark.createDataFrame([(1, 0.5), (8, 0.2)], "chunk_id long, sim double")
    got = [(r["chunk_id"], r["hit_kind"], r["rank_score"]) for r in vectors.fused(lex, near, 2.0, 4.0, 5).collect()]
    assert got == [(8, "text_vector", 0.2), (7, "text_fts", -1.0), (1, "text_fts", -4.0)]


def test_wordpiece(spark, tmp_path):
    file = tmp_path / "vocab.txt"
    file.write_text("[PAD]\n[UNK]\n\n[CLS]\n[SEP]\nun\n##aff\n##able\n,\nhi\n")
    v = W.vocabulary(str(file))
    assert W.encode("Unaffable, hi zz", v, 12)[0] == [2, 4, 5, 6, 7, 8, 1, 3, 0, 0, 0, 0] and W.encode("hi " * 50, v, 8) == ([2] + [8] * 6 + [3], [1] * 8)
    assert W.encode("", v, 1)[0] == [2, 3] + [0] * 6 and W.pieces("x" * 201, v, 1) == [1] and W.encode("Hi", v, 8, lower=False)[0][1] == 1
    out = spark.createDataFrame([("hi",), (None,)], "t string").select(W.encoder(v, 8)(F.col("t")).alias("e")).collect()
    assert out[0]["e"]["ids"][:3] == [2, 8, 3]


def test_stream_of_files(spark, tmp_path):
    rows = [(i, "2024-01-01 0%d:00:00" % (i % 3), "a" if i % 2 else "b") for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, t string, event_type string").select("event_id", F.to_timestamp("t").alias("ts"), "event_type")
    df.write.parquet(str(tmp_path / "in"))
    got = []
    q = ingest(watched(spark, str(tmp_path / "in"), "event_id long, ts timestamp, event_type string"), lambda b, k: got.extend(r["event_id"] for r in b.collect()), str(tmp_path / "c"))
    q.awaitTermination(60)
    assert sorted(got) == list(range(12)) and feed_counts(df).agg(F.sum("n")).first()[0] == 12


def test_vectors_follow_the_settings(spark, workspace):
    index = Index(spark, workspace)
    settings = '[semantic]\nenabled = true\n[semantic.embeddings]\nprovider = "dummy"\ndim = {}\n'
    os.makedirs(index.path)
    for dim in (64, 128):
        with open(os.path.join(index.path, "settings.toml"), "w", encoding="utf-8") as f:
            f.write(settings.format(dim))
        index.reindex()
        n, error = index.reindex_vectors()
        assert error is None and n == index.table("chunks").count() and [r[0] for r in index.table("vectors").select("dim").distinct().collect()] == [dim]
        stamp = index.table("vectors").agg(F.max("updated_at_utc_ticks")).first()[0]
        index.reindex_vectors()
        assert index.table("vectors").agg(F.max("updated_at_utc_ticks")).first()[0] == stamp
    assert any(h["hit_kind"] == "text_vector" for h in index.search_hybrid("beta", True, 0.5, 0.5, 50).hits)
    assert not [x for x in os.listdir(index.path) if x.startswith("work-")]


def test_an_older_folder_is_read_until_there_is_an_index(spark, workspace):
    Index(spark, workspace, folder=".older").rebuild()
    index = Index(spark, workspace, legacy=".older")
    assert paths(index.search("PlanBoardLeaf")) == ["src/PlanBoardLeaf.cs"] and index.reindex_vectors()[1] and not os.path.exists(os.path.join(index.path, "CURRENT"))
    put(workspace, docs__b_dot_md="epsilon")
    index.reindex()
    assert paths(index.search("epsilon")) == ["docs/b.md"] and not Index(spark, workspace, folder=".older").search("epsilon").hits


def test_a_failed_run_leaves_nothing_behind(spark, workspace, monkeypatch):
    index = Index(spark, workspace)
    monkeypatch.setattr("lexispan.service.lexical.store", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.rebuild()
    assert not [x for x in os.listdir(index.path) if x.startswith(("work-", "snapshot-"))] and index.meta()["reindex_state"] == "error"
