"""The index as a service: rebuild, reindex, search, hybrid search, explain, status, draft, vectors.

An index is a folder of snapshots. A snapshot is a folder of Parquet tables; the file CURRENT names the one that readers see and is replaced at once, so a
reader sees all of a rebuild or nothing. The vectors of a snapshot are named by its file VECTORS, which is replaced at once as well and says what made them.
Postings lie in the order of terms and chunks in that of ids, so a search reads only the row groups it needs. Expected
failures are values (no index, semantic search off, nothing to draft); errors of a rebuild are kept in the state and raised.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispan import settings as S
from lexispan.functions.snippet import snippets
from lexispan.functions.wordpiece import provider
from lexispan.operators import chunking, headers, lexical, reindex, vectors
from lexispan.plans.query import parse
from lexispan.sources import files as source
from lexispan.sources.ignore import rules_of
from lexispan.streaming.observer import Observer, notify

FORMAT_VERSION = 2
EPOCH_TICKS = source.EPOCH_TICKS
#: Bytes of files that a task opens, or so.
TASK_BYTES = 16 << 20
VECTORS = "chunk_id long, dim int, norm double, vec array<float>, updated_at_utc_ticks long"


@dataclass
class ReindexSummary:
    files_indexed: int
    skipped_large: int
    skipped_binary: int
    skipped_excluded: int
    skipped_reason_counts: dict[str, int]
    top_prefixes: list[tuple[str, int]]
    sample: list[tuple[str, str]]
    duration: float


@dataclass
class IndexStatus:
    format_version: int
    database_path: str
    exists: bool
    document_count: int
    may_be_stale: bool
    indexed_at: str | None
    workspace_root: str
    last_error: str | None
    last_error_at: str | None
    settings_source: str
    settings_error: str | None
    settings: dict | None
    reindex_state: str | None
    reindex_started_at: str | None


@dataclass
class SearchResponse:
    format_version: int
    query: str
    database_path: str
    hits: list = field(default_factory=list)
    error: str | None = None


@dataclass
class ExplainHitResponse:
    format_version: int
    database_path: str
    hit: object | None
    error: str | None


@dataclass
class DocDraftResponse:
    format_version: int
    database_path: str
    title: str
    markdown: str
    error: str | None


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f0Z")


def safe_segment(name: str) -> str:
    """A name of letters, digits, "-", "_" and "."; anything else becomes "-"."""
    return "".join(c if c.isalnum() or c in "-_." else "-" for c in name or "").strip("-")


def scope_folder(base: str, workspace: str, solution: str | None) -> str:
    """Folder of the index, or of that of one solution below it."""
    if not solution or not solution.strip():
        return base
    full = os.path.normpath(os.path.join(workspace, solution.strip()))
    name = safe_segment(os.path.splitext(os.path.basename(full))[0]) or "solution"
    return os.path.join(base, f"{name}--{hashlib.sha256(full.encode()).hexdigest()[:12]}")


class Index:
    """One index of one workspace."""

    def __init__(self, spark: SparkSession, workspace: str, solution: str | None = None, folder: str = ".lexispan", legacy: str | None = None):
        """legacy: an older folder that is read as long as there is no index in folder."""
        self.spark, self.workspace = spark, os.path.abspath(workspace)
        place = lambda f: os.path.join(self.workspace, scope_folder(f, self.workspace, solution))
        self.path, self.folder = place(folder), folder
        self.places = [self.path] + ([place(legacy)] if legacy else [])

    # -- settings, state and snapshots ------------------------------------

    def settings(self) -> S.Settings:
        """Settings of the scope's folder; a settings file of the workspace's index, or of the older folder, is taken over by a new one."""
        mine, shared = os.path.join(self.path, "settings.toml"), os.path.join(self.workspace, self.folder, "settings.toml")
        for other in [shared, *(os.path.join(p, "settings.toml") for p in self.places[1:])]:
            if not os.path.isfile(mine) and os.path.isfile(other):
                os.makedirs(self.path, exist_ok=True)
                shutil.copyfile(other, mine)
        return S.load(self.path)

    def meta(self) -> dict[str, str]:
        try:
            with open(os.path.join(self.path, "meta.json"), encoding="utf-8") as f:
                return json.load(f)
        except (OSError, ValueError):
            return {}

    def _tell(self, **values: str) -> None:
        os.makedirs(self.path, exist_ok=True)
        self._replace("meta.json", json.dumps(self.meta() | {"format_version": str(FORMAT_VERSION)} | values))

    def _replace(self, name: str, text: str) -> None:
        part = os.path.join(self.path, f"{name}.{uuid.uuid4().hex}")
        with open(part, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(part, os.path.join(self.path, name))

    def current(self) -> str | None:
        for place in self.places:
            try:
                with open(os.path.join(place, "CURRENT"), encoding="utf-8") as f:
                    return os.path.join(place, f.read().strip())
            except OSError:
                continue
        return None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.current(), self._vectors()["table"] if name == "vectors" else name))

    def has(self, name: str) -> bool:
        at = self.current()
        if name == "vectors":
            return bool(self._vectors())
        return bool(at) and os.path.isdir(os.path.join(at, name))

    def _vectors(self) -> dict:
        """Folder of the vectors in the current snapshot, and the settings they were made with; empty if there are none."""
        try:
            with open(os.path.join(self.current() or "", "VECTORS"), encoding="utf-8") as f:
                return json.load(f)
        except (OSError, ValueError):
            return {}

    def _snapshot(self, chunks: DataFrame, state: DataFrame) -> str:
        name = f"snapshot-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        at = os.path.join(self.path, name)
        written = lexical.store(chunks, at)
        state.write.parquet(f"{at}/file_state")
        if known := self._vectors():  # ids name path and line, so vectors stay right; those of chunks that are gone or changed go
            body = lambda df: df.select("chunk_id", F.xxhash64("body").alias("h"), F.xxhash64(F.lit(1), "body").alias("g"))
            same = body(self.table("chunks")).join(body(written), ["chunk_id", "h", "g"], "left_semi").select("chunk_id")
            self.table("vectors").join(same, "chunk_id", "left_semi").write.parquet(f"{at}/vectors")
            self._replace(os.path.join(name, "VECTORS"), json.dumps(known | {"table": "vectors"}))
        return name

    def _clean(self, keep: Sequence[str | None]) -> None:
        """Drops snapshots and work folders but some; those of runs that failed as well."""
        for old in os.listdir(self.path):
            if old.startswith(("snapshot-", "work-")) and os.path.join(self.path, old) not in keep:
                shutil.rmtree(os.path.join(self.path, old), ignore_errors=True)

    # -- indexing -----------------------------------------------------------

    def _files(self, rows: DataFrame, known: DataFrame, cfg: dict, work: str) -> tuple[DataFrame, DataFrame]:
        """Text files with their headers, and those that turn out not to be text."""
        # A listing is small and comes in a task or two; files are opened in as many as their bytes ask for, and once.
        total = rows.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
        source.opened(rows.repartition(tasks, "path"), cfg["binary_probe_bytes"]).write.parquet(f"{work}/opened")
        read = self.spark.read.parquet(f"{work}/opened")
        text = headers.with_header(headers.paired(read.where("reason IS NULL"), known))
        return text, read.where("reason IS NOT NULL").select("path", "reason")

    def rebuild(self, observers: Sequence[Observer] | None = None) -> ReindexSummary:
        """Indexes everything anew."""
        return self._run(True, observers)

    def reindex(self, observers: Sequence[Observer] | None = None, keep_newly_skipped: bool = False) -> ReindexSummary:
        """Indexes what changed since the last snapshot and drops what is gone. keep_newly_skipped: files that are now skipped stay as they were."""
        return self._run(self.current() is None, observers, keep_newly_skipped)

    def _run(self, full: bool, observers: Sequence[Observer] | None, keep_newly_skipped: bool = False) -> ReindexSummary:
        began, previous = time.time(), self.current()
        self._tell(reindex_state="running", reindex_started_at=now(), reindex_error="", reindex_error_at="")
        try:
            config = self.settings()
            config = replace(config, exclude_path_segments=[*config.exclude_path_segments, self.folder.split(os.sep)[0]])  # the index isn't part of what it indexes
            cfg = config.effective()
            work = os.path.join(self.path, f"work-{uuid.uuid4().hex}")
            listed = source.listing(self.spark, self.workspace, config).withColumn("reason", source.skip_reason(config, rules_of(self.workspace, config.ignore_files)))
            listed.write.parquet(f"{work}/listing")
            listed = self.spark.read.parquet(f"{work}/listing")
            seen = listed.where("reason IS NULL").drop("reason")
            rows = seen if full else reindex.changed(seen, self.table("file_state"))
            text, unread = self._files(rows, listed, cfg, work)
            text.write.parquet(f"{work}/files")
            unread.write.parquet(f"{work}/unread")
            text, unread = self.spark.read.parquet(f"{work}/files"), self.spark.read.parquet(f"{work}/unread")
            skips = listed.where("reason IS NOT NULL").select("path", "reason").unionByName(unread)
            notify(text.select(F.lit(self.workspace).alias("workspace_root"), "path", "abs_path", "extension", "text", "last_write_utc_ticks"), observers)
            chunks = chunking.chunks(text, cfg["chunk_lines"], cfg["chunk_overlap_lines"])
            state = text.select("path", "size_bytes", "last_write_utc_ticks")
            if not full:
                here = listed if keep_newly_skipped else seen.join(unread, "path", "left_anti")
                gone = reindex.stale(self.table("file_state"), here)
                chunks = reindex.merged_chunks(self.table("chunks"), chunks, text.select("path").unionByName(gone.select("path")))
                state = reindex.merged_state(self.table("file_state"), state, gone)
            name = self._snapshot(chunks, state)
            self._replace("CURRENT", name)
            n = text.where("text <> ''").count()
            t = reindex.tallies(skips).first()
            summary = ReindexSummary(n, t[0], t[1], t[2], {r[0]: r[1] for r in reindex.skip_counts(skips).collect()}, [tuple(r) for r in reindex.top_prefixes(skips).collect()], [tuple(r) for r in reindex.sample(skips).collect()], time.time() - began)
            self._clean([previous, self.current()])  # the one before stays for readers that opened it
            self._tell(indexed_at=now(), workspace_root=self.workspace, reindex_state="idle", reindex_error="", reindex_error_at="")
            return summary
        except BaseException as e:
            self._clean([previous, self.current()])
            self._tell(reindex_state="error", reindex_error=f"{type(e).__name__}: {e}"[:2000], reindex_error_at=now())
            raise

    def _embedder(self, config: S.Settings):
        return provider(config.embedding_provider, self.path, config.embedding_model_path, config.embedding_vocab_path, config.embedding_dim, config.embedding_sequence_length or 128, config.embedding_do_lower_case, config.embedding_prefer_gpu)

    def reindex_vectors(self) -> tuple[int, str | None]:
        """Embeds the chunks that have no vector by the settings at hand; the number of vectors, or an error. Vectors of other settings are made anew."""
        if self.current() is None or os.path.dirname(self.current()) != self.path:
            return 0, "Index database not found; run reindex."
        config = self.settings()
        if not config.semantic_enabled:
            return 0, "Semantic search is disabled in the settings."
        allowed, chunks, embed = config.vector_extensions(), self.table("chunks"), self._embedder(config)
        made_by = {k: getattr(config, k) for k in ("embedding_provider", "embedding_model_path", "embedding_vocab_path", "embedding_dim", "embedding_sequence_length", "embedding_do_lower_case")}
        stamp, name = EPOCH_TICKS + time.time_ns() // 100, f"vectors-{uuid.uuid4().hex}"
        known = self._vectors()
        kept = known and known.get("made_by") == made_by
        old = vectors.prune(self.table("vectors"), chunks, allowed) if kept else self.spark.createDataFrame([], VECTORS)
        new = vectors.embed(chunks.join(old.select("chunk_id"), "chunk_id", "left_anti"), allowed, lambda text, **_: embed(text), now_ticks=stamp)
        old.unionByName(new).write.parquet(os.path.join(self.current(), name))
        self._replace(os.path.join(os.path.basename(self.current()), "VECTORS"), json.dumps({"table": name, "made_by": made_by}))
        if known and known["table"] != name:
            shutil.rmtree(os.path.join(self.current(), known["table"]), ignore_errors=True)
        n, dim = self.table("vectors").agg(F.count("*"), F.max("dim")).first()
        self._tell(vec_dim=str(dim or 0), vec_indexed_at=now())
        return n, None

    # -- queries --------------------------------------------------------------

    def _missing(self, query: str) -> SearchResponse:
        return SearchResponse(FORMAT_VERSION, query, self.path, [], "Index database not found; run reindex.")

    def search(self, query: str, n: int = lexical.TOP, path_prefix: str | None = None, exclude_prefixes: list[str] | None = None, extensions: list[str] | None = None, order: str = "best_first") -> SearchResponse:
        """The n best hits with snippets; order "reference" has the weakest matches first."""
        if self.current() is None:
            return self._missing(query)
        state = self.table("file_state") if self.has("file_state") else None  # a snapshot without it answers, only without times
        found = lexical.search(self.table("chunks"), self.table("postings"), self.table("corpus"), query, n, state, order, path_prefix, exclude_prefixes, extensions, body=True)
        back = order == "reference"
        snippet = snippets(parse(query).phrases)(F.col("body")).alias("snippet")
        rows = sorted(found.select(*[c for c in found.columns if c != "body"], snippet).collect(), key=lambda r: (-round(r["fts_score"], 9) if back else round(r["fts_score"], 9), r["hit_id"]))
        return SearchResponse(FORMAT_VERSION, query, self.path, rows)

    def search_hybrid(self, query: str, semantic: bool, alpha: float, beta: float, k: int, n: int = lexical.TOP, path_prefix: str | None = None, exclude_prefixes: list[str] | None = None, extensions: list[str] | None = None, order: str = "best_first", filter_vectors: bool = False) -> SearchResponse:
        """Fusion of the n lexical hits and the k nearest vectors. filter_vectors: the filters hold for vector hits too."""
        first = self.search(query, n, path_prefix, exclude_prefixes, extensions, order)
        config = self.settings()
        if first.error or not semantic or not config.semantic_enabled or not self.has("vectors"):
            return first
        q = self.spark.createDataFrame([(query,)], "text string").select(self._embedder(config)(F.col("text"))).first()[0]
        if sum(x * x for x in q) ** 0.5 <= vectors.LEAST_NORM:
            return first
        chunks = self.table("chunks")
        near = vectors.top_k(self.table("vectors"), q, k, chunks, config.vector_extensions())
        if filter_vectors:
            near = near.join(lexical.keep(chunks, path_prefix, exclude_prefixes, extensions).select("chunk_id"), "chunk_id", "left_semi")
        lex = self.spark.createDataFrame([(r["hit_id"], r["fts_score"]) for r in first.hits], "chunk_id long, bm25 double")
        best = vectors.fused(lex, near, alpha, beta, n)
        best = self.spark.createDataFrame(best.collect(), best.schema)  # n rows
        rows = F.broadcast(best).join(lexical.by_id(chunks, [r[0] for r in best.select("chunk_id").collect()]), "chunk_id")
        snips = {r["hit_id"]: r["snippet"] for r in first.hits}
        hits = lexical.hits(rows, self.table("file_state")).join(F.broadcast(best.select(F.col("chunk_id").alias("hit_id"))), "hit_id")
        schema = T.StructType([*hits.schema.fields, T.StructField("snippet", T.StringType())])
        bodies = {r[0]: r[1] for r in rows.select("chunk_id", "body").collect()}
        done = [(*r, snips.get(r["hit_id"], bodies.get(r["hit_id"]))) for r in hits.collect()]
        ranked = self.spark.createDataFrame(done, schema).collect()
        return SearchResponse(FORMAT_VERSION, query, self.path, sorted(ranked, key=lambda r: (-round(r["rank_score"], 9), r["hit_id"])))

    def explain_hit(self, hit_id: int) -> ExplainHitResponse:
        if self.current() is None:
            return ExplainHitResponse(FORMAT_VERSION, self.path, None, "Index database not found; run reindex.")
        row = lexical.explain_hit(self.table("chunks"), hit_id, self.table("file_state")).collect()
        return ExplainHitResponse(FORMAT_VERSION, self.path, row[0] if row else None, None if row else f"Hit not found: {hit_id}")

    def status(self) -> IndexStatus:
        config, m = self.settings(), self.meta()
        if self.current() is None:
            return IndexStatus(FORMAT_VERSION, self.path, False, 0, False, None, self.workspace, None, None, config.source, config.error, None, None, None)
        get = lambda k: m.get(k) or None
        return IndexStatus(FORMAT_VERSION, self.path, True, self.table("chunks").count(), get("reindex_state") == "running", get("indexed_at"), self.workspace, get("reindex_error"), get("reindex_error_at"), config.source, config.error, config.effective(), get("reindex_state"), get("reindex_started_at"))

    def draft_doc(self, title: str, changed_paths: Sequence[str]) -> DocDraftResponse:
        """Markdown outline over the first chunk of up to 200 paths, in their order."""
        answer = lambda text, err: DocDraftResponse(FORMAT_VERSION, self.path, title, text, err)
        if self.current() is None:
            return answer("", "Index database not found; run reindex.")
        if not changed_paths:
            return answer("", "changed_paths is empty.")
        paths = [p for p in (lexical.normal_prefix(x) for x in changed_paths[:200]) if p]
        found = {r["path"]: r for r in reindex.first_chunks(self.table("chunks").where(F.col("path").isin(paths))).collect()}
        out = [f"# {title}", "", "## Summary", "- TODO", "", "## Motivation", "- TODO", "", "## Changes", ""]
        for p in paths:
            out.append(f"### `{p}`")
            if r := found.get(p):
                out += [f"- extension: `{r['extension']}`", f"- lines: {r['line_start']}..{r['line_end']}", "", "```", r["excerpt"].rstrip(), "```", ""]
            else:
                out += ["- (no indexed content found for this path)", ""]
        return answer("\n".join([*out, "## Notes / Follow-ups", "- TODO", "", ""]), None)
