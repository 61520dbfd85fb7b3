"""Queries of the service: documents are written as files of a workspace, indexed by rebuild and reindex, and asked through the index.

The workspace lies in the shared folder of the session, or in a temporary one of a local session, and is dropped when the answer is there.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lexispan.plans import fixtures, oracle
from lexispan.service import EPOCH_TICKS, Index
from lexispan.sources.files import opened

QUERY = "the src1"
SETTINGS = """[fts]
include_extensions = ["md", "cs", "json", "toml", "txt"]
chunk_lines = 20
chunk_overlap_lines = 5
"""
HITS = "path string, line_start int, line_end int, fts_score double, chunk_char_count int, last_write_utc_iso string"


def written(files: DataFrame, root: str) -> None:
    """Files of path and text, with the time of last_write_utc_ticks, written by tasks."""

    def run(rows: Iterator[Row]) -> None:
        for r in rows:
            at = os.path.join(root, r["path"])
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at, "wb") as f:
                f.write(r["text"].encode())
            ns = (r["last_write_utc_ticks"] - EPOCH_TICKS) * 100
            os.utime(at, ns=(ns, ns))

    files.where("text IS NOT NULL").select("path", "text", "last_write_utc_ticks").foreachPartition(run)


def served(files: Callable[[SparkSession, str], DataFrame], ask: Callable[[Index, DataFrame], DataFrame], settings: str = SETTINGS, ignore: str = "") -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        root = tempfile.mkdtemp(prefix="workspace-", dir=shared.removeprefix("file://") if shared and os.path.isdir(shared.removeprefix("file://")) else None)
        try:
            index = Index(spark, root)
            os.makedirs(index.path)
            for at, text in ((os.path.join(index.path, "settings.toml"), settings), (os.path.join(root, ".gitignore"), ignore)):
                with open(at, "w", encoding="utf-8") as f:
                    f.write(text)
            docs = files(spark, sf)
            written(docs, root)
            return ask(index, docs)
        finally:
            shutil.rmtree(root, ignore_errors=True)

    return query


def search(index: Index, docs: DataFrame) -> DataFrame:
    index.rebuild()
    return hits(index)


def hits(index: Index) -> DataFrame:
    rows = [(h["path"], h["line_start"], h["line_end"], round(h["fts_score"], 6), h["chunk_char_count"], h["last_write_utc_iso"]) for h in index.search(QUERY).hits]
    return index.spark.createDataFrame(rows, HITS)


def reindexed(index: Index, docs: DataFrame) -> DataFrame:
    """Spanish files grow by a line and those of src7 go, between a rebuild and a reindex."""
    index.rebuild()
    shutil.rmtree(os.path.join(index.workspace, "docs", "src7"), ignore_errors=True)
    written(docs.where("extension = '.toml' AND path NOT LIKE 'docs/src7/%'").withColumn("text", F.concat("text", F.lit("\nsrc1 the"))), index.workspace)
    index.reindex()
    return hits(index)


def accounts(index: Index, docs: DataFrame) -> DataFrame:
    """What a rebuild says of itself: chunks and files by status and summary, and skips by reason."""
    s = index.rebuild()
    rows = [("chunks", index.status().document_count), ("files", s.files_indexed), *s.skipped_reason_counts.items()]
    return index.spark.createDataFrame(rows, "what string, n long")


def vectors_of_settings(index: Index, docs: DataFrame) -> DataFrame:
    """Vectors by length after the settings have asked for another one."""
    index.rebuild()
    index.reindex_vectors()
    at = os.path.join(index.path, "settings.toml")
    with open(at, encoding="utf-8") as f:
        text = f.read()
    with open(at, "w", encoding="utf-8") as f:
        f.write(text.replace("dim = 64", "dim = 32"))
    index.reindex_vectors()
    rows = index.table("vectors").groupBy("dim").count().collect()
    return index.spark.createDataFrame([tuple(r) for r in rows], "dim int, n long")


def probed(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the files of fixtures.BLOBS are opened as binary, with a probe of 8 bytes."""
    root = tempfile.mkdtemp(prefix="blobs-")
    try:
        for name, text in fixtures.BLOBS:
            with open(os.path.join(root, name), "wb") as f:
                f.write(bytes.fromhex(text))
        rows = opened(spark.createDataFrame([(n, os.path.join(root, n)) for n, _ in fixtures.BLOBS], "name string, abs_path string"), 8)
        return spark.createDataFrame([(r["name"], r["reason"] == "binary") for r in rows.collect()], "name string, is_binary boolean")
    finally:
        shutil.rmtree(root, ignore_errors=True)


SEMANTIC = SETTINGS + '[semantic]\nenabled = true\n[semantic.embeddings]\nprovider = "dummy"\ndim = 64\n'
SCAN = SETTINGS.replace("[fts]\n", "[fts]\nmax_indexed_file_bytes = 4000\n")
_CHANGED = "FROM (SELECT doc_id, CASE lang WHEN 'es' THEN text || chr(10) || 'src1 the' ELSE text END AS text, lang, source FROM documents WHERE source <> 'src7')"
REINDEXED_SQL = oracle.search(QUERY, fresh=True).replace("FROM documents", _CHANGED)


def accounts_sql(ignored: str) -> str:
    return f"""WITH {oracle.FILES}, k AS (SELECT doc_id, CASE WHEN {ignored} THEN 'gitignore' WHEN size_bytes > 4000 THEN 'too_large' END AS reason FROM f),
{oracle.CHUNKS.replace(oracle.FILES, "q AS (SELECT f.* FROM f JOIN k USING (doc_id) WHERE reason IS NULL)").replace("FROM f WHERE text", "FROM q WHERE text")}
SELECT 'chunks' AS what, count(*) AS n FROM c UNION ALL SELECT 'files', count(*) FROM q WHERE text <> '' UNION ALL SELECT reason, count(*) FROM k WHERE reason IS NOT NULL GROUP BY reason"""


IGNORE = "\n".join(fixtures.RULES)
