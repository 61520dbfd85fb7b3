"""Text files as a source: listing, filters with the reason of each skip, and text.

The listing is made by os.walk, which prunes excluded folders as it goes, sees empty files and has times to 100 ns. What is decided by name and
size is decided on the listing; only files that are left are opened, by tasks, a file each row, and read once: the binary probe and the decoding work
on the same bytes. With a listing from elsewhere (an object store's inventory) the same functions apply.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.settings import Settings
from lexispan.sources.ignore import ignored, rules_of

LISTING = "path string, abs_path string, extension string, size_bytes long, last_write_utc_ticks long"
EPOCH_TICKS = 621355968000000000
#: Files that a task holds at once.
TOGETHER = 64


def roots(workspace: str, settings: Settings) -> list[str]:
    """The workspace and the extra folders that exist; rooted names and names with ".." are left out."""
    out = [workspace]
    for r in settings.extra_include_roots:
        p = os.path.normpath(os.path.join(workspace, r.strip()))
        if r.strip() and os.path.isdir(p):
            out.append(p)
    return out


def _excluded(workspace: str, settings: Settings) -> list[str]:
    out = []
    for r in settings.exclude_roots:
        r = r.strip().replace("\\", "/")
        if r and not os.path.isabs(r) and ".." not in r.split("/") and os.path.isdir(p := os.path.normpath(os.path.join(workspace, r))):
            out.append(p.lower())
    return out


def walk(workspace: str, settings: Settings, keep_direct: bool = False) -> Iterator[tuple]:
    """Rows of the listing. keep_direct: files directly in an excluded root stay, only its folders are left out."""
    segments, gone = {s.lower() for s in settings.exclude_path_segments}, _excluded(workspace, settings)
    wanted = set(settings.extensions())
    for root in roots(workspace, settings):
        for folder, folders, names in os.walk(root):
            inside = lambda d: any(d.lower() == g or d.lower().startswith(g + os.sep) for g in gone)
            below = (lambda d: any(d.lower().startswith(g + os.sep) for g in gone)) if keep_direct else inside
            folders[:] = sorted(d for d in folders if d.lower() not in segments and not below(os.path.join(folder, d)))
            if below(folder):
                continue
            for name in sorted(names):
                ext = os.path.splitext(name)[1] or (name if name.startswith(".") and name.count(".") == 1 else "")
                if ext.lower() not in wanted:
                    continue
                full = os.path.join(folder, name)
                try:
                    st = os.stat(full)
                    size, ticks = st.st_size, EPOCH_TICKS + st.st_mtime_ns // 100
                except OSError:
                    size, ticks = None, None
                yield os.path.relpath(full, workspace).replace(os.sep, "/"), full, ext, size, ticks


def listing(spark: SparkSession, workspace: str, settings: Settings, keep_direct: bool = False) -> DataFrame:
    """path, abs_path, extension, size_bytes, last_write_utc_ticks; size and time are null where the file can't be looked at."""
    return spark.createDataFrame(list(walk(workspace, settings, keep_direct)), LISTING).dropDuplicates(["path"])


def denied(path: Column, segments: Sequence[str]) -> Column:
    """Whether a folder of the path is on the list, without regard to case."""
    low = F.concat(F.lit("/"), F.lower(path))
    verdict = F.lit(False)
    for s in segments:
        verdict = verdict | F.contains(low, F.lit(f"/{s.lower()}/"))
    return verdict


def skip_reason(settings: Settings, rules: Sequence[str]) -> Column:
    """Why a file of the listing isn't opened: denylist, gitignore, io_error or too_large; null if it is."""
    limit = settings.effective()["max_indexed_file_bytes"]
    path = F.col("path")
    return (
        F.when(denied(path, settings.exclude_path_segments), "denylist")
        .when(ignored(path, rules), "gitignore")
        .when(F.col("size_bytes").isNull(), "io_error")
        .when(F.col("size_bytes") > limit, "too_large")
    )


def decoded(data: bytes) -> str:
    """Text of a file by its byte order mark, else UTF-8; what isn't valid is replaced."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    return data.decode("utf-8", "replace")


def opened(files: DataFrame, probe: int) -> DataFrame:
    """files with text and reason: binary, io_error, or null with the text of the file."""

    def read(path: str) -> tuple[str | None, str | None]:
        try:
            with open(path, "rb") as f:
                data = f.read()
        except OSError:
            return None, "io_error"
        return (None, "binary") if b"\0" in data[:probe] else (decoded(data), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(lo, TOGETHER)
                done = [read(p) for p in part.column("abs_path").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([t for t, _ in done], pa.string()), pa.array([r for _, r in done], pa.string())], [*part.schema.names, "text", "reason"])

    schema = ", ".join(f"`{c}` {t}" for c, t in files.dtypes)
    return files.mapInArrow(run, f"{schema}, text string, reason string")


def scanned(spark: SparkSession, workspace: str, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """The listing with column reason, and the rules that were applied are those of the workspace's ignore files."""
    rules = rules_of(workspace, settings.ignore_files)
    rows = listing(spark, workspace, settings).withColumn("reason", skip_reason(settings, rules))
    return rows, rows.where("reason IS NULL").drop("reason")
