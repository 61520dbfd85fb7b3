"""What the operators share: tables, the shared folder, and text of a whole Arrow batch as numpy arrays."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a worker turns into numpy arrays at once; bounds its memory whatever the batch.
SLICE_BYTES = 2 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Word bytes of the n-gram operators: ASCII letters and digits, and all of every other character.
WORD = np.zeros(256, dtype=bool)
WORD[ord("0") : ord("9") + 1] = WORD[ord("a") : ord("z") + 1] = WORD[ord("A") : ord("Z") + 1] = WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only a local session that has none set gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lexispan-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lexispan-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and is read again after the loss of an executor."""
    df.write.mode("overwrite").parquet(path := f"{folder}/{name}")
    return df.sparkSession.read.parquet(path)


def freed(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps whose results are tables by now; it does so when the driver collects its garbage, which may take long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def apart(work: Callable[[DataFrame], DataFrame], docs: DataFrame) -> DataFrame:
    """work on docs whose own columns of names in "__" are out of the way of the operator's, and have their names again in the result."""
    away = {c: f"own{i}.{c}" for i, c in enumerate(docs.columns) if c.startswith("__")}
    if not away:
        return work(docs)
    return work(docs.toDF(*[away.get(c, c).replace(".", "·") for c in docs.columns])).withColumnsRenamed({v.replace(".", "·"): k for k, v in away.items()})


def remove(spark: SparkSession, folder: str) -> None:
    """Drops a folder of intermediate tables once nothing reads them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, ends, data = col.buffers()
    at = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if ends is not None and len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about most bytes of text each; a longer text comes alone and whole."""
    _, at = utf8(batch.column(text))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = min(j, n)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of True, none of which crosses a row."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(n + 1, dtype=bool)
    edge[1:n] = inside[1:] != inside[:-1]
    edge[0] = edge[n] = True
    edge[at] = True
    cut = np.flatnonzero(edge)
    starts, ends = cut[:-1], cut[1:]
    keep = inside[starts]
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial of the bytes modulo 2^64 and the inverse powers, from which any stretch is hashed at once."""
    powers = np.full(len(data) + 1, BASE, dtype=np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    back = np.full(len(data) + 1, BASE_INVERSE, dtype=np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return sums, back


def stretch_hashes(sums: np.ndarray, back: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed((sums[ends] - sums[starts]) * back[starts])


def word_hashes(data: np.ndarray, at: np.ndarray, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, in order, and their rows."""
    data = LOWER[data]
    starts, ends, rows = runs(inside[data], at)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    return stretch_hashes(*rolling(data), starts, ends), rows


def gram_instances(words: np.ndarray, rows: np.ndarray, count: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of words, whose rows are in order: hash, row, first word and number of words. A row of 1 to n - 1 words has one gram, of them all."""
    per = np.bincount(rows, minlength=count)
    first = np.concatenate([[0], np.cumsum(per)])
    width = np.minimum(per, n)
    many = np.where(per > 0, per - width + 1, 0)
    owner = np.repeat(np.arange(count), many)
    where = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + first[owner]
    grams = np.zeros(len(owner), dtype=np.uint64)
    for k in range(n if len(owner) else 0):
        use = k < width[owner]
        grams = np.where(use, mixed(grams * BASE + words[np.minimum(where + k, len(words) - 1)] + np.uint64(k + 1)), grams)
    return grams, owner, where, width[owner]


def gram_sets(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every row, one row after the other, and their offsets."""
    count = len(at) - 1
    grams, owner, *_ = gram_instances(*word_hashes(data, at), count, n)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=count))]).astype(np.int64)
