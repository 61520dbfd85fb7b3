"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased, every run of what is no letter is one blank, and blanks stand around the text. Each n-gram of ORDERS
characters falls in one of FEATURES hash buckets. Counts of a bounded sample (PER_LANGUAGE labelled documents of each language,
whole texts, the same documents wherever they lie) give a matrix of log-probabilities, which is broadcast (FEATURES times
languages); a batch of texts is scored in numpy as a sparse matrix of features times it.

A null text, and one without letters, has language null and margin null. No labelled document: every language is null. Ties go
to the alphabetically first language. Labels that are null don't train. Very long texts are scored whole. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.llm.common import slices

ORDERS, FEATURES, PER_LANGUAGE, SMOOTHING, SLICE = (1, 2, 3), 1 << 16, 400, 0.5, 1 << 20
LETTER = np.zeros(0x110000, dtype=bool)
LOWER_POINT = np.arange(0x110000, dtype=np.uint32)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is a letter, and its lower case where that is one code point; made once in a process."""
    if not LETTER[97]:
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                LETTER[c] = True
                low = ch.lower()
                if len(low) == 1:
                    LOWER_POINT[c] = ord(low)
    return LETTER, LOWER_POINT


def points(texts: list[str | None], letter: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, a blank around each and for each run of other characters, and the row of each point."""
    joined = " " + "\n".join("" if t is None else t.replace("\n", " ") for t in texts) + " "
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.cumsum(raw == 10)
    is_letter = letter[raw]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of a run of others
    keep[0] = True
    keep |= raw == 10
    out = np.where(is_letter, lower[raw], 32).astype(np.uint32)
    return out[keep], row[keep]


def features(texts: list[str | None], letter: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket and row of every n-gram that has a letter and lies in one text."""
    p, row = points(texts, letter, lower)
    if len(p) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    feats, rows = [], []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            m = len(p) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, dtype=np.uint32)
            some = np.zeros(m, dtype=bool)
            for k in range(n):
                h = (h ^ p[k : k + m]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
                some |= p[k : k + m] != 32
            ok = some & (row[:m] == row[n - 1 :])
            feats.append((h % np.uint32(FEATURES))[ok])
            rows.append(row[:m][ok])
    return np.concatenate(feats).astype(np.int64), np.concatenate(rows)


def train(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages in order and log-probabilities, a row of FEATURES for each; every language has the same prior."""
    letter, lower = _tables()
    names = sorted(set(langs))
    counts = np.full((len(names), FEATURES), SMOOTHING)
    for k, name in enumerate(names):
        for t, lang in zip(texts, langs):
            if lang == name:
                counts[k] += np.bincount(features([t], letter, lower)[0], minlength=FEATURES)
    return names, np.log(counts / counts.sum(1, keepdims=True)) if names else counts


def score(texts: list[str | None], names: list[str], logp: np.ndarray, letter: np.ndarray, lower: np.ndarray) -> tuple[list[str | None], list[float | None]]:
    """Best language of each text and its lead in log-probability over the next, per n-gram."""
    f, row = features(texts, letter, lower)
    n = len(texts)
    order = np.argsort(row, kind="stable")
    f, row = f[order], row[order]
    per = np.bincount(row, minlength=n)
    if not names or not len(f):
        return [None] * n, [None] * n
    starts = np.cumsum(per) - per
    total = np.zeros((len(names), n))
    some = per > 0
    for k in range(len(names)):
        total[k, some] = np.add.reduceat(logp[k][f], starts[some])
    best = total.argmax(0)
    if len(names) > 1:
        top = np.sort(total, axis=0)
        lead = (top[-1] - top[-2]) / np.maximum(per, 1)
    else:
        lead = np.zeros(n)
    return [names[b] if s else None for b, s in zip(best, some)], [float(x) if s else None for x, s in zip(lead, some)]


def sample(docs: DataFrame, per: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """Texts and languages of the per labelled documents of each language that come first by hash of doc_id.

    Counts of the languages come first; a bound on the hash then leaves about twice as many rows as are wanted, so one pass reads texts."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    labelled = docs.where("lang IS NOT NULL")
    bound = F.lit(-1).cast("long")
    for name, n in labelled.groupBy("lang").count().collect():
        bound = F.when(F.col("lang") == name, F.lit(min(1 << 40, ((2 * per + 100) << 40) // n))).otherwise(bound)
    near = labelled.select("lang", "doc_id", "text", place.alias("place"), bound.alias("bound")).where("place < bound AND text IS NOT NULL")
    first: dict[str, list] = {}
    for r in near.select("lang", "place", "doc_id", "text").collect():
        first.setdefault(r["lang"], []).append((r["place"], r["doc_id"] or 0, r["text"]))
    texts, langs = [], []
    for name in sorted(first):
        for _, _, text in sorted(first[name])[:per]:
            texts.append(text)
            langs.append(name)
    return texts, langs


def identified(docs: DataFrame, per: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, language and margin of every document, trained on labelled ones of the same table."""
    texts, langs = sample(docs, per)
    names, logp = train(texts, langs)
    letter, lower = _tables()
    model = docs.sparkSession.sparkContext.broadcast((names, logp, np.packbits(letter), lower))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logp, bits, lower = model.value
        letter = np.unpackbits(bits)[: len(lower)].astype(bool)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                lang, margin = score(part.column("text").to_pylist(), names, logp, letter, lower)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(margin, pa.float64())], ["doc_id", "language", "margin"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, language string, margin double")
