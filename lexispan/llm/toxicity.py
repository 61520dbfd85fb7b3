"""Toxicity: a linear-chain conditional random field tags toxic spans; its forward-backward marginals make document scores.

A text's words form one chain per sentence (ends: . ! ? and line ends). Each word has two states, plain and toxic; its features
are hashes of the word, of its beginnings of 3 to 8 bytes and of its last 4 bytes.

Labelled tokens come from a bounded sample of labelled documents (TOXIC and CLEAN of them, first by hash of doc_id): a token of a
toxic document is labelled toxic if the word or one of its beginnings is found almost only in toxic documents (PURITY) and so
often that chance is ruled out (EVIDENCE, a log-likelihood ratio). Occurrences count once for each pair of neighbours, so near
copies of one document prove nothing. Weights and transitions are then fitted by maximum likelihood on all sentences of the sample.

A document's score is a logistic function of the logarithms of the sum of its toxic marginals from 0.5 on and of their share, fitted on the sample and
shifted so that 0.5 tells most of it apart; from 0.5 on it is toxic. Spans are maximal runs of tokens of marginal 0.5 or more, as offsets in characters, end exclusive.

A null text has a null score, an empty one 0; neither is toxic. TOXIC and CLEAN bound what reaches the driver. Without toxic labels nothing is. Labels that contradict each other
count as toxic; labels without a document, and null ones, don't train. Very long texts are scored whole, sentences of any length in
one chain. Repeated rows are scored alike. Other columns pass through what is kept. No rows, no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.llm.common import BASE, LOWER, WORD, mixed, rolling, runs, slices, stretch_hashes, utf8

TOXIC, CLEAN, PURITY, EVIDENCE = 600, 1800, 0.9, 15.0
BEGINNINGS, ENDING, BUCKETS, ROUNDS, DECAY, SLICE = (3, 4, 5, 6, 7, 8), 4, 1 << 18, 50, 1e-4, 1 << 20
STOP = np.zeros(256, dtype=bool)
STOP[[10, 13, ord("."), ord("!"), ord("?")]] = True


class Tokens:
    """Words of all rows: hashes of their features, one array for each kind, and the chains they form."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        low = LOWER[data]
        self.starts, self.ends, self.rows = runs(WORD[low], at)
        sums, back = rolling(low)
        stops = np.concatenate([[0], np.cumsum(STOP[data])])
        s, e = self.starts, self.ends
        new = np.ones(len(s), dtype=bool)
        new[1:] = (self.rows[1:] != self.rows[:-1]) | (stops[s[1:]] > stops[e[:-1]])
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(s)))
        kinds = [(s, e)] + [(s, np.minimum(e, s + k)) for k in BEGINNINGS] + [(np.maximum(s, e - ENDING), e)]
        self.hashes = [stretch_hashes(sums, back, a, b) for a, b in kinds]

    @classmethod
    def of(cls, texts: list[str]) -> Tokens:
        """Tokens of many texts, taken in slices, so that only the hashes of all are held."""
        parts, at = [], []
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        for part in slices(batch, "text", SLICE):
            at.append(at[-1] + n if at else 0)
            n = part.num_rows
            parts.append(cls(*utf8(part.column("text"))))
        out = cls.__new__(cls)
        before = np.cumsum([0] + [len(p.starts) for p in parts])
        out.starts = out.ends = np.zeros(before[-1], np.int8)
        out.rows = np.concatenate([p.rows + k for p, k in zip(parts, at)])
        out.first = np.concatenate([p.first + k for p, k in zip(parts, before)])
        out.size = np.concatenate([p.size for p in parts])
        out.hashes = [np.concatenate(h) for h in zip(*(p.hashes for p in parts))]
        return out

    def buckets(self) -> list[np.ndarray]:
        return [(mixed(h + np.uint64(k)) % np.uint64(BUCKETS)).astype(np.int32) for k, h in enumerate(self.hashes)]

    def neighbours(self) -> np.ndarray:
        """Hash of the words before and after each word."""
        w = np.concatenate([[np.uint64(0)], self.hashes[0], [np.uint64(0)]])
        return mixed(w[:-2] * BASE + w[2:])


def chains(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Position in the chain and the tokens at it, the longest chains first."""
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    alive = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if len(size) else 1), side="right")
    for p, n in enumerate(alive):
        yield p, first[:n] + p


def forward_backward(e: np.ndarray, a: np.ndarray, first: np.ndarray, size: np.ndarray, steps: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of toxic from the left (with the token's own) and from the right of each token. a: scores of plain to plain, plain to toxic, toxic to plain, toxic to toxic, and of starting toxic."""
    r, q = np.empty(len(e)), np.zeros(len(e))
    steps = [x for _, x in chains(first, size)] if steps is None else steps
    for p, t in enumerate(steps):
        if p == 0:
            r[t] = a[4] + e[t]
        else:
            x = r[t - 1]
            r[t] = e[t] + np.logaddexp(a[1], x + a[3]) - np.logaddexp(a[0], x + a[2])
    for p in range(len(steps) - 1, 0, -1):
        t = steps[p]
        y = e[t] + q[t]
        q[t - 1] = np.logaddexp(a[2], a[3] + y) - np.logaddexp(a[0], a[1] + y)
    return r, q


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _sum(w: np.ndarray, features: list[np.ndarray] | np.ndarray) -> np.ndarray:
    e = np.zeros(len(features[0]))
    for f in features:
        e += w[f]
    return e


def fitted(features: list[np.ndarray], y: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the feature buckets and transition scores that make the labels most likely; features: an array for each kind."""
    w, a = np.zeros(BUCKETS), np.zeros(5)
    gw, ga = np.full(BUCKETS, 1e-6), np.zeros(5)
    follows = np.ones(len(y), dtype=bool)
    follows[first] = False
    later = np.flatnonzero(follows)
    steps = [x for _, x in chains(first, size)]
    for _ in range(ROUNDS):
        e = _sum(w, features)
        r, q = forward_backward(e, a, first, size, steps)
        wrong = sigmoid(r + q) - y
        step = sum(np.bincount(f, wrong, BUCKETS) for f in features) + DECAY * len(y) / BUCKETS * w
        right = e[later] + q[later]
        joint = np.stack([np.full(len(later), a[0]), a[1] + right, r[later - 1] + a[2], r[later - 1] + a[3] + right])
        joint = np.exp(joint - joint.max(0))
        joint /= joint.sum(0)
        seen = np.bincount((2 * y[later - 1] + y[later]).astype(np.int64), minlength=4)
        turn = np.append(joint.sum(1) - seen, wrong[first].sum()) + 0.1 * a
        gw += step * step
        ga = 0.9 * ga + 0.1 * turn * turn
        w -= 0.7 * step / np.sqrt(gw)
        a -= 0.15 * turn / np.sqrt(ga + 1e-9)
    return w.astype(np.float32), a


def evidence(toxic: list[tuple[np.ndarray, np.ndarray]], clean: list[tuple[np.ndarray, np.ndarray]], n_toxic: int, n_clean: int) -> list[np.ndarray]:
    """Of each kind, sorted hashes that speak for toxic. toxic and clean: hash and neighbours of every token, for each kind."""
    out = []
    p = n_toxic / max(n_toxic + n_clean, 1)
    for (h, near), (hc, near_c) in zip(toxic, clean):
        value, t = np.unique(h[np.unique(mixed(h * BASE + near), return_index=True)[1]], return_counts=True)
        value, t = value[t >= 4], t[t >= 4]
        place = np.minimum(np.searchsorted(value, hc), max(len(value) - 1, 0))
        hit = value[place] == hc if len(value) else np.zeros(len(hc), dtype=bool)
        c = np.bincount(place[hit][np.unique(mixed(hc[hit] * BASE + near_c[hit]), return_index=True)[1]], minlength=len(value))
        n = t + c
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = t * np.log(t / (n * p)) + np.where(c > 0, c * np.log(c / (n * (1 - p))), 0)
        out.append(value[(t >= PURITY * n) & (ratio >= EVIDENCE)])
    return out


def train(texts: list[str], toxic: list[bool]) -> dict | None:
    """The model: weights, transitions and the logistic function of the document scores. None if nothing speaks for toxic."""
    order = sorted(range(len(texts)), key=lambda i: (not toxic[i], texts[i]))
    texts, label = [texts[i] for i in order], np.array([toxic[i] for i in order], dtype=bool)
    if not label.any():
        return None
    tokens = Tokens.of(texts)
    near, bad = tokens.neighbours(), label[tokens.rows]
    found = evidence([(h[bad], near[bad]) for h in tokens.hashes[:-1]], [(h[~bad], near[~bad]) for h in tokens.hashes[:-1]], int(bad.sum()), int((~bad).sum()))
    y = np.zeros(len(bad), dtype=bool)
    for h, f in zip(tokens.hashes, found):
        if len(f):
            y |= f[np.minimum(np.searchsorted(f, h), len(f) - 1)] == h
    y &= bad
    if not y.any():
        return None
    features = tokens.buckets()
    tokens.hashes = []
    w, a = fitted(features, y.astype(float), tokens.first, tokens.size)
    x = _document(_marginals(w, a, tokens, features), tokens.rows, len(texts))
    b = np.zeros(3)
    want = label.astype(float)
    ridge = np.array([1e-3, 2e-3, 2e-3])
    for _ in range(50):
        p = sigmoid(x @ b)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (p - want) + ridge * b)
        b -= step / max(1.0, np.abs(step).max())
    # The cut that tells most documents of the sample apart becomes 0.5.
    z = x @ b
    cuts = np.unique(z)
    middle = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2]) if len(cuts) > 1 else cuts
    right = np.searchsorted(np.sort(z[~label]), middle) + label.sum() - np.searchsorted(np.sort(z[label]), middle)
    best = np.flatnonzero(right == right.max())
    b[0] -= middle[best[len(best) // 2]]
    return {"w": w, "a": a, "b": b}


def _marginals(w: np.ndarray, a: np.ndarray, tokens: Tokens, features: list[np.ndarray] | np.ndarray) -> np.ndarray:
    r, q = forward_backward(_sum(w, features), a, tokens.first, tokens.size)
    return sigmoid(r + q)


def _document(p: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    total, count = np.bincount(rows, np.where(p >= 0.5, p, 0), n), np.bincount(rows, minlength=n)
    return np.stack([np.ones(n), np.log1p(total), np.log1p(100 * total / (count + 20))], 1)


def score(texts: pa.Array, model: dict | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score and toxicity of each text; begins, ends and texts of its spans."""
    data, at = utf8(texts)
    n, none = len(texts), np.zeros(0, np.int64)
    tokens = Tokens(data, at) if model and len(data) else None
    if tokens is None or not len(tokens.starts):
        return np.zeros(n), np.zeros(n, dtype=bool), none, none, none
    p = _marginals(model["w"], model["a"], tokens, tokens.buckets())
    s = np.where(np.bincount(tokens.rows, minlength=n) > 0, sigmoid(_document(p, tokens.rows, n) @ model["b"]), 0.0)
    begin = np.zeros(len(p), dtype=bool)
    begin[tokens.first] = True
    hot = p >= 0.5
    opens = np.flatnonzero(hot & (begin | ~np.concatenate([[False], hot[:-1]])))
    closes = np.flatnonzero(hot & (np.concatenate([begin[1:], [True]]) | ~np.concatenate([hot[1:], [False]])))
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    row = tokens.rows[opens]
    return s, s >= 0.5, chars[tokens.starts[opens]] - chars[at[row]], chars[tokens.ends[closes]] - chars[at[row]], row


def sample(docs: DataFrame, labels: DataFrame, n_toxic: int = TOXIC, n_clean: int = CLEAN) -> tuple[list[str], list[bool]]:
    """Texts of the first labelled documents by hash of doc_id, and whether they are toxic."""
    each = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    first = lambda t, n: each.where(F.col("__toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = first(1, n_toxic).unionByName(first(0, n_clean)).select("doc_id", F.col("__toxic").cast("int").alias("__toxic"))
    # At most n_toxic + n_clean rows, whatever the input.
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("text", "__toxic").distinct().collect()
    return [r[0] for r in rows], [r[1] == 1 for r in rows]


def _model(docs: DataFrame, labels: DataFrame):
    return docs.sparkSession.sparkContext.broadcast(train(*sample(docs, labels)))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, toxic and spans of every document."""
    model = _model(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                text = part.column("text")
                s, toxic, begins, ends, row = score(text, model.value)
                pairs = pa.StructArray.from_arrays([pa.array(begins.astype(np.int32)), pa.array(ends.astype(np.int32))], ["begin", "end"])
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(text) + 1)).astype(np.int32)), pairs)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, mask=np.asarray(text.is_null())), pa.array(toxic), spans], ["doc_id", "score", "toxic", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, toxic boolean, spans array<struct<begin:int,end:int>>")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't toxic, with all their columns."""
    model = _model(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield part.filter(pa.array(~score(part.column("text"), model.value)[1]))

    return docs.mapInArrow(run, docs.schema)
