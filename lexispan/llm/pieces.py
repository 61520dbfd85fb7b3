"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The vocabulary is read from a .model file whose path is a parameter; nothing is trained. The public file at hand carries merge
ranks instead of log-probabilities, so a piece's log score is that of Zipf's law, -log(rank + 2) normalised over all pieces.
A text is encoded with a blank in front; a blank is the whitespace marker; the path of the highest sum of scores wins, and of
equal paths the one whose last piece is longer. Characters that no piece covers, the marker's own character among them, fall
back to their bytes. Decoding joins the bytes of the pieces and drops the blank in front: it gives the text back exactly.

No piece has a blank after another character, so the best path of a text is made of the best paths of its units (blanks, then
what is not blank; line ends alone): distinct units of a slice go through the trie together, a byte position of all at a time.

A null text has null ids and 0 tokens, an empty one no ids; both count as a round trip. Very long texts and units are encoded
whole. Repeated rows are encoded alike, null doc_ids kept, other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.llm.common import slices, utf8

UNIT = re.compile(" *[^ \n]+|\n| +")
MARKER = "▁"
BYTE_PENALTY, CACHE, SLICE = 10.0, 200_000, 1 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces as bytes, their log scores, and the double-array trie: from state s, byte c leads to base[s] + c if check there is s."""

    def __init__(self, pieces: list[tuple[int, bytes, float]], byte_ids: list[int], size: int):
        self.byte_ids = np.array(byte_ids, dtype=np.int32)
        self.byte_score = min(s for _, _, s in pieces) - BYTE_PENALTY
        self.score = np.zeros(size)
        text = [b""] * size
        for i, piece, score in pieces:
            text[i], self.score[i] = piece, score
        for b, i in enumerate(byte_ids):
            text[i] = bytes([b])
        self.text_at = np.concatenate([[0], np.cumsum([len(t) for t in text])]).astype(np.int64)
        self.text = np.frombuffer(b"".join(text), dtype=np.uint8)
        self._build({piece: i for i, piece, _ in pieces})

    def _build(self, ids: dict[bytes, int]) -> None:
        root: dict = {}
        for piece, i in ids.items():
            node = root
            for c in piece:
                node = node.setdefault(c, {})
            node[-1] = i
        room = 1 << 16
        base, check, value = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
        used = bytearray(room)
        used[0] = 1
        todo, free, after = [(0, root)], 256, 256  # any byte reaches the first free place; several children go where there is room
        while todo:
            state, node = todo.pop()
            value[state] = node.get(-1, -1)
            keys = sorted(k for k in node if k >= 0)
            if not keys:
                continue
            while used[free]:
                free += 1
            b = (free if len(keys) == 1 else max(free, after)) - keys[0]
            tries = 0
            while True:
                if b + 256 >= len(used):
                    used.extend(bytes(len(used)))
                    base, check, value = (np.concatenate([x, np.full(len(x), v, np.int32)]) for x, v in ((base, 0), (check, -1), (value, -1)))
                if not any(used[b + k] for k in keys):
                    break
                b += 1
                tries += 1
            if tries > 64:
                after = b + keys[0]
            base[state] = b
            for k in keys:
                used[b + k] = 1
                check[b + k] = state
                todo.append((b + k, node[k]))
        last = int(np.flatnonzero(np.frombuffer(used, np.uint8))[-1]) + 257
        pad = max(0, last - len(base))
        self.base, self.check, self.value = (np.pad(x[:last], (0, pad), constant_values=v) for x, v in ((base, 0), (check, -1), (value, -1)))


def load(model_file: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    normal = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    ranks = {i: r for r, i in enumerate(sorted(normal, key=lambda i: (-sp.get_score(i), i)))}
    weights = -np.log(np.arange(len(normal)) + 2.0)
    weights -= np.log(np.exp(weights).sum())
    pieces = [(i, sp.id_to_piece(i).replace(MARKER, " ").encode(), float(weights[ranks[i]])) for i in normal]
    if any(b" " in p.lstrip(b" ") or b"\n" in p for _, p, _ in pieces):
        raise ValueError("a piece holds a blank after another character, or a line end")
    return Vocabulary(pieces, byte_ids, sp.get_piece_size())


def viterbi(units: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units, one after the other, and their offsets."""
    size = np.array([len(u) for u in units], dtype=np.int64)
    found = []
    order = np.argsort(size, kind="stable")
    i = 0
    while i < len(order):
        top = max(8, 1 << int(size[order[i]] - 1).bit_length())
        j = min(int(np.searchsorted(size[order], top, side="right")), i + max(1, (1 << 20) // top))
        rows = order[i:j]
        found.append(_paths([units[k] for k in rows], rows, v))
        i = j
    if not found:
        return np.zeros(0, np.int32), np.zeros(len(units) + 1, np.int64)
    unit, at, ids = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((at, unit))
    return ids[order], np.concatenate([[0], np.cumsum(np.bincount(unit, minlength=len(units)))]).astype(np.int64)


def _paths(units: list[bytes], rows: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, byte position and id of every piece on the best paths of units of about one length."""
    m, size = len(units), np.array([len(u) for u in units])
    width = int(size.max())
    text = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in units), dtype=np.uint8).reshape(m, width)
    best = np.full((width + 1, m), -np.inf)
    best[0] = 0
    came, piece = np.zeros((width + 1, m), np.int32), np.full((width + 1, m), -1, np.int32)
    columns = text.T.astype(np.int32)
    for i in range(width):
        live = np.flatnonzero((best[i] > -np.inf) & (i < size))
        if not len(live):
            continue
        lead = columns[i, live]
        step = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        start = best[i, live]
        score, to = start + step * v.byte_score, np.minimum(i + step, width)
        better = score > best[to, live]
        best[to[better], live[better]], came[to[better], live[better]], piece[to[better], live[better]] = score[better], i, -1
        state = np.zeros(len(live), np.int32)
        for k in range(i, width):
            at = v.base[state] + columns[k, live]
            ok = (v.check[at] == state) & (k < size[live])
            if not ok.any():
                break
            live, state, start = live[ok], at[ok], start[ok]
            ids = v.value[state]
            score = start + v.score[ids]
            better = (ids >= 0) & (score > best[k + 1, live])
            w = live[better]
            best[k + 1, w], came[k + 1, w], piece[k + 1, w] = score[better], i, ids[better]
    out_row, out_at, out_id, out_end = [], [], [], []
    here, who = size.copy(), np.arange(m)
    while len(who):
        back, p = came[here[who], who], piece[here[who], who]
        out_row.append(who), out_at.append(back), out_id.append(p), out_end.append(here[who])
        here[who] = back
        who = who[back > 0]
    row, at, ids, end = (np.concatenate(x) for x in (out_row, out_at, out_id, out_end))
    many = np.where(ids >= 0, 1, end - at)
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    row, at, ids = np.repeat(row, many), np.repeat(at, many) + offset, np.repeat(ids, many)
    ids = np.where(ids >= 0, ids, v.byte_ids[text[row, np.minimum(at, width - 1)]])
    return rows[row], at, ids


def expanded(pool: np.ndarray, at: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of the stretches index of pool, and the length of each."""
    many = at[index + 1] - at[index]
    return pool[np.arange(many.sum()) + np.repeat(at[index] - (np.cumsum(many) - many), many)], many


class Encoder:
    """Encodes batches of texts; keeps the ids of units it has seen, and starts afresh once they are many."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.reset()

    def reset(self) -> None:
        self.seen: dict[str, int] = {}
        self.pool, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offsets of each."""
        units: list[str] = []
        ends = []
        for t in texts:
            if t:
                units += UNIT.findall(" " + t)
            ends.append(len(units))
        if len(self.seen) > CACHE:
            self.reset()
        new = [u for u in set(units) if u not in self.seen]
        if new:
            ids, at = viterbi([u.encode("utf-8", "surrogatepass") for u in new], self.v)
            k = len(self.seen)
            self.seen |= {u: k + i for i, u in enumerate(new)}
            self.pool, self.at = np.concatenate([self.pool, ids]), np.concatenate([self.at, at[1:] + len(self.pool)])
        index = np.fromiter(map(self.seen.__getitem__, units), np.int64, len(units))
        ids, many = expanded(self.pool, self.at, index)
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], ends]).astype(np.int64)]


def decode(ids: np.ndarray, at: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, the blank in front among them, and their offsets."""
    text, many = expanded(v.text, v.text_at, ids.astype(np.int64))
    return text, np.concatenate([[0], np.cumsum(many)])[at]


def decoded(ids: list[int], v: Vocabulary) -> str:
    """Text of one list of ids."""
    raw, _ = decode(np.array(ids, dtype=np.int64), np.array([0, len(ids)]), v)
    text = raw.tobytes().decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def texts_of(lists: pa.ListArray, v: Vocabulary) -> list[str | None]:
    """What decoded says of each list, of all at once; null where the list is."""
    null = np.asarray(lists.is_null())
    at = np.concatenate([[0], np.cumsum(np.where(null, 0, np.diff(lists.offsets.to_numpy())))]).astype(np.int64)
    raw, ends = decode(lists.flatten().to_numpy(), at, v)
    raw = raw.tobytes()
    texts = [None if no else raw[a:b].decode("utf-8", "replace") for no, a, b in zip(null.tolist(), ends[:-1].tolist(), ends[1:].tolist())]
    return [t[1:] if t and t.startswith(" ") else t for t in texts]


def faithful(texts: pa.Array, ids: np.ndarray, at: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Whether each text comes back from its ids, byte by byte."""
    raw, ends = utf8(texts)
    got, got_at = decode(ids, at, v)
    size, same = np.diff(ends), np.zeros(len(texts), dtype=bool)
    filled = size > 0
    same[~filled] = np.diff(got_at)[~filled] == 0
    fits = filled & (np.diff(got_at) == size + 1)
    ok = np.flatnonzero(fits)
    if len(ok):
        here, many = expanded(raw, ends, ok)
        front = got[got_at[ok]] == 32
        shifted = got_at.copy()
        there = got[np.arange(many.sum()) + np.repeat(shifted[ok] + 1 - (np.cumsum(many) - many), many)]
        same[ok] = front & np.logical_and.reduceat(here == there, np.cumsum(many) - many)
    return same


def encoded(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip of every document."""
    model = docs.sparkSession.sparkContext.broadcast(vars(load(model_file or default_model())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.__new__(Vocabulary)
        vars(vocabulary).update(model.value)
        encoder = Encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = part.column("text")
                ids, at = encoder.encode(texts.to_pylist())
                mask = pa.array(np.asarray(texts.is_null()))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=mask)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(np.diff(at).astype(np.int32)), pa.array(faithful(texts, ids, at, vocabulary))], ["doc_id", "ids", "n_tokens", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens int, round_trip boolean")


def restored(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id and text of every document, decoded from its ids alone; null where the text is."""
    model = docs.sparkSession.sparkContext.broadcast(vars(load(model_file or default_model())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.__new__(Vocabulary)
        vars(vocabulary).update(model.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts_of(part.column("ids"), vocabulary), pa.string())], ["doc_id", "text"])

    return encoded(docs, model_file).select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


RESTORED_SQL = "SELECT doc_id, text FROM documents"
