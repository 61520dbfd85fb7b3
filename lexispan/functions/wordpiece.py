"""WordPiece ids and model embeddings, for which a session of the model runs in each Python worker over Arrow batches."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 200


def vocabulary(path: str) -> dict[str, int]:
    """Token to id, in the order of the lines that aren't empty."""
    with open(path, encoding="utf-8-sig") as f:
        tokens = [t for t in (line.strip() for line in f) if t]
    out: dict[str, int] = {}
    for i, t in enumerate(tokens):
        out[t] = i
    return out


def words(text: str | None, lower: bool = True) -> list[str]:
    """Runs between white space; punctuation characters stand alone."""
    return list(each_word(text, lower))


def each_word(text: str | None, lower: bool = True) -> Iterator[str]:
    """What words says, one after the other: a text is read as far as its words are asked for."""
    run = ""
    for c in (text or "").lower() if lower else text or "":
        alone = unicodedata.category(c)[0] == "P"
        if c.isspace() or alone:
            if run:
                yield run
            run = ""
            if alone:
                yield c
        else:
            run += c
    if run:
        yield run


def pieces(word: str, vocab: dict[str, int], unknown: int) -> list[int]:
    """Ids of a word: itself, or the longest pieces from the left."""
    if word in vocab:
        return [vocab[word]]
    if len(word) > LONGEST:
        return [unknown]
    out, start = [], 0
    while start < len(word):
        end = next((e for e in range(len(word), start, -1) if ("##" if start else "") + word[start:e] in vocab), None)
        if end is None:
            return [unknown]
        out.append(vocab[("##" if start else "") + word[start:end]])
        start = end
    return out


def encode(text: str | None, vocab: dict[str, int], length: int, lower: bool = True) -> tuple[list[int], list[int]]:
    """Ids and mask of a fixed length (8 to 512): start, pieces as far as they fit, end, padding."""
    length = max(8, min(512, length))
    for t in ("[CLS]", "[SEP]", "[PAD]", "[UNK]"):
        if t not in vocab:
            raise ValueError(f"the vocabulary has no {t}")
    ids = [vocab["[CLS]"]]
    for w in each_word(text, lower):
        if len(ids) >= length - 1:
            break
        ids += pieces(w, vocab, vocab["[UNK]"])[: length - 1 - len(ids)]
    ids.append(vocab["[SEP]"])
    return ids + [vocab["[PAD]"]] * (length - len(ids)), [1] * len(ids) + [0] * (length - len(ids))


def encoder(vocab: dict[str, int], length: int = 128, lower: bool = True):
    """Column function: text to struct(ids, mask). The vocabulary travels with the function once a stage."""

    @F.pandas_udf("ids array<int>, mask array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            done = [encode(t, vocab, length, lower) for t in texts]
            yield pd.DataFrame({"ids": [a for a, _ in done], "mask": [b for _, b in done]})

    return run


def pooled(output: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors of a model's output: as it is if it is a matrix, else the mean over the masked positions."""
    if output.ndim == 3:
        m = mask[:, :, None].astype(np.float32)
        output = (output * m).sum(1) / np.maximum(m.sum(1), 1e-9)
    size = np.linalg.norm(output.astype(np.float64), axis=1, keepdims=True)
    return (output * np.where(size > 1e-12, 1 / np.maximum(size, 1e-12), 1).astype(np.float32)).astype(np.float32)


def model_embedding(model_path: str, vocab_path: str, length: int = 128, lower: bool = True, gpu: bool = True):
    """Column function: text to array<float> by an ONNX model; length is kept within 32 and 512."""
    vocab, length = vocabulary(vocab_path), max(32, min(512, length or 128))
    with open(model_path, "rb") as f:
        model = f.read()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import onnxruntime as ort

        wanted = ["CUDAExecutionProvider"] * gpu + ["CPUExecutionProvider"]
        session = ort.InferenceSession(model, providers=[p for p in wanted if p in ort.get_available_providers()])
        names = [i.name for i in session.get_inputs()]
        for texts in batches:
            rows = []
            for lo in range(0, len(texts), 64):
                done = [encode(t, vocab, length, lower) for t in texts.iloc[lo : lo + 64]]
                ids, mask = (np.array(x, dtype=np.int64) for x in zip(*done))
                feed = {n: mask if "mask" in n else np.zeros_like(ids) if "type" in n else ids for n in names}
                rows += list(pooled(session.run(None, feed)[0], mask))
            yield pd.Series(rows)

    return run


def provider(name: str | None, folder: str = ".", model_path: str = "", vocab_path: str = "", dim: int = 0, length: int = 128, lower: bool = True, gpu: bool = True):
    """Function of a text column by provider name: "onnx" runs a model, "dummy" and any other name the hash embedding. Relative paths start at folder."""
    from lexispan.functions.vectors import hash_embedding

    if (name or "").strip().lower() == "onnx":
        return model_embedding(os.path.join(folder, model_path), os.path.join(folder, vocab_path), length, lower, gpu)
    return lambda text: hash_embedding(text, dim or 64)


__all__ = ["Column", "encode", "encoder", "model_embedding", "pieces", "pooled", "provider", "vocabulary", "words"]
