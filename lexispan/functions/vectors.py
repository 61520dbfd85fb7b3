"""Column expressions on vectors: norm, dot product, cosine, and the hash embedding, all in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_NORM = 1e-12


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(v: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def cosine(v: Column, v_norm: Column, q: Sequence[float]) -> Column:
    size = sum(float(x) ** 2 for x in q) ** 0.5
    return dot(v, literal(q)) / (v_norm * F.lit(size))


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Unit vector of dim (16 to 256; others are clamped) floats from SHA-256 of the text: a stand-in for a model that needs none."""
    dim = max(16, min(256, dim))
    # Arrays of one element bind what is used more than once, so that every digest is worked out once.
    bind = lambda c, f: F.transform(F.array(c), f)[0]
    blocks = F.sequence(F.lit(0), F.lit((dim - 1) // 16))

    def numbers(digest: Column) -> Column:
        # Each pair of bytes, low byte first, is a number from 0 to 65535.
        word = lambda k: F.conv(F.concat(F.substring(digest, k * 4 + 3, 2), F.substring(digest, k * 4 + 1, 2)), 16, 10).cast("double")
        return F.array(*[(word(k) / 32767.5 - 1.0).cast("float") for k in range(16)])

    def block(whole: Column, b: Column) -> Column:
        counter = F.concat(F.lpad(F.lower(F.hex(b * 16)), 2, "0"), F.lit("000000"))
        return bind(F.sha2(F.unhex(F.concat(whole, counter)), 256), numbers)

    whole = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    raw = bind(whole, lambda w: F.slice(F.flatten(F.transform(blocks, lambda b: block(w, b))), 1, dim))
    scaled = lambda v, n: F.transform(v, lambda x: (x * (F.lit(1.0) / n).cast("float")).cast("float"))
    return bind(raw, lambda v: bind(norm(v), lambda n: F.when(n > LEAST_NORM, scaled(v, n)).otherwise(v)))
