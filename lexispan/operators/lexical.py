"""Inverted index and BM25 search.

Terms are cut once a chunk and put in order within it, by numpy over Arrow batches, so postings (term, col, chunk_id, tf, positions, n_tokens) come out of a chunk without a shuffle;
both columns that are searched, path (0) and body (1), have postings. Kept as a table in the order of terms, a prefix reads only the row groups it lies in;
the length of each chunk lies beside its postings, and the corpus has its size and mean length in one row, so a search reads no other table for its scores.

A single search of chunks that have no index counts its phrases in the terms of each chunk, in one scan (scanned), and makes no postings.

A search takes the postings of all phrases in one filter and one shuffle by chunk, as one column of occurrences a phrase; df is the number of
chunks that have the phrase, over the whole index. Path and extension filters come after that: they don't change scores. Bodies are
fetched for the hits only, by id, from a table in the order of ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispan.functions.text import ascii_folded, normal_prefix, terms, ticks_to_iso
from lexispan.plans.query import And, Or, Phrase, Query, occurrences, parse

K1, B, LEAST_IDF, TOP = 1.2, 0.75, 1e-6, 15
#: Terms that a worker puts in order at once, of one chunk at least.
HELD = 1 << 20
#: Highest code point that UTF-8 sorts after any term of the same beginning; bounds a prefix from above for the scan of sorted postings.
LAST = "\U0010ffff"


def tokenized(chunks: DataFrame) -> DataFrame:
    """chunk_id and the terms of both searched columns."""
    return chunks.select("chunk_id", terms(F.col("path")).alias("path_terms"), terms(F.col("body")).alias("body_terms"))


def _ordered(words: pa.ListArray) -> tuple[np.ndarray, pa.Array, pa.ListArray]:
    """Of all runs of a term in the rows of an array, in the order of rows and terms: the number in each row, the terms and their positions."""
    size = np.diff(words.offsets.to_numpy())
    flat = words.flatten().dictionary_encode()
    known = flat.dictionary.cast(pa.binary())
    rank = np.empty(len(known), np.int64)
    rank[pc.array_sort_indices(known).to_numpy()] = np.arange(len(known))
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    code = rank[flat.indices.to_numpy()]
    order = np.argsort(row * max(1, len(known)) + code, kind="stable")  # positions stay in order
    row, code, place = row[order], code[order], place[order]
    begins = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))) if len(row) else np.zeros(0, np.int64)
    ends = np.append(begins, len(row)).astype(np.int32)
    terms_ = flat.dictionary.take(pa.array(flat.indices.to_numpy()[order][begins]))
    return np.bincount(row[begins], minlength=len(size)), terms_, pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, int, pa.Array, np.ndarray, pa.Array, pa.ListArray]]:
    """chunk_id, col, n_tokens and the runs of both columns, of some HELD terms at a time."""
    for batch in batches:
        total = np.cumsum(np.diff(batch.column("path_terms").offsets.to_numpy()) + np.diff(batch.column("body_terms").offsets.to_numpy()))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + HELD, side="right")))
            part = batch.slice(lo, hi - lo)
            for col, name in enumerate(("path_terms", "body_terms")):
                words = part.column(name)
                yield part.column("chunk_id"), col, part.column("n_tokens"), *_ordered(pa.ListArray.from_arrays(pc.subtract(words.offsets, words.offsets[0]), words.flatten()))
            lo = hi


def grouped(chunks: DataFrame) -> DataFrame:
    """chunk_id, col, n_tokens (of both columns) and terms (term, positions) of both searched columns: all that an index needs of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, col, n, many, words, positions in _sides(batches):
            ends = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
            each = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([words, positions], ["term", "positions"]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(n), col, np.int8)), n, each], ["chunk_id", "col", "n_tokens", "terms"])

    return _whole(tokenized(chunks)).mapInArrow(run, "chunk_id long, col tinyint, n_tokens int, terms array<struct<term: string, positions: array<int>>>")


def _whole(tokens: DataFrame) -> DataFrame:
    """tokens with n_tokens, and with an empty array for a null."""
    return tokens.select("chunk_id", (F.size("path_terms") + F.size("body_terms")).alias("n_tokens"), *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("path_terms", "body_terms")])


def spread(groups: DataFrame) -> DataFrame:
    """term, col, chunk_id, tf, positions and n_tokens, of a result of grouped."""
    # An outer generator: of an inner one the optimizer would ask twice whether there is a row.
    rows = groups.select("col", "chunk_id", "n_tokens", F.inline_outer("terms")).where("term IS NOT NULL")
    return rows.select("term", "col", "chunk_id", F.size("positions").alias("tf"), "positions", "n_tokens")


def _runs(words: Column) -> Column:
    """(term, positions) of every term of an array, in the order of terms."""
    # Sorting (term, position) puts the positions of a term next to each other; a term begins where the one before differs.
    pairs = F.sort_array(F.transform(words, lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))

    def cut(ps: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(ps) - 1), lambda i: (i == 0) | (F.get(ps, i)["term"] != F.get(ps, i - 1)["term"]))
        one = lambda bs: F.transform(bs, lambda b, k: F.struct(F.get(ps, b)["term"].alias("term"), F.transform(F.slice(ps, b + 1, F.coalesce(F.get(bs, k + 1), F.size(ps)) - b), lambda p: p["pos"]).alias("positions")))
        return F.transform(F.array(begins), one)[0]

    return F.when(F.size(words) > 0, F.transform(F.array(pairs), cut)[0])


def postings(chunks: DataFrame) -> DataFrame:
    """term, col, chunk_id, tf, positions and n_tokens, without Python: for few chunks, and for plans of expressions only."""
    t = tokenized(chunks)
    both = F.array(F.struct(F.lit(0).cast("tinyint").alias("col"), F.col("path_terms").alias("words")), F.struct(F.lit(1).cast("tinyint").alias("col"), F.col("body_terms").alias("words")))
    sides = t.select("chunk_id", (F.size("path_terms") + F.size("body_terms")).alias("n_tokens"), F.inline(both))
    return spread(sides.select("chunk_id", "col", "n_tokens", _runs(F.col("words")).alias("terms")))


def listed(chunks: DataFrame) -> DataFrame:
    """What postings says, put in order by numpy, in a third of the time that expressions take for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, col, n, many, words, positions in _sides(batches):
            row = np.repeat(np.arange(len(n)), many)
            for lo in range(0, len(row), 1 << 16):
                some = row[lo : lo + (1 << 16)]
                at = positions.slice(lo, len(some))
                yield pa.RecordBatch.from_arrays([words.slice(lo, len(some)), pa.array(np.full(len(some), col, np.int8)), ids.take(pa.array(some)), pc.list_value_length(at), at, n.take(pa.array(some))], ["term", "col", "chunk_id", "tf", "positions", "n_tokens"])

    return _whole(tokenized(chunks)).mapInArrow(run, "term string, col tinyint, chunk_id long, tf int, positions array<int>, n_tokens int")


def frequencies(chunks: DataFrame) -> DataFrame:
    """term, df and cf of chunks of which no two have the same id: terms are counted in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [batch.column(c) for c in ("path_terms", "body_terms")]
            row = np.concatenate([np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy())) for x in both])
            flat = pa.concat_arrays([x.flatten() for x in both]).dictionary_encode()
            code = flat.indices.to_numpy()
            pairs = np.unique(row * max(1, len(flat.dictionary)) + code) % max(1, len(flat.dictionary))
            count = lambda x: pa.array(np.bincount(x, minlength=len(flat.dictionary)))
            yield pa.RecordBatch.from_arrays([flat.dictionary, count(pairs), count(code)], ["term", "df", "cf"])

    each = _whole(tokenized(chunks)).mapInArrow(run, "term string, df long, cf long")
    return each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    t = tokenized(chunks)
    return t.select("chunk_id", (F.size("path_terms") + F.size("body_terms")).alias("n_tokens"))


def store(chunks: DataFrame, at: str) -> DataFrame:
    """Writes chunks in the order of ids, postings in that of terms, and the one row of corpus, each as a table below at; gives back the chunks.

    Terms are cut once, into a table that is dropped in the end: sampling for the order of terms reads that table and not the texts."""
    spark = chunks.sparkSession
    chunks.repartition("chunk_id").sortWithinPartitions("chunk_id").write.mode("overwrite").parquet(f"{at}/chunks")
    kept = spark.read.parquet(f"{at}/chunks")
    grouped(kept).write.mode("overwrite").parquet(f"{at}/terms")
    groups = spark.read.parquet(f"{at}/terms")
    spread(groups).repartitionByRange("term").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{at}/postings")
    corpus_stats(groups.where("col = 1").select("chunk_id", "n_tokens")).coalesce(1).write.mode("overwrite").parquet(f"{at}/corpus")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/terms")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return kept


def corpus_stats(stats: DataFrame) -> DataFrame:
    """n_chunks and avgdl, one row."""
    return stats.agg(F.count("*").alias("n_chunks"), (F.sum("n_tokens") / F.count("*")).alias("avgdl"))


def phrase_condition(p: Phrase) -> Column:
    """Rows of postings that a phrase needs; the last term is a prefix."""
    last = (F.col("term") >= p.terms[-1]) & (F.col("term") <= p.terms[-1] + LAST) & F.startswith(F.col("term"), F.lit(p.terms[-1]))
    return last | F.col("term").isin(list(p.terms[:-1])) if len(p.terms) > 1 else last


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x + by)


def _count(p: Phrase) -> Column:
    """Occurrences of a phrase in one column of one chunk, over the postings of that group."""
    begins = F.startswith(F.col("term"), F.lit(p.terms[-1]))
    if len(p.terms) == 1:
        return F.coalesce(F.sum(F.when(begins, F.col("tf"))), F.lit(0))
    at = lambda cond: F.flatten(F.collect_list(F.when(cond, F.col("positions"))))
    found = at(begins)
    for back, term in enumerate(reversed(p.terms[:-1]), 1):
        found = F.array_intersect(found, _shifted(at(F.col("term") == term), back))
    return F.size(found).cast("long")


def occurrences_by_chunk(index: DataFrame, query: Query) -> DataFrame:
    """chunk_id, n_tokens and f0, f1, ...: how often each phrase of the query is in the chunk; chunks with none are left out."""
    wanted = reduce(lambda a, b: a | b, [phrase_condition(p) for p in query.phrases])
    rows = index.where(wanted)
    names = [f"f{k}" for k in range(len(query.phrases))]
    if all(len(p.terms) == 1 for p in query.phrases):
        return rows.groupBy("chunk_id").agg(F.first("n_tokens").alias("n_tokens"), *[_count(p).alias(n) for p, n in zip(query.phrases, names)])
    by_col = rows.repartition("chunk_id").groupBy("chunk_id", "col").agg(F.first("n_tokens").alias("n_tokens"), *[_count(p).alias(n) for p, n in zip(query.phrases, names)])
    return by_col.groupBy("chunk_id").agg(F.first("n_tokens").alias("n_tokens"), *[F.sum(n).alias(n) for n in names])


def occurrences_in(chunks: DataFrame, query: Query) -> DataFrame:
    """What occurrences_by_chunk says, of all chunks and without an index: chunk_id, n_tokens, f0, f1, ..., and how many rows and tokens it is of."""

    def found(p: Phrase, words: Column) -> Column:
        if len(p.terms) == 1:
            return F.size(F.filter(words, lambda t: F.startswith(t, F.lit(p.terms[0]))))
        n = len(p.terms)
        begins = F.filter(F.transform(words, lambda t, i: F.when(t == p.terms[0], i)), lambda i: i.isNotNull() & (i + n <= F.size(words)))
        rest = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == t for k, t in enumerate(p.terms[1:-1], 1)], F.startswith(F.get(words, i + n - 1), F.lit(p.terms[-1])))
        return F.size(F.filter(begins, rest))

    def counts(c: Column) -> Column:
        # An array of one element binds the terms, which are used more than once.
        one = lambda words: F.struct(F.size(words).alias("n"), *[found(p, words).cast("long").alias(f"f{k}") for k, p in enumerate(query.phrases)])
        return F.transform(F.array(terms(c)), one)[0]

    # A generator of one row: what is asked of the counts doesn't cut the terms again.
    t = chunks.select("chunk_id", F.inline(F.array(F.struct(counts(F.col("path")).alias("p"), counts(F.col("body")).alias("b")))))
    names = [f"f{k}" for k in range(len(query.phrases))]
    each = t.select("chunk_id", (F.col("p.n") + F.col("b.n")).alias("n_tokens"), *[(F.coalesce(f"p.{n}", F.lit(0)) + F.coalesce(f"b.{n}", F.lit(0))).alias(n) for n in names])
    return each.groupBy("chunk_id").agg(F.first("n_tokens").alias("n_tokens"), *[F.sum(n).alias(n) for n in names], F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"))


def scanned(chunks: DataFrame, query: Query) -> DataFrame:
    """What scored says, of chunks without an index: one scan of them, the figures of the corpus among it."""
    f = occurrences_in(chunks, query)
    n = len(query.phrases)
    # Both sides use all columns of f, so that they are the same step of the plan, which is run once.
    all_ = F.coalesce(F.max("n_tokens"), F.lit(0)) >= 0
    figures = f.agg(*[F.count(F.when(F.col(f"f{k}") > 0, 1)).alias(f"n{k}") for k in range(n)], F.sum("rows").alias("n_chunks"), F.when(all_, F.sum("tokens") / F.sum("rows")).alias("avgdl"))
    some = f.where(holds(query.tree, query) & (F.col("rows") > 0) & (F.coalesce("tokens", F.lit(0)) >= 0))
    return _weighed(some.crossJoin(F.broadcast(figures)), query)


def holds(node, query: Query) -> Column:
    """Whether a tree holds of a chunk."""
    if isinstance(node, Phrase):
        return F.col(f"f{query.phrases.index(node)}") > 0 if node.terms else F.lit(False)
    parts = [holds(p, query) for p in node.parts]
    return reduce((lambda a, b: a & b) if isinstance(node, And) else (lambda a, b: a | b), parts)


def scored(index: DataFrame, corpus: DataFrame, query: Query) -> DataFrame:
    """chunk_id and bm25 (negative, the lower the better) of all chunks for which the query holds. corpus: the one row of corpus_stats."""
    f = occurrences_by_chunk(index, query)
    n = len(query.phrases)
    # One row: corpus size, mean length and the df of every phrase.
    df = f.agg(*[F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(n)])
    return _weighed(f.where(holds(query.tree, query)).crossJoin(F.broadcast(df)).crossJoin(F.broadcast(corpus)), query)


def _weighed(wide: DataFrame, query: Query) -> DataFrame:
    """chunk_id and bm25 of chunks with their occurrences and the figures of the corpus."""
    score = F.lit(0.0)
    for p, gates in occurrences(query.tree):
        if not p.terms:
            continue
        k = query.phrases.index(p)
        raw = F.ln((F.col("n_chunks") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5))
        idf = F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)
        tf = F.col(f"f{k}").cast("double")
        part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_tokens") / F.col("avgdl")))
        for g in gates:
            part = F.when(holds(g, query), part).otherwise(0.0)
        score = score + part
    return wide.select("chunk_id", (-score).alias("bm25"))


def keep(chunks: DataFrame, path_prefix: str | None = None, exclude_prefixes: list[str] | None = None, extensions: list[str] | None = None) -> DataFrame:
    """Chunks that the filters of a search leave: prefixes without regard to ASCII case, extensions exactly as stored."""
    path = ascii_folded(F.col("path"))
    lower = lambda s: s.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
    if path_prefix and path_prefix.strip():
        chunks = chunks.where(F.startswith(path, F.lit(lower(normal_prefix(path_prefix)))))
    for raw in exclude_prefixes or []:
        if p := normal_prefix(raw):
            chunks = chunks.where(~F.startswith(path, F.lit(lower(p))))
    wanted = normal_extensions(extensions)
    return chunks.where(F.col("extension").isin(wanted)) if wanted else chunks


def normal_extensions(extensions: list[str] | None) -> list[str]:
    out = []
    for e in extensions or []:
        e = e.strip().lower()
        if e and (e := e if e.startswith(".") else "." + e) not in out:
            out.append(e)
    return out


HIT = "hit_id long, path string, extension string, hit_kind string, rank_score double, fts_score double, vec_score double, line_start int, line_end int, chunk_char_count int, last_write_utc_iso string"


def hits(found: DataFrame, file_state: DataFrame | None, body: bool = False) -> DataFrame:
    """found (chunk_id, chunk columns, rank_score, fts_score, vec_score, hit_kind) as hits, with the time of the last write where it is known."""
    if file_state is not None:
        found = found.join(file_state.select("path", F.col("last_write_utc_ticks").alias("__ticks")), "path", "left")
        when = ticks_to_iso(F.col("__ticks"))
    else:
        when = F.lit(None).cast("string")
    return found.select(
        F.col("chunk_id").alias("hit_id"), "path", "extension", "hit_kind", "rank_score", "fts_score", "vec_score", "line_start", "line_end",
        F.char_length("body").alias("chunk_char_count"), when.alias("last_write_utc_iso"), *["body"] * body,
    )


def top(rows: DataFrame, n: int, order: str = "best_first") -> DataFrame:
    """First n rows by bm25; order "reference" has the weakest first. Ties go by chunk_id."""
    best = F.round("bm25", 9)  # sums in another order differ in the last digits
    return rows.orderBy(best.desc() if order == "reference" else best, "chunk_id").limit(n)


def by_id(chunks: DataFrame, ids: list[int]) -> DataFrame:
    """Chunks of a few ids. Equalities, unlike a long IN list, reach the statistics of the row groups, so a table in the order of ids is read where they are."""
    return chunks.where(reduce(lambda a, b: a | b, [F.col("chunk_id") == i for i in ids], F.lit(False)))


def search(chunks: DataFrame, index: DataFrame | None, corpus: DataFrame | None, text: str, n: int = TOP, file_state: DataFrame | None = None, order: str = "best_first", path_prefix: str | None = None, exclude_prefixes: list[str] | None = None, extensions: list[str] | None = None, body: bool = False) -> DataFrame:
    """The n hits of a query. Without a usable token there are none. The scores of the n hits are collected, so that their chunks are read by id. body: with column body. Without an index the chunks are scanned, which is less work than to make one for a single query."""
    query = parse(text)
    spark = chunks.sparkSession
    found = [] if query.tree is None or not query.phrases or not _satisfiable(query.tree) else _best(chunks, scanned(chunks, query) if index is None else scored(index, corpus, query), n, order, path_prefix, exclude_prefixes, extensions)
    if not found:
        return spark.createDataFrame([], HIT + ", body string" * body)
    first = spark.createDataFrame([(r["chunk_id"], r["bm25"]) for r in found], "chunk_id long, bm25 double")
    rows = F.broadcast(first).join(by_id(chunks, [r["chunk_id"] for r in found]), "chunk_id")  # n rows
    rows = rows.select(*chunks.columns, F.lit("text_fts").alias("hit_kind"), F.col("bm25").alias("rank_score"), F.col("bm25").alias("fts_score"), F.lit(None).cast("double").alias("vec_score"))
    best = F.round("fts_score", 9)
    return hits(rows, file_state, body).orderBy(best.desc() if order == "reference" else best, "hit_id")


def _best(chunks: DataFrame, found: DataFrame, n: int, order: str, path_prefix: str | None, exclude_prefixes: list[str] | None, extensions: list[str] | None) -> list:
    if any([path_prefix and path_prefix.strip(), exclude_prefixes, normal_extensions(extensions)]):
        found = found.join(keep(chunks.select("chunk_id", "path", "extension"), path_prefix, exclude_prefixes, extensions).select("chunk_id"), "chunk_id", "left_semi")
    return top(found, n, order).collect()


def _satisfiable(node) -> bool:
    """A token without letters or digits is an empty phrase: under And nothing matches, under Or it doesn't count."""
    if isinstance(node, Phrase):
        return bool(node.terms)
    return (any if isinstance(node, Or) else all)(map(_satisfiable, node.parts))


def explain_hit(chunks: DataFrame, hit_id: int, file_state: DataFrame | None = None, chars: int = 1200) -> DataFrame:
    """The chunk of one id with the first chars of its body as snippet: no row if there is none."""
    row = chunks.where(F.col("chunk_id") == hit_id).limit(1)
    zero = F.lit(0.0)
    out = hits(row.select(*chunks.columns, F.lit("text_fts").alias("hit_kind"), zero.alias("rank_score"), zero.alias("fts_score"), F.lit(None).cast("double").alias("vec_score")), file_state, True)
    return out.withColumn("snippet", F.substring("body", 1, chars)).drop("body")
