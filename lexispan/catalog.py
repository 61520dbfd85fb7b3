"""Queries of the retrieval engine over the driver's tables, and their SQL.

Documents stand for files: a path of source, language and number, an extension by language, and a time of the last write by number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.functions.snippet import snippets
from lexispan.functions.text import MARK, identifier_parts
from lexispan.functions.vectors import norm
from lexispan.functions.wordpiece import encoder
from lexispan.operators import chunking, headers, lexical, reindex, vectors
from lexispan.plans import fixtures, oracle, served
from lexispan.settings import Settings
from lexispan.sources.files import skip_reason
from lexispan.sources.ignore import ignored
from lexispan.streaming.observer import feed_counts

Query = Callable[[SparkSession, str], DataFrame]
CHUNK, OVERLAP = oracle.CHUNK, oracle.OVERLAP
PREFIX, TWO, PHRASE, CAMEL = "the", "the src1", "of.the", "thanThe ofTo"


def files(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    ext = F.lit(".txt")
    for lang, e in oracle.EXTENSIONS.items():
        ext = F.when(F.col("lang") == lang, e).otherwise(ext)
    path = F.concat(F.lit("docs/"), "source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), ext)
    ticks = F.lit(638396640000000000) + F.col("doc_id") * F.lit(600000000)
    return d.select("doc_id", path.alias("path"), ext.alias("extension"), "text", F.octet_length("text").cast("long").alias("size_bytes"), ticks.alias("last_write_utc_ticks"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunks(files(spark, sf), CHUNK, OVERLAP)


def corpus(c: DataFrame) -> DataFrame:
    return lexical.corpus_stats(lexical.chunk_stats(c))


def _search(text: str, fresh: bool = False, **options) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        c = chunks(spark, sf)
        found = lexical.search(c, None, None, text, file_state=files(spark, sf) if fresh else None, **options)
        return found.select("path", "line_start", "line_end", F.round("fts_score", 6).alias("fts_score"), "chunk_char_count", *(["last_write_utc_iso"] if fresh else []))

    return run


def _matches(text: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        c = chunks(spark, sf)
        s = lexical.scanned(c, lexical.parse(text))
        return c.select("chunk_id", "path", "line_start").join(s, "chunk_id").select("path", "line_start", F.round("bm25", 6).alias("bm25"))

    return run


def _matches_sql(text: str) -> str:
    return f"WITH {oracle.scores(text)} SELECT path, line_start, round(bm25, 6) AS bm25 FROM s"


IDENTIFIERS = ["PlanBoardLeaf", "BoardLeaf", "XMLHttpRequest", "getHTTPResponse", "plain", "snake_case_id", "fooBar_bazQux", "_fooBar", "abc123", "v2Api", "ABC", "aB", "HTTP2Server", "___"]


def chunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("chunk_id", "path", "line_start", "line_end", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def split_identifier(spark: SparkSession, sf: str) -> DataFrame:
    glued = spark.read.parquet(f"{sf}/part.parquet").select(F.array_join(F.transform(F.split("p_name", " "), F.initcap), "").alias("ident"))
    names = spark.createDataFrame([(i,) for i in IDENTIFIERS], "ident string").unionByName(glued.distinct())
    return names.select("ident", F.array_join(identifier_parts(F.col("ident")), "|").alias("parts"))


_NAMES_SQL = f"""SELECT unnest([{", ".join(f"'{i}'" for i in IDENTIFIERS)}]) AS ident UNION ALL
SELECT DISTINCT array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') FROM part"""


def tokenize_terms(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    if files(spark, sf).groupBy("path").count().where("count > 1").isEmpty():
        return lexical.frequencies(c)
    return lexical.listed(c).groupBy("term").agg(F.countDistinct("chunk_id").alias("df"), F.sum("tf").alias("cf"))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "chunk_lines": (chunk_lines, f"WITH {oracle.CHUNKS} SELECT chunk_id, path, line_start, line_end, md5(body) AS body_md5 FROM c"),
    "chunk_count_by_ext": (lambda s, d: chunks(s, d).groupBy("extension").agg(F.count("*").alias("n_chunks"), F.countDistinct("path").alias("n_files")), f"WITH {oracle.CHUNKS} SELECT extension, count(*) AS n_chunks, count(DISTINCT path) AS n_files FROM c GROUP BY extension"),
    "tokenize_terms": (tokenize_terms, f"WITH {oracle.TERMS}, u AS (SELECT chunk_id, unnest(list_concat(pt, bt)) AS term FROM t) SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM u GROUP BY term"),
    "postings_df": (lambda s, d: lexical.listed(chunks(s, d)).select("term", "col", "chunk_id", "tf", "positions"), f"WITH {oracle.TERMS}, u AS (SELECT chunk_id, 0::TINYINT AS col, unnest(pt) AS term, generate_subscripts(pt, 1) AS i FROM t UNION ALL SELECT chunk_id, 1::TINYINT, unnest(bt), generate_subscripts(bt, 1) FROM t) SELECT term, col, chunk_id, count(*)::INT AS tf, list((i - 1)::INT ORDER BY i) AS positions FROM u GROUP BY term, col, chunk_id"),
    "corpus_stats": (lambda s, d: lexical.corpus_stats(lexical.chunk_stats(chunks(s, d))).select("n_chunks", F.round("avgdl", 6).alias("avgdl")), f"WITH {oracle.TERMS} SELECT count(*) AS n_chunks, round(sum(len(pt) + len(bt))::DOUBLE / count(*), 6) AS avgdl FROM t"),
    "match_prefix_single": (_matches(PREFIX), _matches_sql(PREFIX)),
    "match_and": (_matches(TWO), _matches_sql(TWO)),
    "match_camel_or": (_matches(CAMEL), _matches_sql(CAMEL)),
    "match_phrase": (_matches(PHRASE), _matches_sql(PHRASE)),
    "bm25_search": (_search(TWO), oracle.search(TWO)),
    "bm25_search_reference_order": (_search(TWO, order="reference"), oracle.search(TWO, order="reference")),
    "search_path_prefix": (_search(PREFIX, path_prefix="/Docs\\src1/"), oracle.search(PREFIX, where="starts_with(lower(path), 'docs/src1/')")),
    "search_exclude_prefixes": (_search(PREFIX, exclude_prefixes=["docs/SRC1", "", "docs/src2/"]), oracle.search(PREFIX, where="NOT starts_with(lower(path), 'docs/src1') AND NOT starts_with(lower(path), 'docs/src2/')")),
    "search_extensions": (_search("la", extensions=["JSON", " .toml "]), oracle.search("la", where="extension IN ('.json', '.toml')")),
    "search_freshness_join": (_search("src3 d1", fresh=True), oracle.search("src3 d1", fresh=True)),
    "split_identifier": (split_identifier, f"WITH n AS ({_NAMES_SQL}) SELECT ident, array_to_string({oracle.parts('ident')}, '|') AS parts FROM n"),
    "expand_body": (lambda s, d: chunks(s, d).where(F.contains("body", F.lit(f"{MARK}camel:"))).select("path", "line_start", F.split_part("body", F.lit(f"{MARK}camel:"), F.lit(-1)).alias("expansions")), f"WITH {oracle.CHUNKS} SELECT path, line_start, string_split(body, '{oracle.MARK}camel:')[-1] AS expansions FROM c WHERE contains(body, '{oracle.MARK}camel:')"),
}



def explain_hit(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    hit = c.agg(F.min("chunk_id")).first()[0]
    return lexical.explain_hit(c, hit, files(spark, sf)).select("hit_id", "path", "hit_kind", "chunk_char_count", "last_write_utc_iso", "snippet")


def snippet(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    rows = lexical.search(c, None, None, TWO, body=True)
    return rows.select("path", "line_start", snippets(lexical.parse(TWO).phrases)(F.col("body")).alias("snippet"))


def fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixtures.FILES, "path string, extension string, text string")


def _headers(extension: str) -> Query:
    return lambda s, d: headers.with_header(headers.paired(fixture(s))).where(F.lower("extension") == extension).select("path", "header")


SCAN = Settings(exclude_path_segments=["SRC3"], max_indexed_file_bytes=4000)
_IGNORED_SQL = "false"
for _pattern, _verdict in fixtures.RULES_BY_HAND:
    _IGNORED_SQL = f"CASE WHEN regexp_matches(path, '{_pattern}') THEN {str(_verdict).lower()} ELSE {_IGNORED_SQL} END"
_SKIPS_SQL = f"""WITH {oracle.FILES}, k AS (SELECT path, CASE WHEN contains(lower('/' || path), '/src3/') THEN 'denylist' WHEN {_IGNORED_SQL} THEN 'gitignore' WHEN size_bytes > 4000 THEN 'too_large' END AS reason FROM f), skips AS (SELECT * FROM k WHERE reason IS NOT NULL)"""


def skips(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select("path", skip_reason(SCAN, fixtures.RULES).alias("reason")).where("reason IS NOT NULL")


NARROW = Settings(include_extensions=["MD", ".json", " cs ", ""], exclude_extensions=["cs", "json"])


def old_state(spark: SparkSession, sf: str) -> DataFrame:
    """State before: Spanish files were shorter, those of src5 weren't there, those of src6 were written earlier."""
    f = files(spark, sf).where("path NOT LIKE 'docs/src5/%'")
    size = F.when(F.col("extension") == ".toml", F.col("size_bytes") - 1).otherwise(F.col("size_bytes"))
    ticks = F.when(F.col("path").startswith("docs/src6/"), F.col("last_write_utc_ticks") - 1).otherwise(F.col("last_write_utc_ticks"))
    return f.select("path", size.alias("size_bytes"), ticks.alias("last_write_utc_ticks"))


def new_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Listing now: the files of src7 are gone."""
    return files(spark, sf).where("path NOT LIKE 'docs/src7/%'").select("path", "size_bytes", "last_write_utc_ticks")


_STATES_SQL = f"""WITH {oracle.FILES},
o AS (SELECT path, size_bytes - CASE WHEN extension = '.toml' THEN 1 ELSE 0 END AS size_bytes, last_write_utc_ticks - CASE WHEN starts_with(path, 'docs/src6/') THEN 1 ELSE 0 END AS last_write_utc_ticks FROM f WHERE path NOT LIKE 'docs/src5/%'),
n AS (SELECT path, size_bytes, last_write_utc_ticks FROM f WHERE path NOT LIKE 'docs/src7/%')"""


def merged(spark: SparkSession, sf: str) -> DataFrame:
    old, new = old_state(spark, sf), new_listing(spark, sf)
    return reindex.merged_state(old, reindex.changed(new, old), reindex.stale(old, new))


def stored(spark: SparkSession, sf: str) -> DataFrame:
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    return v.select(F.col("vec_id").alias("chunk_id"), F.size("embedding").alias("dim"), norm(F.col("embedding")).alias("norm"), F.col("embedding").alias("vec"))


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.min_by("embedding", "vec_id")).first()[0]


def _as_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select(F.col("doc_id").alias("chunk_id"), "extension")


def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.top_k(stored(spark, sf), _query_vector(spark, sf), 50).select("chunk_id", F.round("sim", 6).alias("sim"))


def vec_allowed_ext(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.top_k(stored(spark, sf), _query_vector(spark, sf), 20, _as_chunks(spark, sf), [".CS", ".json"]).select("chunk_id", F.round("sim", 6).alias("sim"))


_NEAR_SQL = f"SELECT vec_id AS chunk_id, round({oracle.dot('embedding', 'q')} / ({oracle.norm('embedding')} * {oracle.norm('q')}), 6) AS sim FROM embeddings, (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
_TOP_SQL = f"ORDER BY round({oracle.dot('embedding', 'q')} / ({oracle.norm('embedding')} * {oracle.norm('q')}), 9) DESC, vec_id LIMIT"


def _rounded(x: Column, digits: int) -> Column:
    """x rounded half away from zero; what is rounded to zero from below is -0.0, as in SQL, where F.round forgets the sign."""
    return F.round(F.abs(x), digits) * F.signum(x)


def dummy_embed(spark: SparkSession, sf: str) -> DataFrame:
    e = vectors.embed(chunks(spark, sf))
    return e.select("chunk_id", "dim", F.round("norm", 5).alias("norm"), F.transform("vec", lambda x: _rounded(x.cast("double"), 5)).alias("vec"))


def hybrid_fusion(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    lex = lexical.top(lexical.scanned(c, lexical.parse(TWO)), 15)
    q = spark.range(1).select(vectors.embedder("dummy")(F.lit(TWO))).first()[0]
    out = vectors.fused(lex, vectors.top_k(vectors.embed(c), q, 40), 0.5, 0.7, 30)
    return out.select("chunk_id", "hit_kind", *[F.round(k, 5).alias(k) for k in ("fts_score", "vec_score", "rank_score")])


_SIM_SQL = f"{oracle.dot('vec', 'q')} / ({oracle.norm('vec')} * {oracle.norm('q')})"
_FUSION_SQL = f"""WITH {oracle.scores(TWO)},
lex AS (SELECT chunk_id, bm25 FROM s ORDER BY round(bm25, 9), chunk_id LIMIT 15),
w AS (SELECT chunk_id, {oracle.embedding("body[1:4000]")} AS raw FROM c), v AS (SELECT chunk_id, {oracle.unit("raw")} AS vec FROM w),
z AS (SELECT {oracle.embedding(f"'{TWO}'")} AS raw), y AS (SELECT {oracle.unit("raw")} AS q FROM z),
near AS (SELECT chunk_id, {_SIM_SQL} AS sim FROM v, y ORDER BY round({_SIM_SQL}, 9) DESC, chunk_id LIMIT 40),
b AS (SELECT chunk_id, bm25 AS fts_score, sim AS vec_score, CASE WHEN bm25 IS NOT NULL AND sim IS NOT NULL THEN 0.5e0 * bm25 + 0.7e0 * sim ELSE coalesce(bm25, sim) END AS rank_score FROM lex FULL JOIN near USING (chunk_id))
SELECT chunk_id, CASE WHEN fts_score IS NULL THEN 'text_vector' ELSE 'text_fts' END AS hit_kind, round(fts_score, 5) AS fts_score, round(vec_score, 5) AS vec_score, round(rank_score, 5) AS rank_score FROM b ORDER BY round(b.rank_score, 9) DESC, chunk_id LIMIT 30"""


def index_status(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    return c.agg(F.count("*").alias("document_count"), F.countDistinct("path").alias("files"), F.max("line_end").alias("longest"))


def wordpiece_encode(spark: SparkSession, sf: str) -> DataFrame:
    vocab = {t: i for i, t in enumerate(fixtures.VOCABULARY)}
    return chunks(spark, sf).select("chunk_id", encoder(vocab)(F.col("body")).alias("e")).select("chunk_id", "e.*")


QUERIES |= {
    "explain_hit": (explain_hit, f"WITH {oracle.CHUNKS} SELECT chunk_id AS hit_id, path, 'text_fts' AS hit_kind, length(body)::INT AS chunk_char_count, {oracle.ISO} AS last_write_utc_iso, body[1:1200] AS snippet FROM c WHERE chunk_id = (SELECT min(chunk_id) FROM c)"),
    "snippet": (snippet, None),
    "razor_header": (_headers(".razor"), oracle.headers(fixtures.FILES, ".razor", oracle.RAZOR_TAGS)),
    "axaml_header": (_headers(".axaml"), oracle.headers(fixtures.FILES, ".axaml", oracle.AXAML_TAGS)),
    "pair_files": (lambda s, d: headers.paired(fixture(s)).select("path", "pair"), f"WITH f AS ({oracle.values(fixtures.FILES, 'path, extension, text')}) SELECT f.path, g.path AS pair FROM f LEFT JOIN f g ON g.path = CASE WHEN regexp_matches(lower(f.path), '[.](razor|axaml)$') THEN f.path || '.cs' WHEN regexp_matches(lower(f.path), '[.](razor|axaml)[.]cs$') THEN f.path[:-4] END"),
    "skip_reasons": (lambda s, d: reindex.skip_counts(skips(s, d)), f"{_SKIPS_SQL} SELECT reason, count(*) AS n FROM skips GROUP BY reason"),
    "skip_tallies": (lambda s, d: reindex.tallies(skips(s, d)), f"{_SKIPS_SQL} SELECT count(*) FILTER (WHERE reason = 'too_large') AS skipped_large, 0::BIGINT AS skipped_binary, count(*) FILTER (WHERE reason IN ('denylist', 'gitignore')) AS skipped_excluded FROM skips"),
    "skip_top_prefixes": (lambda s, d: reindex.top_prefixes(skips(s, d).withColumn("path", F.expr("substring(path, 6)"))), f"{_SKIPS_SQL} SELECT min(split_part(path, '/', 2)) AS prefix, count(*) AS n FROM skips GROUP BY lower(split_part(path, '/', 2)) ORDER BY n DESC, lower(split_part(min(path), '/', 2)) LIMIT 12"),
    "skip_sample": (lambda s, d: reindex.sample(skips(s, d)), f"{_SKIPS_SQL} SELECT path, reason FROM skips ORDER BY path, reason LIMIT 50"),
    "ext_effective_filter": (lambda s, d: files(s, d).where(F.lower("extension").isin(NARROW.extensions())).groupBy("extension").agg(F.count("*").alias("n")), f"WITH {oracle.FILES} SELECT extension, count(*) AS n FROM f WHERE extension IN ('.md', '.cs') GROUP BY extension"),
    "gitignore_filter": (lambda s, d: files(s, d).select("path", ignored(F.col("path"), fixtures.RULES).alias("ignored")), f"WITH {oracle.FILES} SELECT path, {_IGNORED_SQL} AS ignored FROM f"),
    "binary_filter": (served.probed, f"WITH b AS ({oracle.values(fixtures.BLOBS, 'name, hex')}) SELECT name, len(list_filter(range(least(8, length(hex) // 2)), lambda i: substr(hex, i * 2 + 1, 2) = '00')) > 0 AS is_binary FROM b"),
    "size_filter": (lambda s, d: files(s, d).select("path", F.coalesce(skip_reason(Settings(exclude_path_segments=[], max_indexed_file_bytes=4000), []) == "too_large", F.lit(False)).alias("too_large")), f"WITH {oracle.FILES} SELECT path, size_bytes > 4000 AS too_large FROM f"),
    "incremental_changed": (lambda s, d: reindex.changed(new_listing(s, d), old_state(s, d)), f"{_STATES_SQL} SELECT n.* FROM n LEFT JOIN o USING (path) WHERE o.path IS NULL OR o.size_bytes <> n.size_bytes OR o.last_write_utc_ticks <> n.last_write_utc_ticks"),
    "incremental_stale": (lambda s, d: reindex.stale(old_state(s, d), new_listing(s, d)), f"{_STATES_SQL} SELECT * FROM o WHERE path NOT IN (SELECT path FROM n)"),
    "incremental_merge": (merged, f"{_STATES_SQL} SELECT * FROM n"),
    "vec_norms": (lambda s, d: stored(s, d).select("chunk_id", "dim", F.round("norm", 6).alias("norm")), f"SELECT vec_id AS chunk_id, len(embedding)::INT AS dim, round({oracle.norm('embedding')}, 6) AS norm FROM embeddings"),
    "dummy_embed": (dummy_embed, f"WITH {oracle.CHUNKS}, w AS (SELECT chunk_id, {oracle.embedding('body[1:4000]')} AS raw FROM c), v AS (SELECT chunk_id, {oracle.unit('raw')} AS v FROM w) SELECT chunk_id, len(v)::INT AS dim, round({oracle.norm('v')}, 5) AS norm, list_transform(v, lambda x: round(x::DOUBLE, 5)) AS vec FROM v"),
    "cosine_topk": (cosine_topk, f"{_NEAR_SQL} {_TOP_SQL} 50"),
    "vec_allowed_ext": (vec_allowed_ext, f"{_NEAR_SQL} WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang IN ('de', 'fr')) {_TOP_SQL} 20"),
    "vec_prune_orphans": (lambda s, d: vectors.prune(stored(s, d), _as_chunks(s, d), [".md"]).select("chunk_id", "dim"), "SELECT vec_id AS chunk_id, len(embedding)::INT AS dim FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"),
    "hybrid_fusion": (hybrid_fusion, _FUSION_SQL),
    "first_chunk_per_path": (lambda s, d: reindex.first_chunks(chunks(s, d)).select("path", "line_start", "line_end", F.md5(F.col("excerpt").cast("binary")).alias("excerpt_md5")), f"WITH {oracle.CHUNKS} SELECT path, line_start, line_end, md5(body[1:900]) AS excerpt_md5 FROM c WHERE line_start = 1"),
    "index_status": (index_status, f"WITH {oracle.CHUNKS} SELECT count(*) AS document_count, count(DISTINCT path) AS files, max(line_end) AS longest FROM c"),
    "service_search": (served.served(files, served.search), oracle.search(TWO, fresh=True)),
    "service_reindex": (served.served(files, served.reindexed), served.REINDEXED_SQL),
    "service_accounts": (served.served(files, served.accounts, served.SCAN, served.IGNORE), served.accounts_sql(_IGNORED_SQL)),
    "service_vectors": (served.served(files, served.vectors_of_settings, served.SEMANTIC), f"WITH {oracle.CHUNKS} SELECT 32 AS dim, count(*) AS n FROM c"),
    "wordpiece_encode": (wordpiece_encode, None),
    "observer_feed": (lambda s, d: feed_counts(s.read.parquet(f"{d}/events.parquet")).select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n"), "SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in QUERIES.items() if s}
