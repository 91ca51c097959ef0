"""Every operator as a query over the given tables, and the same in SQL.

The tables stand in for a wiki: `documents` are its pages (and what was stored of
them), `pages` are bodies with markup, `benchmark` are questions, `embeddings`
vectors, `conversations` chats. So that wiki and store differ, the pages of source
src3 are gone from the wiki and those of src7 have never been stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import pagebreaks, text
from .operators import chunks as chunking
from .operators import fusion, ingest, keyword_index, prompts, sync, vectors
from .plans import jobs
from .sources import store, wiki
from .sources.shared import scratch, spread, written
from .streaming import updates

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query by its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


# What the tables stand in for, in Spark and in SQL.


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    tags = F.when(F.col("lang") == "de", F.array(F.lit("pdf"))).when(F.col("lang") == "es", F.lit(None)).otherwise(F.array(F.lit("note")))
    return _read(spark, folder, "documents").select(
        F.col("doc_id").alias("page_id"), F.substring("text", 1, 60).alias("title"), F.concat_ws("/", "source", "doc_id").alias("path"), F.lit("ko").alias("locale"),
        tags.alias("tags"), F.coalesce("text", F.lit("")).alias("content"), "source", "lang",
    )


def _wiki(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).where("source <> 'src3'")


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_pages(_pages(spark, folder).where("source <> 'src7'"))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_pages(_pages(spark, folder))


def _index(chunks: DataFrame) -> keyword_index.KeywordIndex:
    return keyword_index.stored(keyword_index.build(chunks))


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


PAGES = "p AS (SELECT doc_id AS page_id, substr(text, 1, 60) AS title, source || '/' || doc_id AS path, 'ko' AS locale, CASE lang WHEN 'de' THEN ['pdf'] WHEN 'es' THEN NULL ELSE ['note'] END AS tags, coalesce(text, '') AS content, source, lang FROM documents)"


def _cut(name: str, source: str) -> str:
    return f"{name} AS (SELECT 'page_' || page_id || '_chunk_' || i AS chunk_id, page_id, i::int AS chunk_index, title, path, substr(content, 450 * i + 1, 500) AS document FROM (SELECT *, unnest(range(0, (length(content) + 449) // 450)) AS i FROM {source}))"


CHUNKS = f"{PAGES}, {_cut('c', 'p')}"
STORED = f"{PAGES}, s_ AS (SELECT * FROM p WHERE source <> 'src7'), w AS (SELECT * FROM p WHERE source <> 'src3'), {_cut('s', 's_')}"


def _sql_pattern(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{text.SPACE}+|{text.SPACE}+$', '', 'g')"


def _markup_sql(c: str) -> str:
    for pattern, new in text.MARKUP:
        c = f"regexp_replace({c}, {_sql_pattern(pattern)}, '{new.replace('$', chr(92))}', 'g')"
    for entity, new in text.ENTITIES:
        c = f"replace({c}, '{entity}', {_sql_pattern(new)})"
    return c


def _noise_sql(c: str) -> str:
    bare = _strip_sql(c)
    return f"(length({bare}) = 0 OR (length({bare}) > 5 AND length(regexp_replace({bare}, '[a-zA-Z0-9가-힣]|{text.SPACE}', '', 'g')) * 10 > length({bare}) * 3))"


def _clean_sql(c: str) -> str:
    plain = _markup_sql(f"regexp_replace({c}, '{text.FENCE}', '', 'g')")
    lines = f"array_to_string(list_filter(string_split({plain}, chr(10)), lambda x: NOT {_noise_sql('x')}), ' ')"
    return _strip_sql(f"regexp_replace({lines}, '{text.SPACE}+', ' ', 'g')")


def _tokens_sql(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({c}, '{text.TOKEN}'), lambda t: lower(regexp_replace(t, '{text.PARTICLE}', '\\1'))), lambda t: length(t) >= 2)"


def _index_sql(chunks: str) -> str:
    return f"""tok AS (SELECT chunk_id, page_id, chunk_index, {_tokens_sql("document")} AS tokens FROM {chunks}),
  post AS (SELECT chunk_id, page_id, chunk_index, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, page_id, chunk_index, len(tokens) AS dl, unnest(tokens) AS token FROM tok) GROUP BY ALL),
  corp AS (SELECT count(*) AS n_chunks, avg(len(tokens)) AS avgdl FROM tok),
  raw AS (SELECT token, df, ln(n_chunks - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT token, count(*) AS df FROM post GROUP BY token), corp),
  terms AS (SELECT token, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""


def _scores_sql(questions: str = "SELECT item_id AS query_id, text AS query FROM benchmark") -> str:
    return f"""q AS ({questions}),
  qt AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({_tokens_sql("query")}) AS token FROM q) GROUP BY ALL),
  sc AS (SELECT query_id, chunk_id, page_id, chunk_index, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM post JOIN terms USING (token) JOIN qt USING (token), corp GROUP BY ALL),
  bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, page_id, chunk_index) AS bm25_rank FROM sc) WHERE bm25_rank <= 20 AND round(score, 9) > 0)"""


def _embedding_sql(name: str, source: str, key: str, column: str) -> str:
    """name(key, embedding) of a table's text column."""
    return f"""{name}_n AS MATERIALIZED (SELECT {key}, b, count(*)::double AS n FROM (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::bigint % {vectors.DIMENSIONS} AS b FROM (SELECT {key}, unnest({_tokens_sql(column)}) AS t FROM {source})) GROUP BY ALL),
  {name}_l AS (SELECT {key}, sqrt(sum(n * n)) AS norm FROM {name}_n GROUP BY {key}),
  {name} AS MATERIALIZED (SELECT k.{key}, list(coalesce(n / norm, 0.0::double) ORDER BY i) AS embedding FROM (SELECT DISTINCT {key} FROM {source}) k CROSS JOIN range({vectors.DIMENSIONS}) r(i) LEFT JOIN {name}_n x ON x.{key} = k.{key} AND b = i LEFT JOIN {name}_l y ON y.{key} = k.{key} GROUP BY k.{key})"""


def _nearest_sql(chunks: str, questions: str, k: int) -> str:
    """chunks and questions have an embedding."""
    return f"""nn AS (SELECT query_id, chunk_id, page_id, chunk_index, power(list_distance(a.embedding::double[], b.embedding::double[]), 2) AS distance FROM {questions} a, {chunks} b),
  vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), page_id, chunk_index) AS vec_rank FROM nn) WHERE vec_rank <= {k})"""


FUSED = """fu AS (SELECT query_id, chunk_id, vec_rank, bm25_rank, coalesce(1.0::double / (60 + vec_rank), 0) + coalesce(1.0::double / (60 + bm25_rank), 0) AS rrf_score FROM vec FULL JOIN bm USING (query_id, chunk_id)),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, vec_rank NULLS LAST, bm25_rank NULLS LAST) AS fused_rank FROM fu) WHERE fused_rank <= 5)"""
HYBRID = f"{CHUNKS}, {_embedding_sql('cv', 'c', 'chunk_id', 'document')}, ce AS MATERIALIZED (SELECT * FROM c JOIN cv USING (chunk_id)), {_index_sql('c')}, {_scores_sql()}, {_embedding_sql('qe', 'q', 'query_id', 'query')}, {_nearest_sql('ce', 'qe', 20)}, {FUSED}"


# Sources.


@query(f"WITH {PAGES} SELECT page_id, path, title, tags, locale FROM p")
def page_list_json(spark: SparkSession, folder: str) -> DataFrame:
    page = F.struct(F.col("page_id").alias("id"), "path", "title", "tags")
    return wiki.page_list(_pages(spark, folder).select(F.to_json(F.struct(F.struct(F.struct(F.array(page).alias("list")).alias("pages")).alias("data"))).alias("json")))


def _singles(spark: SparkSession, folder: str) -> DataFrame:
    tags = F.array(*[F.struct(x.alias("tag")) for x in (F.col("lang"), F.lit(""), F.col("source"))])
    single = F.struct(F.struct(F.struct(F.struct(F.col("text").alias("content"), tags.alias("tags")).alias("single")).alias("pages")).alias("data"))
    return _read(spark, folder, "documents").select(F.col("doc_id").alias("page_id"), F.to_json(single).alias("json"))


@query("SELECT doc_id AS page_id, [lang, source] AS tags FROM documents")
def single_page_tags(spark: SparkSession, folder: str) -> DataFrame:
    return _singles(spark, folder).select("page_id", text.tag_names(wiki.page_tags(F.col("json"))).alias("tags"))


@query("SELECT doc_id AS page_id, coalesce(text, '') AS content FROM documents")
def page_content(spark: SparkSession, folder: str) -> DataFrame:
    return _singles(spark, folder).select("page_id", wiki.page_content(F.col("json")).alias("content"))


# Pages and stored chunks.


@query(f"WITH {PAGES} SELECT page_id, coalesce(list_contains(tags, 'pdf'), false) AS is_pdf FROM p")
def split_pdf_tag(spark: SparkSession, folder: str) -> DataFrame:
    tagged, others = sync.split_by_tag(_pages(spark, folder))
    return tagged.select("page_id", F.lit(True).alias("is_pdf")).union(others.select("page_id", F.lit(False)))


@query(f"WITH {PAGES} SELECT page_id, title, CASE WHEN source = 'src5' THEN '' ELSE content END AS content FROM p")
def join_bodies(spark: SparkSession, folder: str) -> DataFrame:
    pages = _pages(spark, folder)
    return sync.with_bodies(pages.drop("content"), pages.where("source <> 'src5'")).select("page_id", "title", "content")


@query(f"WITH {STORED} SELECT DISTINCT page_id FROM s WHERE page_id IS NOT NULL")
def existing_page_ids(spark: SparkSession, folder: str) -> DataFrame:
    return sync.existing_page_ids(_stored(spark, folder))


@query(f"WITH {STORED} SELECT DISTINCT page_id FROM s WHERE page_id NOT IN (SELECT page_id FROM w)")
def orphan_pages(spark: SparkSession, folder: str) -> DataFrame:
    return sync.orphans(sync.existing_page_ids(_stored(spark, folder)), _wiki(spark, folder))


@query(f"WITH {STORED} SELECT page_id FROM s EXCEPT SELECT page_id FROM w")
def orphan_pages_as_set(spark: SparkSession, folder: str) -> DataFrame:
    return sync.orphans_as_set(sync.existing_page_ids(_stored(spark, folder)), _wiki(spark, folder))


PURGE = "g AS (SELECT page_id FROM w WHERE NOT coalesce(list_contains(tags, 'pdf'), false) UNION SELECT page_id FROM s WHERE page_id NOT IN (SELECT page_id FROM w))"


def _purge(spark: SparkSession, folder: str) -> DataFrame:
    pages = _wiki(spark, folder)
    return sync.to_purge(sync.split_by_tag(pages)[1], sync.orphans(sync.existing_page_ids(_stored(spark, folder)), pages))


@query(f"WITH {STORED}, {PURGE} SELECT page_id FROM g")
def purge_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _purge(spark, folder)


@query(f"WITH {STORED}, {PURGE} SELECT chunk_id, page_id FROM s WHERE page_id NOT IN (SELECT page_id FROM g)")
def purge_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return sync.purged(_stored(spark, folder), _purge(spark, folder)).select("chunk_id", "page_id")


# Text.


@query(f"SELECT doc_id, regexp_replace('a ```x' || chr(10) || source || '``` ' || coalesce(text, ''), '{text.FENCE}', '', 'g') AS stripped FROM documents")
def strip_code_fences(spark: SparkSession, folder: str) -> DataFrame:
    fenced = F.concat(F.lit("a ```x\n"), "source", F.lit("``` "), F.coalesce("text", F.lit("")))
    return _read(spark, folder, "documents").select("doc_id", text.without_fences(fenced).alias("stripped"))


@query(f"SELECT page_id, {_markup_sql('html')} AS plain FROM pages")
def markup_to_text(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "pages").select("page_id", text.markup_to_text(F.col("html")).alias("plain"))


@query(f"SELECT doc_id, pos::int AS pos, {_noise_sql('line')} AS noise FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)")
def noise_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = _read(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("doc_id", "pos", text.is_noise_line(F.col("line")).alias("noise"))


@query(f"SELECT page_id, {_clean_sql('html')} AS cleaned FROM pages")
def clean_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "pages").select("page_id", text.clean_markdown(F.col("html")).alias("cleaned"))


@query(f"WITH {PAGES}, k AS (SELECT page_id, {_clean_sql('content')} AS content FROM p WHERE length(content) > 0) SELECT page_id, content FROM k WHERE length(content) >= 10")
def min_length_pages(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.cleaned(_pages(spark, folder)).select("page_id", "content")


@query(f"WITH {CHUNKS} SELECT page_id, chunk_index, document FROM c")
def chunk_text(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).select("page_id", "chunk_index", "document")


@query(f"WITH {CHUNKS} SELECT chunk_id, page_id, title, path FROM c")
def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).select("chunk_id", "page_id", "title", "path")


@query(f"SELECT doc_id, {_tokens_sql('text')} AS tokens FROM documents")
def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "documents").select("doc_id", text.tokenize(F.col("text")).alias("tokens"))


# Keyword index.


@query(f"WITH {CHUNKS}, {_index_sql('c')} SELECT chunk_id, token, tf, dl FROM post")
def postings(spark: SparkSession, folder: str) -> DataFrame:
    return keyword_index.build(_chunks(spark, folder)).postings.select("chunk_id", "token", "tf", "dl")


@query(f"WITH {CHUNKS}, {_index_sql('c')} SELECT token, df, round(idf, 6) AS idf FROM terms")
def term_stats(spark: SparkSession, folder: str) -> DataFrame:
    return keyword_index.build(_chunks(spark, folder)).terms.select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {CHUNKS}, {_index_sql('c')} SELECT n_chunks, round(avgdl, 6) AS avgdl FROM corp")
def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return keyword_index.build(_chunks(spark, folder)).corpus.select("n_chunks", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {CHUNKS}, {_index_sql('c')}, {_scores_sql()} SELECT query_id, chunk_id, round(score, 6) AS score FROM sc")
def bm25_scores(spark: SparkSession, folder: str) -> DataFrame:
    return keyword_index.scores(_index(_chunks(spark, folder)), _questions(spark, folder)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {CHUNKS}, {_index_sql('c')}, {_scores_sql()} SELECT query_id, chunk_id, round(score, 6) AS score, bm25_rank::int AS bm25_rank FROM bm")
def bm25_search(spark: SparkSession, folder: str) -> DataFrame:
    return keyword_index.search(_index(_chunks(spark, folder)), _questions(spark, folder)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "bm25_rank")


ADDED = f"{STORED}, n_ AS (SELECT * FROM p WHERE source = 'src7'), {_cut('n', 'n_')}, {_index_sql('(SELECT * FROM s UNION ALL SELECT * FROM n)')}"


@query(f"WITH {ADDED} SELECT token, df, round(idf, 6) AS idf FROM terms")
def patch_add(spark: SparkSession, folder: str) -> DataFrame:
    new = chunking.chunk_pages(_pages(spark, folder).where("source = 'src7'"))
    return keyword_index.patch_add(_index(_stored(spark, folder)), new).terms.select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {STORED}, {_index_sql('(SELECT * FROM s WHERE page_id IN (SELECT page_id FROM w))')} SELECT token, df, round(idf, 6) AS idf FROM terms")
def patch_remove(spark: SparkSession, folder: str) -> DataFrame:
    stored = _stored(spark, folder)
    old = stored.join(_pages(spark, folder).where("source = 'src3'").select("page_id"), "page_id", "left_semi")
    return keyword_index.patch_remove(_index(stored), old).terms.select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {ADDED}, {_scores_sql()} SELECT query_id, chunk_id, round(score, 6) AS score, bm25_rank::int AS bm25_rank FROM bm")
def patched_search(spark: SparkSession, folder: str) -> DataFrame:
    """A search in a stored index with two more segments: one with chunks that aren't wanted, and one that takes these out and brings others."""
    path = scratch(spark, "index")
    keyword_index.save(keyword_index.build(_stored(spark, folder)), path)
    new = chunking.chunk_pages(_pages(spark, folder).where("source = 'src7'"))
    wrong = new.withColumn("document", F.upper("document"))
    keyword_index.save_patch(spark, path, wrong, wrong.where("false"))
    keyword_index.save_patch(spark, path, new, wrong)
    return keyword_index.search(keyword_index.load_to_patch(spark, path), _questions(spark, folder)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "bm25_rank")


@query(f"WITH {CHUNKS}, {_index_sql('c')} SELECT token, df, round(idf, 6) AS idf, n_chunks, round(avgdl, 6) AS avgdl FROM terms, corp")
def store_index(spark: SparkSession, folder: str) -> DataFrame:
    """An index saved twice (the second version whole), then loaded."""
    path = scratch(spark, "index")
    keyword_index.save(keyword_index.build(_stored(spark, folder)), path)
    keyword_index.save(keyword_index.build(_chunks(spark, folder)), path)
    index = keyword_index.load(spark, path)
    return index.terms.crossJoin(F.broadcast(index.corpus)).select("token", "df", F.round("idf", 6).alias("idf"), "n_chunks", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {CHUNKS} SELECT chunk_id, page_id, title FROM c")
def store_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks appended in two batches, then scanned without their documents."""
    path, pages = scratch(spark, "chunks"), _pages(spark, folder)
    for batch in (pages.where("source <> 'src7'"), pages.where("source = 'src7'")):
        store.append_chunks(chunking.chunk_pages(batch), path)
    return store.scan_chunks(spark, path, "chunk_id", "page_id", "title")


@query(f"WITH {CHUNKS} SELECT chunk_id, page_id FROM c JOIN (SELECT page_id AS wanted FROM p WHERE lang = 'de') ON starts_with(chunk_id, 'page_' || wanted || '_chunk_')")
def chunks_by_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.of_pages(_chunks(spark, folder), _pages(spark, folder).where("lang = 'de'")).select("chunk_id", "page_id")


# Vectors and fusion.


@query(f"WITH {_embedding_sql('v', 'documents', 'doc_id', 'text')} SELECT doc_id, list_transform(embedding, lambda x: round(x, 6)) AS embedding FROM v")
def hash_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    made = vectors.hash_embeddings(_read(spark, folder, "documents"), "doc_id", "text")
    return made.select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "embeddings").select(F.concat(F.lit("page_"), "vec_id", F.lit("_chunk_0")).alias("chunk_id"), F.col("vec_id").alias("page_id"), F.lit(0).alias("chunk_index"), "embedding")


VECTORS = f"ce AS (SELECT 'page_' || vec_id || '_chunk_0' AS chunk_id, vec_id AS page_id, 0 AS chunk_index, embedding FROM embeddings), qe AS (SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON item_id = vec_id), {_nearest_sql('ce', 'qe', 20)}"


@query(f"WITH {VECTORS} SELECT query_id, chunk_id, round(distance, 6) AS distance, vec_rank::int AS vec_rank FROM vec")
def vector_search(spark: SparkSession, folder: str) -> DataFrame:
    asked = _read(spark, folder, "benchmark").join(_read(spark, folder, "embeddings"), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "embedding")
    return vectors.nearest(_vectors(spark, folder), asked).select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "vec_rank")


def vector_search_probed(spark: SparkSession, folder: str) -> DataFrame:
    """Every fiftieth vector looked for among all, in the cells near to it alone. Approximate, so there is no SQL; a test measures its recall."""
    asked = _read(spark, folder, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.nearest_probed(_vectors(spark, folder), asked).select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "vec_rank")


QUERIES["vector_search_probed"] = vector_search_probed


@query(f"WITH {CHUNKS}, {_index_sql('c')}, {_scores_sql()}, vec AS (SELECT query_id, chunk_id, (21 - bm25_rank) AS vec_rank FROM bm WHERE bm25_rank > 5), {FUSED} SELECT query_id, chunk_id, coalesce(vec_rank, -1)::int AS vec_rank, coalesce(bm25_rank, -1)::int AS bm25_rank, round(rrf_score, 9) AS rrf_score, fused_rank::int AS fused_rank FROM f")
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """The keyword ranking fused with a second one: its lower part upside down."""
    words = keyword_index.search(_index(_chunks(spark, folder)), _questions(spark, folder))
    second = words.where("bm25_rank > 5").select("query_id", "chunk_id", (21 - F.col("bm25_rank")).alias("vec_rank"))
    return fusion.fused(second, words).withColumn("rrf_score", F.round("rrf_score", 9))


@query(f"WITH {HYBRID} SELECT f.query_id, f.chunk_id, coalesce(vec_rank, -1)::int AS vec_rank, coalesce(bm25_rank, -1)::int AS bm25_rank, round(rrf_score, 9) AS rrf_score, fused_rank::int AS fused_rank, coalesce(document, '') AS document, title, path, page_id FROM f LEFT JOIN c USING (chunk_id)")
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks and index are written once, as a stored collection's are, and searched there."""
    chunks = written(_chunks(spark, folder), "chunks")
    index = _index(chunks)
    return jobs.hybrid_search(chunks, index, _questions(spark, folder)).withColumn("rrf_score", F.round("rrf_score", 9))


@query(f"WITH {CHUNKS}, {_embedding_sql('cv', 'c', 'chunk_id', 'document')}, ce AS MATERIALIZED (SELECT * FROM c JOIN cv USING (chunk_id)), {_embedding_sql('qv', 'benchmark', 'item_id', 'text')}, qe AS (SELECT item_id AS query_id, embedding FROM qv), {_nearest_sql('ce', 'qe', 5)} SELECT query_id, chunk_id, vec_rank::int AS vec_rank FROM vec")
def vector_only_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid search without a keyword index."""
    return jobs.hybrid_search(_chunks(spark, folder), None, _questions(spark, folder)).select("query_id", "chunk_id", "vec_rank")


@query(f"WITH {STORED}, {_cut('c', 'p')}, {_index_sql('c')}, {_scores_sql()} SELECT bm.query_id, bm.chunk_id, coalesce(s.document, '') AS document, s.title FROM bm LEFT JOIN s USING (chunk_id)")
def hydrate_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of an index that knows chunks which aren't stored."""
    hits = keyword_index.search(_index(_chunks(spark, folder)), _questions(spark, folder)).select("query_id", "chunk_id")
    return fusion.hydrated(hits, _stored(spark, folder)).select("query_id", "chunk_id", "document", "title")


# Jobs.


def _full_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pages, stored = _wiki(spark, folder), _stored(spark, folder)
    return pages, stored, jobs.full_index(pages.drop("content"), _pages(spark, folder), stored)


FULL = f"{STORED}, {PURGE}, k AS (SELECT * FROM (SELECT page_id, title, path, {_clean_sql('content')} AS content FROM w WHERE length(content) > 0 AND NOT coalesce(list_contains(tags, 'pdf'), false)) WHERE length(content) >= 10), {_cut('kc', 'k')}, a AS (SELECT * FROM s WHERE page_id NOT IN (SELECT page_id FROM g) UNION ALL SELECT * FROM kc)"


@query(f"WITH {FULL} SELECT * FROM a")
def full_index(spark: SparkSession, folder: str) -> DataFrame:
    return _full_index(spark, folder)[2]


@query(f"WITH {FULL} SELECT (SELECT count(*) FROM w) AS n_pages, (SELECT count(*) FROM w WHERE NOT coalesce(list_contains(tags, 'pdf'), false)) AS n_reindexed, (SELECT count(*) FROM w WHERE list_contains(tags, 'pdf')) AS n_pdf, (SELECT count(DISTINCT page_id) FROM s WHERE page_id NOT IN (SELECT page_id FROM w)) AS n_orphans, (SELECT count(*) FROM s) AS n_before, (SELECT count(*) FROM a) AS n_after")
def index_report(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.index_report(*_full_index(spark, folder))[1]


@query(f"WITH {CHUNKS} SELECT page_id, count(*) AS n_chunks, sum(length(document))::bigint AS n_chars FROM c GROUP BY page_id")
def page_report(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.page_report(_chunks(spark, folder))


@query(f"WITH {STORED}, n_ AS (SELECT * REPLACE ('updated ' || content AS content) FROM p WHERE source IN ('src7', 'src5')), {_cut('n', 'n_')} SELECT * FROM s WHERE page_id NOT IN (SELECT page_id FROM n_) UNION ALL SELECT * FROM n")
def replace_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = _pages(spark, folder).where("source in ('src7', 'src5')").withColumn("content", F.concat(F.lit("updated "), "content"))
    return jobs.replace_pages(_stored(spark, folder), None, pages)[0].select("chunk_id", "page_id", "chunk_index", "title", "path", "document")


@query(f"WITH {STORED}, n_ AS (SELECT * REPLACE ('updated ' || content AS content) FROM p WHERE source IN ('src7', 'src5')), {_cut('n', 'n_')}, a AS (SELECT chunk_id, document FROM s WHERE page_id NOT IN (SELECT page_id FROM n_) UNION ALL SELECT chunk_id, document FROM n), {_embedding_sql('v', 'a', 'chunk_id', 'document')} SELECT chunk_id, document, list_transform(embedding, lambda x: round(x, 6)) AS embedding FROM a JOIN v USING (chunk_id)")
def replace_pages_embedded(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that keep their embeddings, and new ones that get theirs."""
    pages = _pages(spark, folder).where("source in ('src7', 'src5')").withColumn("content", F.concat(F.lit("updated "), "content"))
    stored = written(vectors.embedded(_stored(spark, folder), "chunk_id", "document"), "chunks")
    return jobs.replace_pages(stored, None, pages)[0].select("chunk_id", "document", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query(f"WITH {STORED}, n_ AS (SELECT * REPLACE ('updated ' || content AS content) FROM p WHERE source IN ('src7', 'src5')), {_cut('n', 'n_')}, a AS (SELECT chunk_id, page_id, document FROM s WHERE page_id NOT IN (SELECT page_id FROM n_) UNION ALL SELECT chunk_id, page_id, document FROM n) SELECT chunk_id, document FROM a JOIN (SELECT page_id FROM p WHERE lang = 'fr') USING (page_id)")
def batches_into_store(spark: SparkSession, folder: str) -> DataFrame:
    """A chunk store that two batches have made, read for some pages alone."""
    path, pages = scratch(spark, "store"), _pages(spark, folder)
    put = updates.into_store(path, stream="query")
    put(pages.where("source <> 'src7'"), 0)
    later = pages.where("source in ('src7', 'src5')").withColumn("content", F.concat(F.lit("updated "), "content"))
    put(later, 1)
    put(pages.withColumn("content", F.lit("a batch that the store has already")), 1)
    return store.chunks_of(spark, path, pages.where("lang = 'fr'")).select("chunk_id", "document")


@query(f"WITH {STORED}, n_ AS (SELECT * REPLACE ('updated ' || content AS content) FROM p WHERE source IN ('src7', 'src5')), {_cut('n', 'n_')}, a AS (SELECT * FROM s WHERE page_id NOT IN (SELECT page_id FROM n_) UNION ALL SELECT * FROM n), {_index_sql('a')} SELECT token, df, round(idf, 6) AS idf, n_chunks, round(avgdl, 6) AS avgdl FROM terms, corp")
def replace_pages_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index after the pages' chunks have been patched out and in."""
    pages = _pages(spark, folder).where("source in ('src7', 'src5')").withColumn("content", F.concat(F.lit("updated "), "content"))
    stored = _stored(spark, folder)
    index = jobs.replace_pages(stored, _index(stored), pages)[1]
    return index.terms.crossJoin(F.broadcast(index.corpus)).select("token", "df", F.round("idf", 6).alias("idf"), "n_chunks", F.round("avgdl", 6).alias("avgdl"))


# Ingest.

PATH = f"source || '/' || regexp_replace(regexp_replace({_strip_sql('substr(text, 1, 60)')}, '(?:{text.SPACE}|/)+', '-', 'g'), '[^\\p{{L}}\\p{{N}}_-]', '', 'g')"
INCOMING = f"d AS (SELECT doc_id, {PATH} AS path, substr(text, 1, 60) AS title, text AS markdown, lang, source FROM documents), t AS (SELECT doc_id AS page_id, title, path, 'ko' AS locale, CASE lang WHEN 'de' THEN ['pdf'] WHEN 'es' THEN NULL ELSE ['note'] END AS tags, markdown AS content FROM d WHERE lang <> 'fr'), e AS (SELECT path, min(page_id) AS existing_id FROM t WHERE page_id <> 0 GROUP BY path)"


def _incoming(spark: SparkSession, folder: str) -> DataFrame:
    title = F.substring("text", 1, 60)
    docs = _read(spark, folder, "documents").select("doc_id", text.page_path(F.col("source"), title).alias("path"), title.alias("title"), F.col("text").alias("markdown"), "lang")
    return vectors.embedded(docs, "doc_id", "title")


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of the wiki that documents may replace: those of all languages but one."""
    tags = F.when(F.col("lang") == "de", F.array(F.lit("pdf"))).when(F.col("lang") == "es", F.lit(None)).otherwise(F.array(F.lit("note")))
    return _incoming(spark, folder).where("lang <> 'fr'").select(F.col("doc_id").alias("page_id"), "title", "path", F.lit("ko").alias("locale"), tags.alias("tags"), F.col("markdown").alias("content"), "embedding")


def _heads(spark: SparkSession, folder: str) -> DataFrame:
    return _targets(spark, folder).select(chunking.chunk_id(F.col("page_id"), F.lit(0)).alias("chunk_id"), "page_id", F.lit(0).alias("chunk_index"), "title", "path", "embedding")


@query(f"SELECT doc_id, {PATH} AS path FROM documents")
def page_paths(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "documents").select("doc_id", text.page_path(F.col("source"), F.substring("text", 1, 60)).alias("path"))


@query(f"WITH {INCOMING} SELECT doc_id, existing_id IS NOT NULL AS is_existing, existing_id FROM d LEFT JOIN e USING (path)")
def exact_path_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.exact_paths(_incoming(spark, folder), _targets(spark, folder)).select("doc_id", "is_existing", "existing_id")


SIMILAR = f"""{INCOMING}, {_embedding_sql("de", "d", "doc_id", "title")},
  ce AS MATERIALIZED (SELECT page_id, page_id AS chunk_id, 0 AS chunk_index, title, path, embedding FROM t JOIN de ON page_id = doc_id), qe AS (SELECT doc_id AS query_id, embedding FROM de), {_nearest_sql("ce", "qe", 3)},
  s1 AS (SELECT query_id AS doc_id, t.path, t.title, distance, vec_rank, row_number() OVER (PARTITION BY query_id, t.path ORDER BY vec_rank) AS nth FROM vec JOIN t USING (page_id) WHERE round(distance, 9) <= 0.2 AND t.path IS NOT NULL),
  sim AS (SELECT doc_id, path, title, distance, row_number() OVER (PARTITION BY doc_id ORDER BY vec_rank) AS place FROM s1 WHERE nth = 1)"""


@query(f"WITH {SIMILAR} SELECT doc_id, path, title, round(distance, 6) AS distance, round(greatest(0, 1 - distance), 6) AS similarity, place::int AS place FROM sim")
def similar_titles(spark: SparkSession, folder: str) -> DataFrame:
    found = ingest.similar_titles(_incoming(spark, folder), _heads(spark, folder))
    return found.select("doc_id", "path", "title", F.round("distance", 6).alias("distance"), F.round(ingest.similarity(F.col("distance")), 6).alias("similarity"), "place")


PLAN = f"""{SIMILAR}, pl0 AS (SELECT d.doc_id, d.title, d.path AS own, CASE WHEN e.existing_id IS NOT NULL THEN d.path ELSE sim.path END AS candidate FROM d LEFT JOIN e USING (path) LEFT JOIN sim ON sim.doc_id = d.doc_id AND place = 1),
  pl AS (SELECT doc_id, CASE WHEN candidate IS NULL THEN 'create' WHEN existing_id IS NULL THEN 'error' ELSE 'update' END AS action, coalesce(candidate, own) AS path, existing_id AS page_id, title FROM pl0 LEFT JOIN e ON e.path = candidate)"""


def _plan(spark: SparkSession, folder: str, policy: str = "overwrite") -> DataFrame:
    return jobs.plan_ingest(_incoming(spark, folder), _targets(spark, folder), _heads(spark, folder), policy)


@query(f"WITH {PLAN} SELECT doc_id, action, path, page_id, title FROM pl")
def ingest_plan(spark: SparkSession, folder: str) -> DataFrame:
    return _plan(spark, folder)


@query(f"WITH {INCOMING} SELECT doc_id, 'create' AS action, path, NULL::bigint AS page_id, title FROM d")
def ingest_plan_create(spark: SparkSession, folder: str) -> DataFrame:
    """The plan under the policy that leaves existing pages alone."""
    return _plan(spark, folder, "create")


@query(f"WITH {PAGES} SELECT page_id, list_sort(list_distinct(coalesce(tags, []) || ['pdf', 'updated'])) AS tags FROM p")
def merge_tags(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("page_id", text.merged_tags(F.col("tags")).alias("tags"))


CHANGED = f"""{PLAN}, wk AS (SELECT pl.*, d.markdown AS content, row_number() OVER (PARTITION BY CASE action WHEN 'update' THEN 'id ' || pl.page_id ELSE 'path ' || pl.path END ORDER BY pl.doc_id DESC) AS nth FROM pl JOIN d USING (doc_id) WHERE action <> 'error'),
  up AS (SELECT wk.page_id, wk.title, wk.path, 'ko' AS locale, list_sort(list_distinct(coalesce(t.tags, []) || ['pdf', 'updated'])) AS tags, wk.content FROM wk JOIN t USING (page_id) WHERE nth = 1 AND action = 'update'),
  cr AS (SELECT (SELECT max(page_id) FROM t) + row_number() OVER (ORDER BY doc_id) AS page_id, title, path, 'ko' AS locale, ['auto', 'pdf'] AS tags, content FROM wk WHERE nth = 1 AND action = 'create')"""


@query(f"WITH {CHANGED} SELECT * FROM t WHERE page_id NOT IN (SELECT page_id FROM up) UNION ALL SELECT * FROM up UNION ALL SELECT * FROM cr")
def apply_ingest(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.applied(_plan(spark, folder), _incoming(spark, folder), _targets(spark, folder))


@query(f"WITH {CHANGED}, ch AS (SELECT * FROM up UNION ALL SELECT * FROM cr), {_cut('n', 'ch')}, {_cut('o', 't')} SELECT * FROM o WHERE page_id NOT IN (SELECT page_id FROM ch) UNION ALL SELECT * FROM n")
def apply_ingest_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk table after the plan."""
    pages = _targets(spark, folder)
    return jobs.apply_ingest(_plan(spark, folder), _incoming(spark, folder), pages, chunking.chunk_pages(pages))[1]


# Page breaks.


def _rules_sql(table: str) -> str:
    """l, b, r, k: the lines of a table (doc_id, text), without the rules that repeat."""
    return f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {table}),
  b AS (SELECT *, {_strip_sql("line")} AS bare FROM l), r AS (SELECT *, regexp_matches(bare, '{pagebreaks.TABLE_RULE}') AS rule FROM b),
  k AS (SELECT *, last_value(CASE WHEN NOT rule AND bare <> '' THEN bare END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r),
  w AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM k WHERE NOT rule OR NOT coalesce(regexp_matches(prev, '{pagebreaks.DATA_ROW}'), false) GROUP BY doc_id)"""


def _dehyphenated_sql(c: str) -> str:
    return f"regexp_replace({c}, '([가-힣a-zA-Z])-\\n([가-힣a-zA-Z])', '\\1\\2', 'g')"


def _squeezed_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '(\\|[^\\n]+)\\n\\n+(\\|)', '\\1' || chr(10) || '\\2', 'g')"


_TAIL, _HEAD = f"regexp_replace(a, '{text.SPACE}+$', '')", f"regexp_replace(x, '^{text.SPACE}+', '')"


@query(f"""WITH j AS (SELECT doc_id, {_dehyphenated_sql(f"list_reduce(string_split(coalesce(text, ''), chr(10)), lambda a, x: {_TAIL} || CASE WHEN right({_TAIL}, 1) = '|' AND left({_HEAD}, 1) = '|' THEN chr(10) WHEN length({_TAIL}) > 0 AND NOT contains('{pagebreaks.SENTENCE_END}', right({_TAIL}, 1)) THEN '' ELSE chr(10) || chr(10) END || {_HEAD})")} AS text FROM documents),
  {_rules_sql("j")} SELECT doc_id, {_squeezed_sql("coalesce(w.text, '')")} AS text FROM documents LEFT JOIN w USING (doc_id)""")
def merge_page_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose line ends have become page breaks (the SQL, which can't look around, cuts at the line ends themselves)."""
    docs = _read(spark, folder, "documents").select("doc_id", F.regexp_replace("text", r"(\.?)\n", "$1\n\n-----\n\n").alias("text"))
    return pagebreaks.merge_page_breaks(docs, "doc_id", "text")


TABLES = "replace(replace(coalesce(text, ''), '. ', chr(10) || '|---|:--|' || chr(10)), ',', chr(10) || '| 12 | x |')"


@query(f"""WITH d AS (SELECT doc_id, {TABLES} AS text FROM documents), {_rules_sql("d")} SELECT doc_id, text FROM w""")
def drop_separator_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with sentences turned into tables."""
    table = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit("\n|---|:--|\n")), F.lit(","), F.lit("\n| 12 | x |"))
    return _read(spark, folder, "documents").select("doc_id", pagebreaks.without_repeated_rules(table).alias("text"))


@query(f"""SELECT doc_id, {_squeezed_sql(_dehyphenated_sql("replace(replace(text, 'th', '-' || chr(10)), '. ', chr(10) || chr(10) || chr(10))"))} AS text FROM documents""")
def dehyphenate_squeeze(spark: SparkSession, folder: str) -> DataFrame:
    broken = F.replace(F.replace("text", F.lit("th"), F.lit("-\n")), F.lit(". "), F.lit("\n\n\n"))
    return _read(spark, folder, "documents").select("doc_id", pagebreaks.squeezed(pagebreaks.dehyphenated(broken)).alias("text"))


# Prompts.

HISTORIES = "h AS (SELECT conv_id, turn, role, text, coalesce(list({'role': role, 'content': text}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []) AS history FROM conversations)"


@query(f"WITH {HISTORIES} SELECT conv_id, turn, len(history)::int AS n, array_to_string(list_transform(history, lambda m: m.role || ': ' || m.content), chr(10)) AS history FROM h")
def chat_history(spark: SparkSession, folder: str) -> DataFrame:
    told = prompts.histories(_read(spark, folder, "conversations"))
    return told.select("conv_id", "turn", F.size("history").alias("n"), F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("history"))


HITS = f"{CHUNKS}, {_index_sql('c')}, {_scores_sql()}, hit AS (SELECT bm.query_id, bm25_rank AS fused_rank, coalesce(c.document, '') AS document, c.title, c.page_id FROM bm LEFT JOIN c USING (chunk_id) WHERE bm25_rank <= 3)"
CONTEXT = f"ctx AS (SELECT q.query_id, coalesce((SELECT string_agg(document, chr(10) || '---' || chr(10) ORDER BY fused_rank) FROM hit WHERE hit.query_id = q.query_id AND document <> ''), '{prompts.NO_HITS}') AS context FROM q)"


def _hits(spark: SparkSession, folder: str, questions: DataFrame) -> DataFrame:
    chunks = _chunks(spark, folder)
    found = keyword_index.search(_index(chunks), questions, 3)
    return fusion.hydrated(found.select("query_id", "chunk_id", F.col("bm25_rank").alias("fused_rank")), chunks)


@query(f"WITH {HITS}, {CONTEXT} SELECT query_id, context FROM ctx")
def context_strings(spark: SparkSession, folder: str) -> DataFrame:
    asked = _questions(spark, folder)
    return prompts.contexts(asked, _hits(spark, folder, asked))


TITLES = "ti AS (SELECT q.query_id, coalesce(list_sort(list(DISTINCT title)), []) AS titles FROM q LEFT JOIN hit USING (query_id) GROUP BY q.query_id)"


@query(f"WITH {HITS}, {TITLES} SELECT query_id, titles FROM ti")
def source_titles(spark: SparkSession, folder: str) -> DataFrame:
    asked = _questions(spark, folder)
    return prompts.source_titles(asked, _hits(spark, folder, asked))


@query(f"WITH {HITS}, {TITLES} SELECT query_id, query || CASE WHEN len(titles) > 0 THEN chr(10) || chr(10) || '**[출처]**' || chr(10) || array_to_string(list_transform(titles, lambda t: '- ' || t), chr(10)) ELSE '' END AS answer FROM ti JOIN q USING (query_id)")
def source_footer(spark: SparkSession, folder: str) -> DataFrame:
    asked = _questions(spark, folder)
    titled = prompts.source_titles(asked, _hits(spark, folder, asked)).join(asked, "query_id")
    return titled.select("query_id", prompts.with_footer(F.col("query"), F.col("titles")).alias("answer"))


LAST = "SELECT conv_id AS query_id, arg_max(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id"


@query(f"""WITH {CHUNKS}, {_index_sql("c")}, {_scores_sql(LAST)}, hit AS (SELECT bm.query_id, bm25_rank AS fused_rank, coalesce(c.document, '') AS document FROM bm LEFT JOIN c USING (chunk_id) WHERE bm25_rank <= 3), {CONTEXT}, {HISTORIES},
  la AS (SELECT conv_id, arg_max(history, turn) AS history FROM h WHERE role = 'user' GROUP BY conv_id)
SELECT query_id, (len(history) + 2)::int AS n_messages, array_to_string(list_transform(history, lambda m: m.role || ': ' || m.content), chr(10)) AS history, '[참고 문서]' || chr(10) || context || chr(10) || chr(10) || '[질문]' || chr(10) || query AS prompt FROM q JOIN ctx USING (query_id) JOIN la ON conv_id = query_id""")
def build_prompts(spark: SparkSession, folder: str) -> DataFrame:
    talks = _read(spark, folder, "conversations")
    asked = talks.where("role = 'user'").groupBy(F.col("conv_id").alias("query_id")).agg(F.max_by("text", "turn").alias("query"))
    made = jobs.build_prompts(talks, _hits(spark, folder, asked))
    between = F.slice("messages", 2, F.size("messages") - 2)
    return made.select("query_id", F.size("messages").alias("n_messages"), F.array_join(F.transform(between, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("history"), F.element_at("messages", -1)["content"].alias("prompt"))
