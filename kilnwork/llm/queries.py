"""The queries of this subpackage: each operator over its whole table, with production parameters, and SQL for those that have it."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexical, license_scan, lz_dedup, media, ngram_join, packing, pii, quality_classifier, quality_rules, repair, sentencepiece, sharding, suffix_dedup
from .common import written


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_table(spark, folder, "documents"), _tokenizer("byte_bpe_50k.json"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.repetition_coverage(_table(spark, folder, "documents"))


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pseudonymised(_table(spark, folder, "documents"), b"a key for the query alone")


def op5_media(spark: SparkSession, folder: str) -> DataFrame:
    """Noisy excerpts of every fiftieth recording, aligned with all recordings; the recordings are made from the vectors.

    Rows of the kind "match" are pairs of classes of equal fingerprints. Those of the
    kinds "recording" and "excerpt" are membership, a row for each: its id, and as
    `match` or `query` the class that it is in (null without a fingerprint).
    """
    vectors = _table(spark, folder, "embeddings")
    stored = media.fingerprints(media.melodies(vectors, "vec_id", "embedding"), "vec_id", "samples")
    asked = media.fingerprints(media.melodies(vectors.where(F.col("vec_id") % 50 == 0), "vec_id", "embedding", excerpt=True), "vec_id", "samples")
    stored, asked = written(stored, "stored"), written(asked, "asked")
    pairs = media.aligned(stored, asked, "vec_id").withColumn("kind", F.lit("match"))
    for kind, prints, name in (("recording", stored, "match"), ("excerpt", asked, "query")):
        pairs = pairs.unionByName(media.members(prints, "vec_id").withColumnRenamed("name", name).withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    return pairs


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, folder, "documents"))


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, folder, "documents"))


def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece.encoded(_table(spark, folder, "documents"), _tokenizer("piece_bpe_32k.model"))


def op9_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, folder, "documents")).drop("tag", "worded")


def op10_lz_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lz_dedup.lz_dedup(_table(spark, folder, "documents"))


def op11_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.report(repair.damaged(_table(spark, folder, "conversations")))


def op12_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op13_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(_table(spark, folder, "documents")).drop("text")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_quality_rules, op3_quality_classifier, op4_pii, op5_media, op6_suffix_dedup, op7_license_scan, op8_sentencepiece, op9_ngram_join, op10_lz_dedup, op11_repair, op12_lexical, op13_sharding, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op6_suffix_dedup": OP6_SQL, "op9_ngram_join": OP9_SQL, "op10_lz_dedup": OP10_SQL, "op12_lexical": OP12_SQL}


def _op2_sql() -> str:
    space = r"[\x20\x09-\x0D]+"
    grams = "".join(
        f""",
  g{k} AS (SELECT doc_id, i, {"count(*)" if k == 3 else "row_number()"} OVER (PARTITION BY doc_id, array_to_string(w[i:i + {k - 1}], ' '){"" if k == 3 else " ORDER BY i"}) > 1 AS dup
           FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM words)),
  c{k} AS (SELECT doc_id, count(*) AS n, sum(length(w[j])) AS chars
           FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {k})) AS j FROM g{k} WHERE dup) JOIN words USING (doc_id) GROUP BY doc_id)"""
        for k in (3, *quality_rules.NGRAM_LIMITS)
    )
    dups = ", ".join(f"coalesce(c{k}.chars, 0)::bigint AS dup_chars_{k}" for k in quality_rules.NGRAM_LIMITS)
    joins = " ".join(f"LEFT JOIN c{k} USING (doc_id)" for k in (3, *quality_rules.NGRAM_LIMITS))
    within = " AND ".join(f"100 * dup_chars_{k} <= {v} * word_chars" for k, v in quality_rules.NGRAM_LIMITS.items())
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  words AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(text, '{space}'), lambda x: x <> '') AS w FROM d),
  l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) > 1 AS seen
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
  ll AS (SELECT doc_id, count(*) FILTER (seen) AS n, sum(length(line)) FILTER (seen) AS chars FROM l GROUP BY doc_id){grams},
  m AS (SELECT doc_id, len(w)::bigint AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars,
               length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, coalesce(ll.n, 0)::bigint AS n_dup_lines,
               coalesce(c3.n, 0)::bigint AS n_repeat_words, length(text)::bigint AS n_chars, coalesce(ll.chars, 0)::bigint AS dup_line_chars, {dups}
        FROM d JOIN words USING (doc_id) LEFT JOIN ll USING (doc_id) {joins}),
  b AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.WINDOW_LIMIT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {quality_rules.LINE_LIMIT} * n_chars AND {within} AS kept FROM b"""


OP2_SQL = _op2_sql()


OP6_SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * suffix_dedup.WIDTH})) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {suffix_dedup.WIDTH - 1})) AS i FROM d)),
  g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) > 1 AS gone FROM w),
  r AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > {suffix_dedup.WIDTH}, true) AS fresh FROM g WHERE gone),
  s AS (SELECT doc_id, min(i) AS a, max(i) + {suffix_dedup.WIDTH} AS b FROM (SELECT doc_id, i, sum(fresh::int) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r) GROUP BY doc_id, run),
  k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
  t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""

OP10_SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY md5(array_to_string(w[i:i + {lz_dedup.WIDTH - 1}], ' '))) > 1 AS twice FROM (SELECT doc_id, w, unnest(range(1, len(w) - {lz_dedup.WIDTH - 2})) AS i FROM d)),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {lz_dedup.WIDTH})) AS j FROM g WHERE twice),
  words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
  k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS kept FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""



def _terms_sql(c: str) -> str:
    return f"regexp_extract_all(translate(coalesce({c}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


OP12_SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_terms_sql("text")} AS w FROM documents),
  n AS MATERIALIZED (SELECT r, doc_id, len(w)::bigint AS n FROM d WHERE len(w) > 0), s AS (SELECT count(*) AS docs, sum(n)::bigint AS words FROM n),
  i AS MATERIALIZED (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_terms_sql("text")}) AS t FROM benchmark)),
  p AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY r, t),
  f AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint AS weight FROM p, s GROUP BY t, docs),
  c AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words))))::bigint AS score FROM i JOIN f USING (t) JOIN p USING (t) JOIN n USING (r), s GROUP BY item_id, doc_id, r)
SELECT item_id, rank::int AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM c WHERE score > 0) WHERE rank <= {lexical.TOP}"""

OP9_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {ngram_join.SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {ngram_join.SHINGLE - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
  k AS MATERIALIZED (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k, count(*) AS n FROM g GROUP BY doc_id),
  node AS MATERIALIZED (SELECT k, min(doc_id) AS node, any_value(n) AS n FROM k GROUP BY k),
  s AS MATERIALIZED (SELECT node, n, g FROM node JOIN g ON doc_id = node),
  l AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM s a JOIN s b ON a.g = b.g AND a.node < b.node GROUP BY a.node, b.node, a.n, b.n HAVING 10 * count(*) >= {round(10 * ngram_join.THRESHOLD)} * (a.n + b.n - count(*))),
  e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT node, node AS reached FROM node UNION SELECT r.node, e.b FROM r JOIN e ON reached = e.a),
  c AS (SELECT node, min(reached) AS class_id FROM r GROUP BY node),
  n AS (SELECT a AS node, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, coalesce(node, doc_id) AS copy_of, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0)::bigint AS n_links
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN node USING (k) LEFT JOIN c USING (node) LEFT JOIN n USING (node)"""
