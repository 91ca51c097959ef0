"""Finding what an incoming document would replace, and bringing pages up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CREATED_TAGS, merged_tags
from ..sources.shared import merged, written
from .vectors import nearest_within

THRESHOLD, NEIGHBOURS = 0.2, 3
#: Ranges of keys that are numbered apart.
RANGES = 64


def similarity(distance: Column) -> Column:
    """What is shown of a distance."""
    return F.greatest(F.lit(0.0), 1 - distance)


def exact_paths(docs: DataFrame, pages: DataFrame, locale: str = "ko") -> DataFrame:
    """docs(doc_id, path, ...) with `existing_id` and `is_existing`; a page with id 0 is as absent."""
    known = pages.where((F.col("locale") == locale) & F.col("page_id").isNotNull() & (F.col("page_id") != 0)).groupBy("path").agg(F.min("page_id").alias("existing_id"))
    return docs.join(known, "path", "left").withColumn("is_existing", F.col("existing_id").isNotNull())


def similar_titles(docs: DataFrame, chunks: DataFrame, threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, path, title, distance, place): of the nearest chunks of each document's `embedding` those within the threshold, the first of each path."""
    near = nearest_within(chunks, docs.select(F.col("doc_id").alias("query_id"), "embedding"), threshold, neighbours)
    named = near.join(chunks.select("chunk_id", "title", "path"), "chunk_id").where("path is not null")
    first = Window.partitionBy("query_id", "path").orderBy("vec_rank")
    kept = named.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    place = Window.partitionBy("query_id").orderBy("vec_rank")
    return kept.select(F.col("query_id").alias("doc_id"), "path", "title", "distance", F.row_number().over(place).alias("place"))


def plan(docs: DataFrame, pages: DataFrame, chunks: DataFrame, policy: str = "overwrite", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, action, path, page_id, title) for docs(doc_id, path, title, embedding).

    An exact path, or else the most similar title's path, is a candidate. With
    policy "overwrite" a candidate is updated under the document's own title;
    with "create" a page is made at the document's own path. An update whose path
    no page has is an "error".
    """
    if policy == "create":  # nothing that exists matters
        return docs.select("doc_id", F.lit("create").alias("action"), "path", F.lit(None).cast("long").alias("page_id"), "title")
    exact = exact_paths(docs, pages).select("doc_id", "title", "path", "is_existing")
    best = similar_titles(docs, chunks, threshold).where("place = 1").select("doc_id", F.col("path").alias("similar_path"))
    joined = exact.join(best, "doc_id", "left").withColumn("candidate", F.when(F.col("is_existing"), F.col("path")).otherwise(F.col("similar_path")))
    update = F.col("candidate").isNotNull()
    chosen = joined.select("doc_id", "title", F.when(update, F.col("candidate")).otherwise(F.col("path")).alias("path"), update.alias("update"))
    found = exact_paths(chosen, pages)
    action = F.when(~F.col("update"), "create").when(F.col("is_existing"), "update").otherwise("error")
    return found.select("doc_id", action.alias("action"), "path", F.when(F.col("update"), F.col("existing_id")).alias("page_id"), "title")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """(key, number) of distinct whole-numbered keys, 1, 2, ... in their order, without bringing them together: they are dealt over ranges, numbered in each, and moved on by what the ranges before hold. Runs a Spark job for the bounds."""
    keys = df.select(key)
    bounds = keys.approxQuantile(key, [i / RANGES for i in range(1, RANGES)], 0.5 / RANGES)
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))).cast("array<double>"), lambda b: b <= F.col(key).cast("double")))
    dealt = keys.withColumn("part", part)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))  # RANGES rows at most
    own = dealt.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(key)))
    return own.join(F.broadcast(sums.select("part", "before")), "part").select(key, (F.col("before") + F.col("own")).alias("number"))


def changes(decisions: DataFrame, docs: DataFrame, pages: DataFrame, locale: str = "ko") -> DataFrame:
    """The pages (page_id, title, path, locale, tags, content) that the plan makes or brings up to date: updates replace title, path and content and merge tags, creates get new ids in the order of their documents. Of several documents for one page the greatest doc_id stays. Errors change nothing. The plan is worked out once and written to the shared folder (a Spark job), and joined without a broadcast."""
    work = decisions.where("action <> 'error'")
    last = Window.partitionBy("target").orderBy(F.col("doc_id").desc())
    target = F.when(F.col("action") == "update", F.concat(F.lit("id "), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("path "), F.col("path")))
    work = written(work.withColumn("target", target).withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("target", "nth"), "work")
    old = pages.select("page_id", F.col("tags").alias("old_tags"))
    updated = merged(old, work.where("action = 'update'"), "page_id").select("doc_id", "page_id", "title", "path", merged_tags(F.col("old_tags")).alias("tags"))
    most = pages.agg(F.coalesce(F.max("page_id"), F.lit(0)).alias("most"))  # one row
    created = work.where("action = 'create'")
    created = merged(created, numbered(created, "doc_id"), "doc_id").crossJoin(F.broadcast(most))
    created = created.select("doc_id", (F.col("most") + F.col("number")).cast("long").alias("page_id"), "title", "path", F.array(*map(F.lit, CREATED_TAGS)).alias("tags"))
    rows = updated.unionByName(created).join(docs.select("doc_id", F.col("markdown").alias("content")), "doc_id")
    return rows.select("page_id", "title", "path", F.lit(locale).alias("locale"), "tags", "content")


def upserted(pages: DataFrame, changed: DataFrame) -> DataFrame:
    """The page table with these pages instead of what it had of them."""
    kept = pages.join(changed.select("page_id"), "page_id", "left_anti")
    return kept.select("page_id", "title", "path", "locale", "tags", "content").unionByName(changed)


def applied(decisions: DataFrame, docs: DataFrame, pages: DataFrame, locale: str = "ko") -> DataFrame:
    """The page table after the plan; the changed pages are written once (Spark jobs)."""
    return upserted(pages, written(changes(decisions, docs, pages, locale), "changed"))
