"""Keeping stored chunks in step with the wiki."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_tag


def split_by_tag(pages: DataFrame, tag: str = "pdf") -> tuple[DataFrame, DataFrame]:
    """(pages with the tag, pages without); null tags are none."""
    tagged = has_tag(F.col("tags"), tag)
    return pages.where(tagged), pages.where(~tagged)


def with_bodies(pages: DataFrame, bodies: DataFrame) -> DataFrame:
    """Pages with their `content`; a missing one is empty."""
    return pages.join(bodies.select("page_id", "content"), "page_id", "left").withColumn("content", F.coalesce("content", F.lit("")))


def existing_page_ids(chunks: DataFrame) -> DataFrame:
    return chunks.where("page_id is not null").select("page_id").distinct()


def orphans(existing: DataFrame, wiki: DataFrame) -> DataFrame:
    """Stored page ids that the wiki no longer has."""
    return existing.join(wiki.select("page_id"), "page_id", "left_anti")


def orphans_as_set(existing: DataFrame, wiki: DataFrame) -> DataFrame:
    return existing.select("page_id").subtract(wiki.select("page_id"))


def to_purge(reindexed: DataFrame, orphaned: DataFrame) -> DataFrame:
    return reindexed.select("page_id").union(orphaned.select("page_id")).distinct()


def purged(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks without those of the ids; chunks without a page id stay."""
    return chunks.join(ids.select("page_id"), "page_id", "left_anti")
