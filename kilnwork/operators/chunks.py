"""Chunks of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MIN_CLEAN, OVERLAP, SIZE, chunk_text, clean_markdown


def chunk_id(page_id: Column, index: Column) -> Column:
    return F.concat(F.lit("page_"), page_id.cast("string"), F.lit("_chunk_"), index.cast("string"))


def chunk_pages(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, page_id, chunk_index, title, path, document) of pages with `content`."""
    rows = pages.select("page_id", "title", "path", F.posexplode(chunk_text(F.col("content"), size, overlap)).alias("chunk_index", "document"))
    return rows.select(chunk_id(F.col("page_id"), F.col("chunk_index")).alias("chunk_id"), "page_id", "chunk_index", "title", "path", "document")


def cleaned(pages: DataFrame, least: int = MIN_CLEAN) -> DataFrame:
    """Pages with some content, cleaned; those that are too short then are dropped. Exploding a list of one keeps the optimiser from cleaning once for the filter and again for the result."""
    long = F.filter(F.array(clean_markdown(F.col("content"))), lambda c: F.length(c) >= least)
    return pages.where(F.length("content") > 0).select(*[c for c in pages.columns if c != "content"], F.explode(long).alias("content"))


def of_pages(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """The chunks of these pages (page_id), by the prefix of their ids."""
    prefix = F.regexp_extract("chunk_id", "^page_-?[0-9]+_chunk_", 0)
    wanted = pages.select(F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit("_chunk_")).alias("prefix")).distinct()
    return chunks.withColumn("prefix", prefix).join(wanted, "prefix", "left_semi").drop("prefix")


def replaced(chunks: DataFrame, pages: DataFrame, new: DataFrame) -> DataFrame:
    """The chunk table with these new chunks of pages instead of what it had of them."""
    return chunks.join(pages.select("page_id").distinct(), "page_id", "left_anti").select(*new.columns).unionByName(new)
