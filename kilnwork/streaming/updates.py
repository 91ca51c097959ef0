"""Pages that keep coming, put into the chunk store batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import keyword_index, vectors
from ..operators.chunks import chunk_pages, cleaned
from ..sources.shared import written
from ..sources.store import BUCKETS, Version, bucket, by_pages, commit, current, new_name, replace_buckets

#: Versions that stay, so that readers of the one before the current one can end.
KEPT = 2
_CHUNKS = "chunk_id string, page_id long, chunk_index int, title string, path string, document string"


def _picked(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """Each page once, with its greatest content; only rows of the repeated pages, and of those without an id, are shuffled."""
    many = by_pages(pages, repeated, "left_semi").unionByName(pages.where("page_id is null"))
    picked = many.groupBy("page_id").agg(F.max(F.struct("content", "title", "path")).alias("page")).select("page_id", "page.title", "page.path", "page.content")
    return by_pages(pages.where("page_id is not null"), repeated, "left_anti").unionByName(picked)


def into_store(path: str, clean: bool = False, keep: int = KEPT, buckets: int = BUCKETS, stream: str | None = None, index: bool = False, embed: Callable[[Column], Column] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for writeStream.foreachBatch: each batch of pages (page_id, title, path, content) replaces what the store has of them, as a new version.

    Chunks lie in buckets by page, and only the buckets of the batch's pages are written
    again. With `embed` chunks keep embeddings, of which only unseen texts' are made; with
    `index` the keyword index gets a segment (`keyword_index.opened` reads it). All
    of a batch is one version: after a failure the store is as it was before.
    Of a page's rows in one batch the one with the greatest content counts (then
    title, then path), so a batch that comes again gives the same chunks. With `stream`
    (a name that stays when the stream is started again) the version tells its batch, and
    a number that it has already changes nothing. A store that can't be read stops the
    stream (DamagedStore), as does another writer (StaleStore); it isn't begun anew.
    `buckets` holds for a new store; one that exists keeps its own.
    """

    def batch(pages: DataFrame, number: int) -> None:
        spark = pages.sparkSession
        version, name = current(spark, path), new_name()
        notes = {} if version is None else version.notes
        if stream is not None and notes.get("streams", {}).get(stream, -1) >= number:
            return
        many = notes.get("buckets", buckets)
        table = None if version is None else version.tables["chunks"]
        pages = written(pages.select("page_id", "title", "path", "content"), "batch")
        counted = written(pages.groupBy("page_id").agg(F.count("*").alias("n")), "ids")
        ids, repeated = counted.select("page_id"), counted.where("n > 1").select("page_id")
        if not repeated.isEmpty():
            pages = written(_picked(pages, repeated), "picked")
        of = {r[0] for r in ids.select(bucket(F.col("page_id"), many)).distinct().collect()}  # as many as there are buckets at most
        if table is None:
            stored = spark.createDataFrame([], _CHUNKS + (", embedding array<double>" if embed else ""))
        else:
            stored = table.read(spark, path, [f for f in table.files if int(f.split("/")[-2].removeprefix("bucket=")) in of])
        cut = chunk_pages(cleaned(pages) if clean else pages)
        new = vectors.embedded_once(cut, stored, "document", embed) if "embedding" in stored.columns else cut
        kept = by_pages(stored, ids, "left_anti").select(*new.columns)
        tables = {"chunks": replace_buckets(spark, path, version, name, "chunks", of, kept, new, many)}
        if index:
            gone = by_pages(stored, ids, "left_semi").select("chunk_id")
            tables |= keyword_index.patch_segment(spark, path, version, name, cut, gone)
        told = {"buckets": many, "streams": notes.get("streams", {}) | ({stream: number} if stream is not None else {})}
        commit(spark, path, Version(name, version and version.name, tables, told), keep)

    return batch
