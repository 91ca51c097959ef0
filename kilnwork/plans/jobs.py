"""Indexing, searching and ingesting as jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.pagebreaks import merged_page_breaks
from ..functions.text import has_tag, page_path
from ..operators import chunks as chunking
from ..operators import fusion, ingest, keyword_index, prompts, sync, vectors
from ..sources.shared import written

Embed = Callable[[Column], Column]


def full_index(pages: DataFrame, bodies: DataFrame, stored: DataFrame, embed: Embed | None = None) -> DataFrame:
    """The chunk table after a batch: pages with the pdf tag keep their chunks, others are cleaned and cut anew, chunks of pages that are gone are dropped. An empty page list changes nothing. If the stored chunks have embeddings, so has the result; only texts that aren't stored go to the model."""
    _, others = sync.split_by_tag(pages)
    gone = sync.to_purge(others, sync.orphans(sync.existing_page_ids(stored), pages))
    new = _embedded(chunking.chunk_pages(chunking.cleaned(sync.with_bodies(others, bodies))), stored, embed)
    after = sync.purged(stored, gone).select(*new.columns).unionByName(new)
    return stored.select(*new.columns) if pages.isEmpty() else after


def _embedded(new: DataFrame, stored: DataFrame, embed: Embed | None) -> DataFrame:
    return vectors.embedded_once(new, stored, "document", embed) if "embedding" in stored.columns else new


def full_index_tables(pages: DataFrame, bodies: DataFrame, stored: DataFrame, embed: Embed | None = None) -> tuple[DataFrame, keyword_index.KeywordIndex]:
    """(chunk table with embeddings, keyword index) after a batch: `full_index`, written once to the shared folder (Spark jobs), and what is built from it."""
    after = written(full_index(pages, bodies, stored, embed), "chunks")
    return vectors.embedded(after, "chunk_id", "document", embed), keyword_index.stored(keyword_index.build(after))


def index_report(pages: DataFrame, stored: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the chunk table `after`, written to the shared folder, and one row of a report: pages, those to index anew, those with the pdf tag, orphans, chunks before and after). The chunks are counted while they are written; pages and stored chunks are each read once more. Runs Spark jobs when it is called."""
    spark, counted = after.sparkSession, Observation()
    table = written(after.observe(counted, F.count(F.lit(1)).alias("n")), "chunks")
    listed = pages.agg(F.count("*").alias("n_pages"), F.count_if(has_tag(F.col("tags"), "pdf")).alias("n_pdf"))
    known = pages.select("page_id", F.lit(True).alias("known")).distinct()
    held = stored.groupBy("page_id").agg(F.count("*").alias("n")).join(known, "page_id", "left")
    before = held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_before"), F.count_if(F.col("known").isNull() & F.col("page_id").isNotNull()).alias("n_orphans"))
    both = listed.crossJoin(F.broadcast(before))  # one row each
    return table, both.select("n_pages", (F.col("n_pages") - F.col("n_pdf")).alias("n_reindexed"), "n_pdf", "n_orphans", "n_before", F.lit(counted.get["n"]).alias("n_after"))


def page_report(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("page_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("document")).alias("n_chars"))


def hybrid_search(chunks: DataFrame, index: keyword_index.KeywordIndex | None, queries: DataFrame, top: int = 5, candidates: int = 20, embed: Embed | None = None, near: Callable[..., DataFrame] = vectors.nearest) -> DataFrame:
    """Fused hits with their chunks. Without an index only vectors are searched; without chunks there are no hits, whatever the index has. Stored embeddings are used. `near` finds the nearest vectors: exactly, or by cells (`vectors.nearest_probed`, with a kept tree by functools.partial)."""
    near = near(vectors.embedded(chunks, "chunk_id", "document", embed), vectors.embedded(queries, "query_id", "query", embed), candidates)
    words = near.where("false").select("query_id", "chunk_id", F.lit(1).alias("bm25_rank")) if index is None else keyword_index.search(index, queries, candidates)
    some = chunks.limit(1).agg(F.count("*").alias("some"))  # one row
    words = words.crossJoin(F.broadcast(some)).where("some > 0").drop("some")
    return fusion.hydrated(fusion.fused(near, words, top=top), chunks)


def replace_pages(chunks: DataFrame, index: keyword_index.KeywordIndex | None, pages: DataFrame, embed: Embed | None = None) -> tuple[DataFrame, keyword_index.KeywordIndex | None, DataFrame]:
    """(chunk table, patched index, chunks a page) after these pages' raw text has replaced what was stored of them. Chunks of other pages aren't tokenised again. If the chunks have embeddings, they keep them, and only texts that aren't stored go to the model (Spark jobs)."""
    cut = chunking.chunk_pages(pages)
    new = _embedded(cut, chunks, embed)
    after = chunking.replaced(chunks, pages, new)
    counts = pages.select("page_id").join(cut.groupBy("page_id").agg(F.count("*").alias("n_chunks")), "page_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    if index is not None:
        old = index.tokens.join(pages.select("page_id"), "page_id", "left_semi").select("chunk_id")
        index = keyword_index.patch_add(keyword_index.patch_remove(index, old), cut)
    return after, index, counts


def build_prompts(messages: DataFrame, hits: DataFrame, **request) -> DataFrame:
    """(query_id, messages, payload) for the last user message of each conversation (query_id is its conv_id)."""
    told = prompts.histories(messages)
    last = told.where("role = 'user'").groupBy("conv_id").agg(F.max_by(F.struct("text", "history"), "turn").alias("last"))
    asked = last.select(F.col("conv_id").alias("query_id"), "last.text", "last.history")
    return prompts.requests(asked.join(prompts.contexts(asked, hits), "query_id"), **request)


def plan_ingest(docs: DataFrame, pages: DataFrame, chunks: DataFrame, policy: str = "overwrite") -> DataFrame:
    """The plan for docs(doc_id, path, title, embedding) as they are; `prepared` gives documents their path and undoes page breaks."""
    return ingest.plan(docs, pages, chunks, policy)


def prepared(docs: DataFrame) -> DataFrame:
    """docs(doc_id, department, title, markdown) ready for a plan: page breaks undone, with `path`, and the title's `embedding` unless there is one."""
    text = docs.withColumn("markdown", merged_page_breaks(F.col("markdown"))).withColumn("path", page_path(F.col("department"), F.col("title")))
    return vectors.embedded(text, "doc_id", "title")


def apply_ingest(decisions: DataFrame, docs: DataFrame, pages: DataFrame, chunks: DataFrame, index: keyword_index.KeywordIndex | None = None, embed: Embed | None = None) -> tuple[DataFrame, DataFrame, keyword_index.KeywordIndex | None, DataFrame]:
    """(page table, chunk table, index, chunks a page) after the plan: the changed pages are written (a Spark job), put into the page table, and replace their chunks and index entries."""
    changed = written(ingest.changes(decisions, docs, pages), "changed")
    return ingest.upserted(pages, changed), *replace_pages(chunks, index, changed, embed)
