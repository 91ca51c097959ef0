"""Ranked lexical search of many items in all documents, by masks of matched terms.

A block of documents holds its terms as bitmaps. For an item, the bitmaps of its
terms give each document's mask of matched terms; documents with one mask form a
group, and a group's score can't exceed what its terms can give in this block at
most. Groups are scored from the highest such bound down, and when the next bound is
under the score of the last wanted rank, the item is finished in this block. All
arithmetic is on whole numbers, so the order of sums doesn't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, BYTE_CODES, Rolling, require, text_blocks, word_bounds, written

TOP = 10
#: Items whose terms are looked for in one pass over the documents, about, and the bytes of their texts.
GROUP_ITEMS, GROUP_BYTES = 1000, 8 << 20
#: Documents and term entries of a block.
BLOCK_DOCS, BLOCK_ENTRIES = 8192, 4 << 20
#: Documents of an item that are scored at first; then twice as many at each step.
FIRST = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, row) of each term, in order. Equal hashes are taken for equal terms."""
    data = _LOWER[data]
    starts, ends, of = word_bounds(data, offsets, ALNUM)
    return Rolling(BYTE_CODES[data]).hash(starts, ends), of


def _grouped(items: DataFrame, item: str, text: str) -> list[DataFrame]:
    """The items in groups of a bounded size, by a hash of their ids."""
    sums = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    n = max(1, -(-sums[0] // GROUP_ITEMS), -(-sums[1] // GROUP_BYTES))
    return [items.where(F.pmod(F.xxhash64(item), F.lit(n)) == i) for i in range(n)]


def _vocabulary(texts: pa.ChunkedArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sorted hashes, each item's places in them)."""
    own: list[np.ndarray] = []
    for _, n, data, offsets in text_blocks(texts):
        terms, of = _terms(data, offsets)
        own += [np.unique(terms[of == i]) for i in range(n)]
    words = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]))
    return words, [np.searchsorted(words, x) for x in own]


def _bags(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Blocks of documents that have terms: ids, n (all terms of each), and entries (row in the block, term's place in the vocabulary, how often)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        entries: list[np.ndarray] = []
        rows = 0

        def block() -> pa.RecordBatch:
            id_ = pa.concat_arrays(ids)
            n, entry = np.concatenate(lengths), np.concatenate(entries, axis=1)
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(id_)], pa.int32()), id_), *(pa.array([x.tobytes()], pa.binary()) for x in (n, *entry))], ["ids", "n", "row", "term", "tf"])

        for batch in batches:
            for first, count, data, offsets in text_blocks(batch.column(1)):
                terms, of = _terms(data, offsets)
                n = np.bincount(of, minlength=count).astype(np.int64)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                place = np.searchsorted(vocabulary, terms)
                place[place == len(vocabulary)] = 0
                known = vocabulary[place] == terms if len(vocabulary) else np.zeros(len(terms), bool)
                pair, tf = np.unique(of[known] * max(1, len(vocabulary)) + place[known], return_counts=True)
                row, term = np.divmod(pair, max(1, len(vocabulary)))
                new = np.zeros(count, np.int64)
                new[some] = np.arange(len(some))
                ids.append(batch.column(0).slice(first, count).take(pa.array(some)))
                lengths.append(n[some])
                entries.append(np.stack([new[row] + rows, term, tf]).astype(np.int32))
                rows += len(some)
                if rows >= BLOCK_DOCS or sum(e.shape[1] for e in entries) >= BLOCK_ENTRIES:
                    yield block()
                    ids, lengths, entries, rows = [], [], [], 0
        if rows:
            yield block()

    return docs.mapInArrow(run, "ids array<long>, n binary, row binary, term binary, tf binary")


def _sums(bags: DataFrame) -> tuple[int, int, dict[int, int]]:
    """(documents with terms, all their terms, documents of each term of the vocabulary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, df = 0, 0, np.zeros(0, np.int64)
        for batch in batches:
            for n, term in zip(batch.column(0), batch.column(1)):
                n = np.frombuffer(n.as_buffer(), np.int64)
                count, total = count + len(n), total + int(n.sum())
                found = np.bincount(np.frombuffer(term.as_buffer(), np.int32), minlength=len(df))
                found[: len(df)] += df
                df = found
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[count, total], df[some]]))], ["what", "n"])

    sums = {r[0]: r[1] for r in bags.select("n", "term").mapInArrow(run, "what long, n long").groupBy("what").agg(F.sum("n")).collect()}
    return sums.pop(-2, 0), sums.pop(-1, 0), sums


class Block:
    """A block's documents: who has a term, and what the term gives there before its weight."""

    def __init__(self, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, documents: int, words: int, vocabulary: int):
        if 90 * int(n.max(initial=0)) * documents < 1 << 62:
            m = 10 + 90 * n * documents // words
        else:
            m = np.array([10 + 90 * int(x) * documents // words for x in n])
        tf = tf.astype(np.int64)
        self.n, self.row, self.term = len(n), row, term
        self.gives = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
        self.first = np.searchsorted(row, np.arange(len(n) + 1))  # entries go by row
        by_term = np.argsort(term, kind="stable")
        self.documents = row[by_term]
        self.bounds = np.searchsorted(term[by_term], np.arange(vocabulary + 1))
        self.most = np.zeros(vocabulary, np.int64)
        np.maximum.at(self.most, term, self.gives)
        self.weights = np.zeros(vocabulary, np.int64)

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents with any of these terms, the distinct masks in words of 64 terms, each document's mask)."""
        bitmaps = np.zeros((-(-max(1, len(terms)) // 64) * 64, -(-self.n // 8)), np.uint8)
        for i, t in enumerate(terms):
            documents = self.documents[self.bounds[t] : self.bounds[t + 1]]
            np.bitwise_or.at(bitmaps[i], documents >> 3, 128 >> (documents & 7))
        some = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bitmaps, axis=0), count=self.n))
        words = np.empty((len(some), len(bitmaps) // 64), np.uint64)
        for k in range(words.shape[1]):  # 64 terms at a time, turned from a row a term to a row a document
            bits = np.unpackbits(bitmaps[64 * k : 64 * k + 64], axis=1, count=self.n)[:, some]
            words[:, k] = np.ascontiguousarray(np.packbits(bits, axis=0).T).view(np.uint64)[:, 0]
        order = np.lexsort(words.T)
        changed = np.ones(len(some), bool)
        changed[1:] = (words[order][1:] != words[order][:-1]).any(axis=1)
        of = np.empty(len(some), np.int64)
        of[order] = np.cumsum(changed) - 1
        return some, words[order][changed], of

    def bounds_of(self, masks: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The most that a document with the mask can score, if the mask's terms give `most`. These are whole numbers under 2**53, so floats are exact."""
        out = np.zeros(len(masks))
        for k in range(masks.shape[1]):
            own = most[64 * k : 64 * k + 64].astype(np.float64)
            out += np.unpackbits(np.ascontiguousarray(masks[:, k : k + 1]).view(np.uint8), axis=1, count=len(own)) @ own
        return out.astype(np.int64)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The sums of what the weighted terms give to these documents."""
        sizes = self.first[rows + 1] - self.first[rows]
        ends = np.cumsum(sizes)
        entry = np.arange(ends[-1]) + np.repeat(self.first[rows] - (ends - sizes), sizes)
        sums = np.concatenate([[0], np.cumsum(self.weights[self.term[entry]] * self.gives[entry])])
        return sums[ends] - sums[ends - sizes]

    def best(self, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores, documents scored) of the `top` highest scores over 0, equal ones by id."""
        rows, masks, of = self.masks(terms)
        none = np.zeros(0, np.int64)
        if not len(rows):
            return none, none, 0
        bound = self.bounds_of(masks, weights * self.most[terms])
        by_bound = np.argsort(-bound[of], kind="stable")
        rows, bound = rows[by_bound], bound[of][by_bound]
        self.weights[terms] = weights
        best, scores, done, step = none, none, 0, FIRST
        while done < len(rows) and bound[done] > 0 and (len(best) < top or bound[done] >= scores[-1]):
            new = rows[done : done + step]
            best, scores = np.concatenate([best, new]), np.concatenate([scores, self.score(new)])
            order = np.lexsort((ids[best], -scores))[:top]
            order = order[scores[order] > 0]
            best, scores = best[order], scores[order]
            done, step = done + len(new), 2 * step
        self.weights[terms] = 0
        return best, scores, done


def _ranked(bags: DataFrame, items: list[tuple[object, np.ndarray]], weights: np.ndarray, documents: int, words: int, top: int) -> DataFrame:
    """(place of the item, doc, score): the best of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids = batch.column(0)[i].values
                n, row, term, tf = (np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in ((1, np.int64), (2, np.int32), (3, np.int32), (4, np.int32)))
                block = Block(n, row, term, tf, documents, words, len(weights))
                least = np.iinfo(np.int64).min
                order = ids.fill_null(least).to_numpy(zero_copy_only=False)
                for place, (_, terms) in enumerate(items):
                    best, scores, _ = block.best(terms, weights[terms], order, top)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), place, np.int32)), ids.take(pa.array(best)), pa.array(scores)], ["place", "doc", "score"])

    return bags.mapInArrow(run, "place int, doc long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text") -> DataFrame:
    """(item, rank, key, score): each item's `top` documents of the highest scores over 0, equal scores by ascending key.

    Terms, weights and scores are whole numbers as the module says; sums over all
    documents. A null text has no terms; an item without terms that any document has
    gets no rows; rows with equal or null ids are documents (items) of their own, a null
    key being the least, and equal rows rank side by side in any order; a text of any
    length is taken whole; of an empty table, no rows; other columns don't matter.
    Items are taken in groups (some 1,000 each) and each group in one pass over the
    documents, so what tasks hold of the items is bounded. Runs Spark jobs when it
    is called, and writes blocks of term counts to the shared folder.
    """
    docs, items = require(docs, key, text), require(items, item, query)
    parts = []
    for group in _grouped(items, item, query):
        asked = group.toArrow()  # bounded, see GROUP_ITEMS and GROUP_BYTES
        vocabulary, terms = _vocabulary(asked.column(1))
        bags = written(_bags(docs.select(F.col(key).cast("long"), F.col(text)), vocabulary), "bags")
        documents, words, frequencies = _sums(bags)
        df = np.array([frequencies.get(i, 0) for i in range(len(vocabulary))], np.int64)
        weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
        names = asked.column(0).to_pylist()
        found = _ranked(bags, [(n, t[df[t] > 0]) for n, t in zip(names, terms)], weights, documents, words, top)
        best = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_first())
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        named = docs.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], f"place int, name {items.schema[item].dataType.simpleString()}")
        parts.append(found.join(F.broadcast(named), "place").select(F.col("name").alias(item), "rank", F.col("doc").alias(key), "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
