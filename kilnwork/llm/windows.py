"""Repeated windows: which stretches of `width` consecutive symbols (bytes or words) occur elsewhere in the corpus.

Every window has an anchor: of its `gram`-symbol grams the one with the least
hash, the leftmost of equals; grams that are frequent in the corpus come after
all others. Equal windows have equal anchors at the same distance, so it suffices
to compare windows that share an anchor; a document yields about 2 anchors to
(width - gram) symbols, not one row a position.

0. Grams are counted in all texts. Which are frequent is told by a share of all
   grams, so their list has a bound that doesn't grow with the corpus. A passage
   that many documents share is thus compared by the text beside it where a window
   holds any, and its own windows are equal contexts, merged as below; the many
   contexts of a frequent gram don't meet in one task.
1. Each task lists its documents' anchors: the gram's hash, the run of windows
   that have it, and a hash of the whole stretch under those windows (the
   context). Equal contexts within a batch are merged before anything is shuffled.
2. Spark partitions the anchors by hash. Equal contexts settle their windows at
   once. Only where one anchor has several contexts, a representative of each is
   looked at more closely.
3. The representatives' symbols are fetched from the documents, and the contexts
   of an anchor are compared with each other by the operator's own method.
4. An anchor with more than `giant` contexts isn't held in one task: its windows
   are split by their distance to the anchor, a few distances at a time, and by all the
   symbols that such windows have in common, a longer gram around the anchor. The
   parts go the same way (steps 2 and 3).

Nothing is capped, and no task holds more than `giant` contexts of an anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTE_CODES, SPACED, U64, Rolling, mix, text_blocks, word_bounds, written

#: Contexts of one anchor that a task compares; beyond them they are split, by so many distances to the anchor at first, then by each.
GIANT, SPLITS = 20_000, (8, 1)
#: Contexts that a task compares at a time, whole anchors.
COMPARED = 32_768
#: Symbols of one document that are looked at at a time.
STRETCH = 1 << 24
#: Bytes of text whose grams are counted together, and occurrences there from which a gram's count goes on.
COUNTED, SEEN = 1 << 20, 4
#: A gram is frequent if it is more than one in so many of all grams (so no more than that many are), and if there are RARE of it.
SHARE, RARE = 1 << 18, 256
_PLACE = U64((1 << 28) - 1)
_LAST = U64(1 << 63)


@dataclass(frozen=True)
class Grain:
    """What windows consist of: bytes, or words as 64-bit hashes; windows of `width`, anchors of `gram` symbols."""

    words: bool
    width: int
    gram: int

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block's symbols, and where each document's begin."""
        if not self.words:
            return BYTE_CODES[data], offsets
        starts, ends, of = word_bounds(data, offsets, SPACED)
        return Rolling(BYTE_CODES[data]).hash(starts, ends), np.searchsorted(of, np.arange(len(offsets)))


def _sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // size) * size, np.iinfo(np.uint64).max, U64)
    padded[:n] = values
    rows = padded.reshape(-1, size)
    up = np.minimum.accumulate(rows, axis=1).ravel()
    down = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[: n - size + 1], up[size - 1 : n])


class Frequent:
    """A sorted list of hashes, and whether others are in it."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.marks = np.zeros(1 << 22, bool)
        self.marks[hashes >> U64(42)] = True

    def among(self, values: np.ndarray) -> np.ndarray:
        """Places of the values that are in the list."""
        if not len(self.hashes):
            return np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.marks[values >> U64(42)])
        found = np.minimum(np.searchsorted(self.hashes, values[maybe]), len(self.hashes) - 1)
        return maybe[self.hashes[found] == values[maybe]]


_NONE = Frequent(np.zeros(0, U64))


def anchors(symbols: np.ndarray, offsets: np.ndarray, grain: Grain, frequent: Frequent = _NONE) -> tuple[np.ndarray, ...]:
    """For each anchor of the block's documents: document, hash, context's hash, first window, windows, anchor less first window (places within the document)."""
    width, gram, n = grain.width, grain.gram, len(symbols)
    if n < width:
        return tuple(np.zeros(0, t) for t in (np.int64, U64, U64, np.int64, np.int64, np.int64))
    rolling = Rolling(symbols)
    at = np.arange(n - gram + 1)
    grams = rolling.hash(at, at + gram)
    rank = grams >> U64(1)
    rank[frequent.among(grams)] |= _LAST
    least = _sliding_least((rank & ~_PLACE) | at.astype(U64), width - gram + 1) & _PLACE
    whole = np.ones(n - width + 1, bool)
    steps = np.zeros(n + 2, np.int32)  # windows across a document's end
    ends = offsets[1:-1]
    np.add.at(steps, np.maximum(ends - width + 1, 0), 1)
    np.add.at(steps, ends, -1)
    whole &= np.cumsum(steps)[: len(whole)] == 0
    windows = np.flatnonzero(whole)
    if not len(windows):
        return anchors(symbols[:0], offsets, grain)
    place = least[windows].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(windows)]]) - 1
    lo, hi, place = windows[first], windows[last], place[first]
    context = mix(rolling.hash(lo, hi + width) ^ mix(((place - lo) * 65536 + (hi - lo)).astype(U64) + U64(7)))
    of = np.searchsorted(offsets, lo, "right") - 1
    return of, grams[place], context, lo - offsets[of], hi - lo + 1, place - lo


def _stretches(symbols: np.ndarray, offsets: np.ndarray, grain: Grain) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A very long document in overlapping stretches, other blocks as they are: (document, place of the first symbol, symbols, offsets)."""
    if len(offsets) == 2 and len(symbols) > STRETCH:
        for start in range(0, len(symbols) - grain.width + 1, STRETCH):
            part = symbols[start : start + STRETCH + grain.width - 1]
            yield 0, start, part, np.array([0, len(part)])
    else:
        yield 0, 0, symbols, offsets


def _counted(grain: Grain) -> Callable:
    """(gram, n) of grams that come SEEN times or more in a block, and the number of all grams (gram null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0), COUNTED):
                for _, _, symbols, _ in _stretches(*grain.symbols(data, offsets), grain):
                    rolling, grams = Rolling(symbols), np.empty(max(0, len(symbols) - grain.gram + 1), U64)
                    for i in range(0, len(grams), 1 << 17):
                        at = np.arange(i, min(len(grams), i + (1 << 17)))
                        grams[at] = rolling.hash(at, at + grain.gram)
                    grams.sort()
                    often = np.unique(grams[SEEN - 1 :][grams[SEEN - 1 :] == grams[: max(0, len(grams) - SEEN + 1)]])
                    counts = np.searchsorted(grams, often, "right") - np.searchsorted(grams, often)
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(often.astype(np.int64))]), pa.array(np.concatenate([[len(grams)], counts]).astype(np.int64))], ["gram", "n"])

    return run


def frequent_grams(source: DataFrame, grain: Grain, share: int = SHARE, rare: int = RARE) -> np.ndarray:
    """Sorted hashes of the grams that are more than one in `share` of all grams (so at most `share` of them), and `rare` or more."""
    counts = source.select("text").mapInArrow(_counted(grain), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = written(counts.where(F.col("gram").isNull() | (F.col("n") >= rare)), "grams")
    total = counts.where("gram is null").select(F.col("n").alias("total"))
    found = counts.where("gram is not null").join(F.broadcast(total), F.col("n") * share > F.col("total")).select("gram")
    return np.sort(found.toArrow().column(0).to_numpy().astype(np.int64).view(U64))


_ANCHOR = "anchor long, context long, doc long, tag long, lo int, n int, rel int, sure boolean"


def _listed(grain: Grain, anywhere: bool, hashes: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent(hashes)
        for batch in batches:
            doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = []
            for first, _, data, offsets in text_blocks(batch.column(2)):
                for d, start, symbols, ends in _stretches(*grain.symbols(data, offsets), grain):
                    of, anchor, context, lo, n, rel = anchors(symbols, ends, grain, frequent)
                    found.append((of + first + d, anchor, context, lo + start, n, rel))
            if not found:
                continue
            of, anchor, context, lo, n, rel = (np.concatenate(x) for x in zip(*found))
            # The earliest of equal contexts stands for them; of the others only the place matters, not the anchor.
            order = np.lexsort((lo, tag[of], doc[of], context, anchor))
            of, anchor, context, lo, n, rel = (x[order] for x in (of, anchor, context, lo, n, rel))
            equal = (anchor[1:] == anchor[:-1]) & (context[1:] == context[:-1])
            later = np.concatenate([[False], equal])
            if anywhere:
                sure = later | np.concatenate([equal, [False]])
            else:  # a repeated row is not earlier than itself
                head = np.maximum.accumulate(np.where(later, 0, np.arange(len(later))))
                sure = later & ((doc[of] != doc[of[head]]) | (tag[of] != tag[of[head]]) | (lo != lo[head]))
            spread = sure & later
            anchor = np.where(spread, mix(anchor ^ mix(doc[of].astype(U64)) ^ mix(lo.astype(U64) + U64(3))), anchor)
            arrays = [anchor.astype(np.int64), context.astype(np.int64), doc[of], tag[of], lo.astype(np.int32), n.astype(np.int32), rel.astype(np.int32), sure]
            names = [x.split()[0] for x in _ANCHOR.split(", ")]
            for i in range(0, len(order), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in arrays], names)

    return run


def _resolved(rows: DataFrame, anywhere: bool) -> DataFrame:
    """Rows whose windows are all removed (`gone`), and those that stand for a context of an anchor with several (`kinds` of them)."""
    by_anchor = Window.partitionBy("anchor").orderBy("context", "doc", "tag", "lo")
    by_context = Window.partitionBy("anchor", "context").orderBy("doc", "tag", "lo")
    first = F.coalesce(F.lag("context").over(by_anchor) != F.col("context"), F.lit(True))
    if anywhere:
        repeated = ~first | F.coalesce(F.lead("context").over(by_anchor) == F.col("context"), F.lit(False))
    else:
        place = F.struct("doc", "tag", "lo")
        repeated = place != F.first(place).over(by_context)
    return (
        rows.withColumn("first", first)
        .withColumn("gone", F.col("sure") | repeated)
        .withColumn("kinds", F.sum(F.col("first").cast("int")).over(Window.partitionBy("anchor").orderBy("context", "doc", "tag", "lo").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("several", F.col("first") & (F.col("kinds") > 1))
        .where("gone or several")
        .select("anchor", "doc", "tag", "lo", "n", "rel", "gone", "several", F.col("kinds").cast("int").alias("kinds"))
    )


_CONTEXT = "anchor long, doc long, tag long, lo int, n int, rel int, symbols binary"


def _parted(grain: Grain, step: int, rolling: Rolling, anchor: np.ndarray, starts: np.ndarray, n: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts cut up by windows' distances to the anchor, `step` of them at a time: which context, first window within it, windows, anchor less first window; the part's anchor (the hash of what all such windows hold) and its context's hash."""
    low, high = (rel - n + 1) // step, rel // step
    count = high - low + 1
    which = np.repeat(np.arange(len(n)), count)
    part = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
    far = np.minimum(part * step + step - 1, rel[which])
    first, windows = rel[which] - far, far - np.maximum(part * step, (rel - n + 1)[which]) + 1
    place = starts[which] + rel[which]
    common = rolling.hash(place - part * step, place - (part * step + step - 1) + grain.width)
    begin = starts[which] + first
    key = mix(common ^ mix(anchor[which].astype(U64) + part.astype(U64) * U64(11)))
    context = mix(rolling.hash(begin, begin + windows - 1 + grain.width) ^ mix((far * 65536 + windows - 1).astype(U64) + U64(7)))
    return which, first, windows, far, key, context


def _fetched(grain: Grain, step: int) -> Callable:
    """From documents with the places of their contexts: the contexts' symbols, or (with a step) their parts as anchors of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = batch.column(0), batch.column(1)
            lists = batch.column(3)
            bounds, fields = lists.offsets.to_numpy(), lists.values
            anchor, lo, n, rel = (fields.field(k).to_numpy() for k in range(4))
            for first, rows, data, offsets in text_blocks(batch.column(2)):
                symbols, begins = grain.symbols(data, offsets) if grain.words or step else (data, offsets)
                of = np.repeat(np.arange(rows), np.diff(bounds[first : first + rows + 1]))
                these = slice(bounds[first], bounds[first + rows])
                a, lo_, n_, rel_ = anchor[these], lo[these], n[these], rel[these]
                starts = begins[of] + lo_
                row = pa.array(of + first)
                if step:
                    which, at, windows, far, key, context = _parted(grain, step, Rolling(symbols), a, starts, n_.astype(np.int64), rel_.astype(np.int64))
                    place = row.take(pa.array(which))
                    whole = [key.astype(np.int64), context.astype(np.int64), (lo_[which] + at).astype(np.int32), windows.astype(np.int32), far.astype(np.int32), np.zeros(len(which), bool)]
                    key_, context_, lo__, n__, rel__, sure = map(pa.array, whole)
                    yield pa.RecordBatch.from_arrays([key_, context_, doc.take(place), tag.take(place), lo__, n__, rel__, sure], [x.split()[0] for x in _ANCHOR.split(", ")])
                else:
                    ends = starts + n_ + grain.width - 1
                    texts = [symbols[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist())]
                    columns = [pa.array(a), doc.take(row), tag.take(row), pa.array(lo_), pa.array(n_), pa.array(rel_), pa.array(texts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _CONTEXT.split(", ")])

    return run


@dataclass
class Contexts:
    """Contexts of some anchors, earlier ones first: the group (anchor) of each, and its symbols before the anchor (nearest first) and from it on, filled with zeros."""

    group: np.ndarray
    n: np.ndarray
    rel: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def owners(self, off: int) -> np.ndarray:
        """Contexts that have a window starting `off` symbols before the anchor."""
        return np.flatnonzero((off <= self.rel) & (off > self.rel - self.n))


def _aligned(grain: Grain, group: np.ndarray, n: np.ndarray, rel: np.ndarray, texts: pa.Array) -> Contexts:
    texts = texts.cast(pa.large_binary())
    item = U64 if grain.words else np.uint8
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(item)
    offsets = (offsets - offsets[0]) // flat.itemsize
    of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    place = np.arange(len(flat)) - offsets[of] - rel[of]
    left, right = np.zeros((len(texts), grain.width), item), np.zeros((len(texts), grain.width), item)
    ahead = place >= 0
    right[of[ahead], place[ahead]] = flat[ahead]
    left[of[~ahead], -1 - place[~ahead]] = flat[~ahead]
    return Contexts(group, n, rel, left, right)


_SPAN = "doc long, tag long, start long, end long"


def _compared(grain: Grain, method: Callable[[Contexts, int], np.ndarray]) -> Callable:
    """Spans of windows that another (or an earlier) context of the same anchor has; the input is sorted by anchor."""

    def spans(table: pa.Table) -> pa.RecordBatch:
        anchor, doc, tag, lo, n, rel = (table.column(k).to_numpy() for k in range(6))
        order = np.lexsort((lo, tag, doc))
        fresh = np.concatenate([[True], np.any([x[order[1:]] != x[order[:-1]] for x in (lo, tag, doc)], axis=0)])
        order = order[fresh]  # a repeated row's contexts come twice
        anchor, doc, tag, lo, n, rel = (x[order] for x in (anchor, doc, tag, lo, n, rel))
        _, group = np.unique(anchor, return_inverse=True)
        contexts = _aligned(grain, group, n, rel, table.column(6).combine_chunks().take(pa.array(order)))
        hit = np.zeros((len(order), grain.width - grain.gram + 3), bool)
        hit[:, 1:-1] = method(contexts, grain.width)[:, ::-1]  # by falling distance to the anchor: windows in their order
        row, begin = np.nonzero(hit[:, 1:] & ~hit[:, :-1])
        _, end = np.nonzero(hit[:, :-1] & ~hit[:, 1:])
        place = lo[row] + rel[row] - (grain.width - grain.gram)
        return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(tag[row]), pa.array((place + begin).astype(np.int64)), pa.array((place + end - 1 + grain.width).astype(np.int64))], [x.split()[0] for x in _SPAN.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            anchor = held.column(0).to_numpy()
            while len(anchor) > COMPARED:
                cut = int(np.searchsorted(anchor, anchor[COMPARED]))  # whole anchors
                cut = cut or int(np.searchsorted(anchor, anchor[0], "right"))
                if cut == len(anchor):
                    break  # the last anchor may go on in the next batch
                yield spans(held.slice(0, cut))
                held, anchor = held.slice(cut), anchor[cut:]
        if held is not None and len(held):
            yield spans(held)

    return run


def identified(docs: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """(doc, tag, text): the key as a long (null: the least; a key that isn't a number is an error), a tag by which rows with equal keys are told apart, the text (null: empty); and more columns.

    The tag is the text's CRC-32 and, behind it, 31 bits of another hash, so that it
    orders rows as the CRC-32 does, and different texts under one key (or without
    any, which is one key) hardly ever share it: among n of them with a chance of n^2 / 2^64.
    """
    whole = F.coalesce(docs[text], F.lit(""))
    tag = F.shiftleft(F.crc32(whole), 31).bitwiseOR(F.xxhash64(whole).bitwiseAND(F.lit((1 << 31) - 1)))
    return docs.select(F.coalesce(docs[key].cast("long"), F.lit(-(2**63))).alias("doc"), tag.alias("tag"), whole.alias("text"), *more)


def repeated_spans(source: DataFrame, grain: Grain, method: Callable[[Contexts, int], np.ndarray], anywhere: bool, giant: int = GIANT, share: int = SHARE, rare: int = RARE) -> DataFrame:
    """(doc, tag, start, end) of stretches of `identified` documents, in symbols, that consist of windows which occur elsewhere (anywhere) or earlier."""
    listed = source.mapInArrow(_listed(grain, anywhere, frequent_grams(source, grain, share, rare)), _ANCHOR)
    resolved = written(_resolved(listed, anywhere), "resolved")
    gone = lambda df: df.where("gone").select("doc", "tag", F.col("lo").cast("long").alias("start"), (F.col("lo") + F.col("n") - 1 + grain.width).cast("long").alias("end"))

    def fetched(which: DataFrame, step: int) -> DataFrame:
        places = which.groupBy("doc", "tag").agg(F.collect_list(F.struct("anchor", "lo", "n", "rel")).alias("places"))
        return source.join(places, ["doc", "tag"]).select("doc", "tag", "text", "places").mapInArrow(_fetched(grain, step), _ANCHOR if step else _CONTEXT)

    spans = gone(resolved)
    for step in SPLITS:
        several = resolved.where("several")
        contexts = fetched(several.where(F.col("kinds") <= giant), 0).repartition("anchor").sortWithinPartitions("anchor")
        spans = spans.unionByName(contexts.mapInArrow(_compared(grain, method), _SPAN))
        most = resolved.agg(F.max("kinds")).first()[0]
        if most is None or most <= giant:
            break
        # After the last split the windows of a part are one and the same, so none is left to compare.
        resolved = written(_resolved(fetched(several.where(F.col("kinds") > giant), step), anywhere), "parts")
        spans = spans.unionByName(gone(resolved))
    return spans


def with_spans(source: DataFrame, spans: DataFrame) -> DataFrame:
    """`identified` documents with the list of their spans; each row once, repeated rows too."""
    lists = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return source.join(lists, ["doc", "tag"], "left")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of what half-open spans cover."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.concatenate([np.flatnonzero(new)[1:], [len(starts)]]) - 1]
