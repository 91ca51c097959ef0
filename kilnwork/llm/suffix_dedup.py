"""Suffix-array dedup: bytes covered by a string of `width` bytes that also starts earlier.

Candidates come from `windows`; the contexts of an anchor are suffixes from the
anchor on (and, backwards, the bytes before it), and these are sorted by
deep-shallow sorting: multikey quicksort, eight bytes a symbol, to a shallow
depth, then a blind trie orders each group that is still equal. Sorted suffixes
with their common prefixes give, for every distance to the anchor, the classes
of equal windows, of which all but the earliest member go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks
from .windows import GIANT, RARE, Contexts, Grain, identified, merged, repeated_spans, with_spans

WIDTH, GRAM = 100, 20
#: Depth in symbols of eight bytes at which the quicksort stops.
SHALLOW = 3


def multikey(symbols: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of rows by group and their first `depth` symbols; returns the order and, in it, the number of the class of rows still equal.

    All segments that are still open are parted at once, each by its own pivot (the
    median of three), into rows with less, the same and more at the symbol where
    the segment stands; those with the same go on at the next symbol.
    """
    depth = min(depth, symbols.shape[1])
    order, of = np.argsort(group, kind="stable"), np.sort(group)
    cut = np.concatenate([[True], of[1:] != of[:-1]])
    level = np.zeros(len(order), np.int64)
    while True:
        first = np.flatnonzero(cut)
        size = np.diff(np.append(first, len(order)))
        open_ = (size > 1) & (level[first] < depth)
        first, size = first[open_], size[open_]
        if not len(first):
            return order, np.cumsum(cut) - 1
        begin = np.cumsum(size) - size  # of each segment among the open rows
        segment = np.repeat(np.arange(len(first)), size)
        place = np.arange(len(segment)) - begin[segment] + first[segment]
        value = symbols[order[place], level[place]]
        x, y, z = value[begin], value[begin + size // 2], value[begin + size - 1]
        pivot = np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))[segment]
        less, same = value < pivot, value == pivot
        new = np.empty(len(place), np.int64)
        start = first.copy()
        for part in (less, same, ~(less | same)):
            before = np.cumsum(part) - part
            count = np.add.reduceat(part.astype(np.int64), begin)
            new[part] = (start[segment] + before - before[begin][segment])[part]
            cut[start[count > 0]] = True
            start = start + count
        order[new] = order[place]
        level[new] = level[place] + same


def blind_trie(strings: list[int], length: int) -> tuple[list[int], list[int]]:
    """Sorted order of equally long strings (as big-endian numbers of `length` bytes) and each one's common prefix with the one before.

    Inserting goes down by branching bytes alone to some leaf, compares with that
    one leaf, and comes back to the node at the depth where they differ.
    """
    byte = lambda s, d: (s >> (8 * (length - 1 - d))) & 255
    root: list = [length, None, [0]]  # depth, children by byte, leaves at the full depth
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while node[1] is not None:
            node = node[1].get(byte(s, node[0])) or next(iter(node[1].values()))
        common = length - (((s ^ strings[node[2][0]]).bit_length() + 7) // 8)
        node = root
        while node[0] < common:
            node = node[1][byte(s, node[0])]
        if node[0] == common:
            if node[1] is None:
                node[2].append(i)
            else:
                node[1][byte(s, common)] = [length, None, [i]]
            continue
        below = node[:]
        other = below
        while other[1] is not None:
            other = next(iter(other[1].values()))
        node[:] = [common, {byte(strings[other[2][0]], common): below, byte(s, common): [length, None, [i]]}, None]
    order, commons, stack = [], [], [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if node[1] is None:
            order += node[2]
            commons += [shared, *[length] * (len(node[2]) - 1)]
        else:
            kids = [node[1][b] for b in sorted(node[1])]
            stack += [(kid, node[0] if k else shared) for k, kid in reversed(list(enumerate(kids)))]
    return order, commons


def suffix_order(texts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow sorting of the rows of a byte matrix within their groups: the order, and each one's common prefix with the one before (0 at a group's start)."""
    n, width = texts.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = texts
    words = padded.view(">u8").astype(np.uint64)
    order, of = multikey(words, group, SHALLOW)
    sizes = np.bincount(of)
    starts = np.cumsum(sizes) - sizes
    length = padded.shape[1]
    common = np.zeros(n, np.int64)
    differ = padded[order[1:]] != padded[order[:-1]]
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common[1:][group[order[1:]] != group[order[:-1]]] = 0
    for c in np.flatnonzero(sizes > 1):
        members = order[starts[c] : starts[c] + sizes[c]].copy()
        inner, shared = blind_trie([int.from_bytes(padded[m].tobytes(), "big") for m in members], length)
        order[starts[c] : starts[c] + sizes[c]] = members[inner]
        common[starts[c] + 1 : starts[c] + sizes[c]] = np.minimum(shared[1:], width)
    return order, common


def earlier_windows(contexts: Contexts, width: int) -> np.ndarray:
    """For each context and distance 0, 1, ... of window and anchor: whether an earlier context has the same window."""
    n = len(contexts.group)
    offs = int(contexts.rel.max(initial=0)) + 1
    right, right_common = suffix_order(contexts.right, contexts.group)
    left, left_common = suffix_order(contexts.left, contexts.group)
    hit = np.zeros((n, width - GRAM + 1), bool)
    new = np.concatenate([[True], contexts.group[right[1:]] != contexts.group[right[:-1]]])
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    new_left = np.concatenate([[True], contexts.group[left[1:]] != contexts.group[left[:-1]]])
    for off in range(offs):
        own = contexts.owners(off)
        if len(own) < 2:
            continue
        right_class[right] = np.cumsum(new | (right_common < width - off))
        left_class[left] = np.cumsum(new_left | (left_common < off))
        _, firsts = np.unique(right_class[own] * (n + 1) + left_class[own], return_index=True)
        later = np.ones(len(own), bool)
        later[firsts] = False
        hit[own[later], off] = True
    return hit


def _shortened(keep_text: bool) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            for first, n, data, offsets in text_blocks(batch.column(1)):
                rows = []
                for i in range(n):
                    own = spans[first + i].values if spans[first + i].is_valid else None
                    starts, ends = merged(own.field(0).to_numpy(), own.field(1).to_numpy()) if own is not None else (np.zeros(0, int), np.zeros(0, int))
                    text = data[offsets[i] : offsets[i + 1]]
                    bounds = np.concatenate([[0], np.stack([starts, ends], 1).ravel(), [len(text)]]).tolist()
                    kept = b"".join(text[a:b].tobytes() for a, b in zip(bounds[::2], bounds[1::2]))
                    rows.append((len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "ignore")] * keep_text))
                columns = list(zip(*rows))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * keep_text]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *[pa.array(c, t) for c, t in zip(columns, types)]], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * keep_text])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column(2)
        for first, n, data, offsets in text_blocks(batch.column(1)):
            texts = []
            for i in range(n):
                text = data[offsets[i] : offsets[i + 1]]
                kept = np.ones(len(text), bool)
                if spans[first + i].is_valid:
                    own = spans[first + i].values
                    for a, b in zip(own.field(0).to_pylist(), own.field(1).to_pylist()):
                        kept[a:b] = False
                texts.append(text[kept].tobytes().decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(texts, pa.string())], ["row", "text"])


def without_repeats(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", giant: int = GIANT, rare: int = RARE) -> DataFrame:
    """All rows and columns of docs, the text without the bytes that `suffix_dedup` removes (a null text becomes empty; characters broken by a cut go too). An empty table gives an empty one; columns may have any name."""
    source = identified(docs, key, text)
    spans = repeated_spans(source, Grain(False, width, GRAM), earlier_windows, anywhere=False, giant=giant, rare=rare)
    rows = identified(docs, key, text, F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string"
    cut = with_spans(rows, spans).select("row", "text", "spans").mapInArrow(_cut, schema)
    return cut.select(*[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def suffix_dedup(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", keep_text: bool = False, giant: int = GIANT, rare: int = RARE) -> DataFrame:
    """One row a document: key, n_bytes, n_removed, n_spans, kept_sha256 (keep_text: also kept_text, without broken characters at the cuts).

    Earlier is a smaller key, or the same document and an earlier start. Texts
    are UTF-8 bytes, a null is empty; a text under `width` bytes keeps all of
    them. A null key comes before all others and is returned as the least long.
    Of rows with equal keys, the one with the smaller CRC-32 of its text is
    earlier; equal rows aren't earlier than each other and get the same result.
    A text of any length is worked on whole, in blocks of windows; an empty table
    gives an empty result; other columns, of whatever name, don't matter.
    """
    grain = Grain(False, width, GRAM)
    source = identified(docs, key, text)
    spans = repeated_spans(source, grain, earlier_windows, anywhere=False, giant=giant, rare=rare)
    result = with_spans(source, spans).select("doc", "text", "spans")
    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text
    return result.mapInArrow(_shortened(keep_text), schema).withColumnRenamed("doc", key)
