"""Substring dedup by relative Lempel-Ziv parsing over words.

The reference is the whole corpus in blocks: each block holds the contexts of an
anchor (see `windows`), indexed by their sorted continuations. Every context is
factored greedily against all others of its block: from where the parse stands,
the longest stretch that some other context also has, found beside it in sorted
order. A factor of `width` words or more is a duplicate span. The parse then goes
on at the first window that crosses the factor's end, so that no window that
straddles a boundary is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACED, text_blocks, word_bounds
from .suffix_dedup import multikey
from .windows import GIANT, RARE, Contexts, Grain, identified, merged, repeated_spans, with_spans

WIDTH, GRAM = 35, 8


def factored(contexts: Contexts, width: int) -> np.ndarray:
    """For each context and distance 0, 1, ... of window and anchor: whether the window lies in a factor that another context has."""
    n, most = len(contexts.group), width - GRAM
    hit = np.zeros((n, most + 1), bool)
    order, _ = multikey(contexts.right, contexts.group, width)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    # Classes of contexts with the same `off` words before the anchor, for each off.
    classes = [contexts.group.astype(np.int64)]
    for off in range(most):
        _, inverse = np.unique(np.stack([classes[-1].astype(np.uint64), contexts.left[:, off]], 1), axis=0, return_inverse=True)
        classes.append(inverse.ravel())
    standing = contexts.rel.copy()  # where each parse stands, as a distance to the anchor
    last = contexts.rel - contexts.n  # and where it is over
    for off in range(most, -1, -1):
        block = np.flatnonzero(contexts.rel >= off)
        active = np.zeros(n, bool)
        active[block] = (standing[block] == off) & (off > last[block])
        if not active.any():
            continue
        block = block[np.lexsort((rank[block], classes[off][block]))]
        same = classes[off][block[1:]] == classes[off][block[:-1]]
        differ = contexts.right[block[1:]] != contexts.right[block[:-1]]
        shared = np.where(same, np.where(differ.any(axis=1), differ.argmax(axis=1), width), -1)
        longest = np.full(n, -1)
        longest[block[1:]] = shared
        longest[block[:-1]] = np.maximum(longest[block[:-1]], shared)
        factor = np.where(longest >= 0, off + longest, 0)
        found = np.flatnonzero(active & (factor >= width))
        spent = np.minimum(factor[found] - width, off)  # windows after the first that the factor holds
        for step in range(int(spent.max(initial=-1)) + 1):
            some = found[spent >= step]
            hit[some, off - step] = off - step > last[some]
        standing[np.flatnonzero(active)] = off - 1
        standing[found] = off - spent - 1
    return hit


def _shortened(keep_text: bool) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            for first, n, data, offsets in text_blocks(batch.column(1)):
                begins, ends, of = word_bounds(data, offsets, SPACED)
                words = np.searchsorted(of, np.arange(n + 1))
                rows = []
                for i in range(n):
                    gone = np.zeros(words[i + 1] - words[i], bool)
                    if spans[first + i].is_valid:
                        own = spans[first + i].values
                        for a, b in zip(*(x.tolist() for x in merged(own.field(0).to_numpy(), own.field(1).to_numpy()))):
                            gone[a:b] = True
                    at = np.flatnonzero(~gone) + words[i]
                    raw = data
                    kept = b" ".join([raw[a:b].tobytes() for a, b in zip(begins[at].tolist(), ends[at].tolist())])
                    rows.append((len(gone), int(gone.sum()), hashlib.sha256(kept).hexdigest(), *[kept.decode()] * keep_text))
                columns = list(zip(*rows))
                types = [pa.int64(), pa.int64(), pa.string(), *[pa.string()] * keep_text]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *[pa.array(c, t) for c, t in zip(columns, types)]], ["doc", "n_words", "n_removed", "kept_sha256", *["kept_text"] * keep_text])

    return run


def lz_dedup(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", keep_text: bool = False, giant: int = GIANT, rare: int = RARE) -> DataFrame:
    """One row a document: key, n_words, n_removed, kept_sha256 (keep_text: also kept_text), all windows of `width` words that occur twice or more removed.

    Words are [^\\x20\\x09-\\x0D]+, unchanged; a null text has none; a text under
    `width` words keeps all. Rows with equal keys are documents of their own (a
    repeated row is a repetition). A null key is returned as the least long. A text of
    any length is worked on whole; an empty table gives an empty result; other
    columns, of whatever name, don't matter.
    """
    grain = Grain(True, width, GRAM)
    source = identified(docs, key, text)
    spans = repeated_spans(source, grain, factored, anywhere=True, giant=giant, rare=rare)
    result = with_spans(source, spans).select("doc", "text", "spans")
    schema = "doc long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return result.mapInArrow(_shortened(keep_text), schema).withColumnRenamed("doc", key)
