"""Quality rules by repetition coverage.

Rolling hashes of the word sequence give, for several n-gram lengths at once,
every n-gram that its document has seen before; what counts is how many of the
document's characters lie inside such n-grams (overlaps once) and inside lines
seen before. All of it is numpy over blocks of whole documents, inside one
`mapInArrow`: no shuffle, memory bounded by a block and the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BYTE_CODES, SPACED, U64, Rolling, mix, per_document, require, text_blocks, word_bounds, word_counts

#: Largest share, in per cent, of a document's word characters inside n-grams of so many words seen before in it.
NGRAM_LIMITS = {5: 15, 7: 13, 10: 10}
#: Largest share, in per cent, of a document's characters inside lines seen before in it.
LINE_LIMIT = 20
MIN_WORDS, WINDOW, WINDOW_LIMIT = 50, 3, 50

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which have occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, before


def _covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of `length` words from one of the starts."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + length, -1)
    return np.cumsum(steps[:-1]) > 0


def measures(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """What the rules measure, for each document of a block."""
    n = len(offsets) - 1
    starts, ends, of = word_bounds(data, offsets, SPACED)
    code_points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = code_points[ends] - code_points[starts]
    letters = Rolling(BYTE_CODES[data])
    out = {"n_words": word_counts(of, n), "word_chars": per_document(of, chars, n)}
    symbols = np.flatnonzero(_SYMBOLS[data])
    out["n_symbols"] = word_counts(np.searchsorted(offsets, symbols, "right") - 1, n)

    breaks = np.flatnonzero(data == 10)
    line_of = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    line_starts, line_ends = np.concatenate([offsets[:-1], breaks + 1]), np.concatenate([breaks, offsets[1:]])
    order = np.lexsort((line_starts, line_of))
    line_of, line_starts, line_ends = line_of[order], line_starts[order], np.sort(line_ends, kind="stable")
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_of, line_starts, line_ends = line_of[worded], line_starts[worded], line_ends[worded]
    _, before = _repeats(mix(letters.hash(line_starts, line_ends) ^ mix(line_of.astype(U64) + U64(1))))
    out["n_dup_lines"] = word_counts(line_of[before], n)
    out["dup_line_chars"] = per_document(line_of[before], (code_points[line_ends] - code_points[line_starts])[before], n)
    out["n_chars"] = code_points[offsets[1:]] - code_points[offsets[:-1]]

    words = Rolling(letters.hash(starts, ends))
    for k in (WINDOW, *lengths):
        at = np.arange(max(0, len(starts) - k + 1))
        at = at[of[at] == of[at + k - 1]]
        twice, before = _repeats(mix(words.hash(at, at + k) ^ mix(of[at].astype(U64) + U64(1))))
        if k == WINDOW:
            inside = _covered(at[twice], k, len(starts))
            out["n_repeat_words"] = word_counts(of[inside], n)
        if k in lengths:
            inside = _covered(at[before], k, len(starts))
            out[f"dup_chars_{k}"] = per_document(of[inside], chars[inside], n)
    return out


def repetition_coverage(docs: DataFrame, ngram_limits: dict[int, int] | None = None, line_limit: int = LINE_LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document with the measures and the verdict `kept`.

    `base_failed`: under 50 words, or over half of the words in 3-word windows
    found twice or more. `kept`: not base_failed, no n-gram length over its
    limit, and repeated lines within theirs. A null or empty text has no words
    and fails; rows with the same key are judged each by itself; an empty table
    gives an empty result; a null key stays null. A text of any length is measured
    whole; other columns, of whatever name, don't matter.
    """
    limits = NGRAM_LIMITS if ngram_limits is None else dict(ngram_limits)
    lengths = tuple(sorted(limits))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "dup_line_chars", *(f"dup_chars_{k}" for k in lengths)]
    kind = docs.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data, offsets in text_blocks(batch.column(1)):
                m = measures(data, offsets, lengths)
                failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > WINDOW_LIMIT * m["n_words"])
                kept = ~failed & (100 * m["dup_line_chars"] <= line_limit * m["n_chars"])
                for k in lengths:
                    kept &= 100 * m[f"dup_chars_{k}"] <= limits[k] * m["word_chars"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *(pa.array(m[c], pa.int64()) for c in names), pa.array(failed), pa.array(kept)], [key, *names, "base_failed", "kept"])

    return require(docs, key, text).mapInArrow(judge, f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, kept boolean")
