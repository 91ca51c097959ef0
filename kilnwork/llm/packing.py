"""Packing token sequences by Karmarkar-Karp multiway differencing.

Every task tokenises its documents and packs them in blocks, so nothing is
shuffled and a lost task repeats with the same result. A document's whole
windows go straight into sequences of their own; what remains of it is an item.
Differencing takes the two partial partitions that are the least balanced and
merges them fullest window with emptiest, until one partition of the block into
near-equal windows is left. If its fullest window exceeds the capacity, the
number of windows rises and the block is partitioned anew; where whole items would
cost more windows than the allowed slack, an item of each window that is too full is cut.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import require

CAPACITY = 1024
#: Share of windows that a block may have over the least possible number before items are cut.
SLACK = 0.02
#: Items to a block: the differencing of a block takes about items x windows steps.
BLOCK_ITEMS = 256
#: Distinct strings whose ids a task keeps, and as many that it has kept before.
CACHE = 300_000
#: Characters that are looked up at a time.
SLICE = 1 << 20


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: sums of k windows, fullest first, and the window of each item."""
    n = len(sizes)
    heap = []
    for i, size in enumerate(sizes.tolist()):
        sums = np.zeros(k, np.int64)
        sums[0] = size
        heap.append((-size if k > 1 else 0, i, sums))
    heapq.heapify(heap)
    merges = []  # the two partitions, and how the merged one's windows were ordered
    while len(heap) > 1:
        _, a, fuller = heapq.heappop(heap)
        _, b, other = heap[0]
        sums = fuller + other[::-1]
        order = sums.argsort()[::-1]
        sums = sums[order]
        heapq.heapreplace(heap, (int(sums[-1] - sums[0]), n + len(merges), sums))
        merges.append((a, b, order))
    sums = heap[0][2]
    labels: list = [None] * (n + len(merges))
    labels[-1] = np.arange(k)
    for node in range(n + len(merges) - 1, n - 1, -1):
        a, b, order = merges[node - n]
        own = np.empty(k, np.int64)
        own[order] = labels[node]
        labels[node], labels[a], labels[b] = None, own, own[::-1]
    return sums, np.array([x[0] for x in labels[:n]])


def _eased(items: list[tuple[int, int, int]], window: np.ndarray, k: int, capacity: int) -> list[tuple[int, int, int]]:
    """The items, the longest one of each window that is over the capacity cut in two, by what is over (an eighth of it at least, a half at most)."""
    sizes = np.array([x[2] for x in items], np.int64)
    over = np.bincount(window, sizes, k).astype(np.int64) - capacity
    order = np.lexsort((-sizes, window))
    longest = order[np.unique(window[order], return_index=True)[1]]
    out, cut = [], {int(i): int(over[window[i]]) for i in longest if over[window[i]] > 0}
    for i, (d, start, length) in enumerate(items):
        if i in cut and length > 1:
            part = length - max(1, min(max(cut[i], length // 8), length // 2))
            out += [(d, start, part), (d, start + part, length - part)]
        else:
            out.append((d, start, length))
    return out


def pack(items: list[tuple[int, int, int]], capacity: int = CAPACITY, slack: float = SLACK) -> list[list[tuple[int, int, int]]]:
    """Windows of at most `capacity` from items (document, start, length), none longer than the capacity.

    The number of windows is the least possible one (no two items over half the
    capacity share a window); whenever the capacity is exceeded it rises by one, to
    what the slack allows. Where that is not enough, whole items would leave more
    padding than the slack, so one item of each window that is still too full is cut, and
    the block partitioned anew.
    """
    total = sum(x[2] for x in items)
    if not total:
        return []
    least = -(-total // capacity)
    most = max(least + (least > 1), int(least * (1 + slack)))
    sizes = np.array([x[2] for x in items], np.int64)
    counts = range(min(most, max(least, int((2 * sizes > capacity).sum()))), most + 1)
    while True:
        for k in counts:
            sums, window = differencing(sizes, k)
            if sums[0] <= capacity:
                windows: list[list[tuple[int, int, int]]] = [[] for _ in range(k)]
                for x, w in zip(items, window):
                    windows[w].append(x)
                return [w for w in windows if w]
        items, counts = _eased(items, window, most, capacity), range(most, most + 1)
        sizes = np.array([x[2] for x in items], np.int64)


def _ranks(path: str) -> dict[bytes, int] | None:
    """A byte-level BPE vocabulary as ranks of byte strings, if its merges come in the order of their ids and nothing else in the file changes texts or ids."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file.get("pre_tokenizer") or {}
    if file.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    if any(t[k] for t in file.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(c): b for b, c in [*((b, b) for b in printable), *((b, 256 + i) for i, b in enumerate(rest))]}
    vocabulary = model["vocab"]
    added = {t["content"] for t in file.get("added_tokens") or []}
    if any(c not in byte_of for x in vocabulary for c in x if x not in added) or any(c.isspace() for x in added for c in x):
        return None
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [vocabulary.get("".join(m), -1) for m in merges]
    if ids != list(range(256, 256 + len(merges))):
        return None
    return {bytes(byte_of[c] for c in x): i for x, i in vocabulary.items() if i < 256 + len(merges)}


class Ids:
    """Ids of texts by a byte-level BPE tokenizer, little-endian unsigned 32-bit.

    The vocabulary's pattern never joins across a single white-space character,
    so a text whose white space never doubles falls apart at its spaces without
    any change of ids, and each distinct part is tokenised once. New parts are
    strung together with line ends, which are tokens of their own, and encoded by
    the same merges in one call. What this doesn't hold for (doubled white space,
    special tokens, white space at a part's end, a vocabulary of another kind)
    goes to the tokenizer itself.
    """

    _doubled = re.compile(r"\s\s")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ranks = _ranks(path)
        self.fast = None
        self.added = sorted(self.tokenizer.get_added_tokens_decoder().values(), key=str)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.added) or r"(?!)")
        if ranks is not None:
            import public_tokenizers
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.line_end = ranks[b"\n"]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> None:
        odd = [u for u in units if self.special.search(u) or u[-1:].isspace() or u[:1] == "\n" or not u]
        if odd:
            self.known.update(zip(odd, self._encode(odd)))
            odd_ = set(odd)
            units = [u for u in units if u not in odd_]
        for i in range(0, len(units), 50_000):
            part = units[i : i + 50_000]
            ids = np.array(self.fast.encode_ordinary("\n".join(part)), "<u4")
            breaks = np.flatnonzero(ids == self.line_end)
            lines = np.cumsum([u.count("\n") + 1 for u in part])[:-1] - 1
            bounds = np.concatenate([[-1], breaks[lines], [len(ids)]])
            raw = ids.tobytes()
            self.known.update((u, raw[4 * a + 4 : 4 * b]) for u, a, b in zip(part, bounds[:-1].tolist(), bounds[1:].tolist()))

    def _sliced(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > SLICE:
            end = text.find(" ", start + SLICE)
            if end < 0:
                break
            yield text[start:end]
            start = end
        yield text[start:]

    def of(self, text: str) -> bytes:
        if self.fast is None or self._doubled.search(text):
            return self._encode([text])[0]
        out = []
        for piece in self._sliced(text):
            first, *units = piece.split(" ")
            units = [" " + x for x in units]
            if first:
                units.insert(0, first)
            known = self.known
            missing = {u for u in units if u not in known}
            if missing:
                if len(known) > CACHE:
                    self.older, self.known = known, {}
                    known, missing = self.known, set(units)
                again = missing & self.older.keys()
                known.update((u, self.older[u]) for u in again)
                self._learn(list(missing - again))
            out += [known[u] for u in units]
        return b"".join(out)


_ids: dict[str, Ids] = {}


def ids_by(path: str) -> Ids:
    """This process's Ids for the vocabulary."""
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, slack: float = SLACK, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: where it lies in its document and in its sequence, and its ids' CRC-32 (with_ids: the ids too).

    Ids are the tokenizer's, then `end_id`; a null or empty text is just that
    id. Rows with the same key are separate documents; a null key stays null; an
    empty table gives an empty result. `sequence_id` is unique over the table:
    the partition's number and a number within it. A text of any length is tokenised
    whole and cut freely; other columns, of whatever name, don't matter.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sequence = ids_by(tokenizer), TaskContext.get().partitionId() << 40
        tokens: list[bytes] = []
        keys: list = []
        items: list[tuple[int, int, int]] = []
        full: list[tuple[int, int, int]] = []

        def flush(key_type: pa.DataType) -> pa.RecordBatch:
            nonlocal sequence
            rows: list[tuple] = []
            for window in [*[[x] for x in full], *pack(items, capacity, slack)]:
                offset = 0
                for d, start, length in window:
                    piece = tokens[d][4 * start : 4 * (start + length)]
                    rows.append((keys[d], start, length, zlib.crc32(piece), len(tokens[d]) // 4, sequence, offset, *[np.frombuffer(piece, "<i4")] * with_ids))
                    offset += length
                sequence += 1
            for x in (tokens, keys, items, full):
                x.clear()
            columns = list(zip(*rows))
            types = [key_type, *[pa.int64()] * 6, *[pa.list_(pa.int32())] * with_ids]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        key_type, held = None, 0
        for batch in batches:
            key_type = batch.column(0).type
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    row = ids.of(t or "") + end
                    n, d = len(row) // 4, len(tokens)
                    keys.append(k)
                    tokens.append(row)
                    held += n
                    whole = n - n % capacity
                    full.extend((d, s, capacity) for s in range(0, whole, capacity))
                    if n > whole:
                        items.append((d, whole, n - whole))
                    if len(items) >= BLOCK_ITEMS or held >= 4 * BLOCK_ITEMS * capacity:
                        yield flush(key_type)
                        held = 0
        if tokens:
            yield flush(key_type)

    return require(docs, key, text).mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
