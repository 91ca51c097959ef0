"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct word units are strung together and indexed by a suffix array
(sorted as deep as the longest piece). Every piece of the vocabulary is binary-
searched for its range of occurrences; each occurrence is an edge from its start to
its end. Edges are laid out by position, and the units' paths are relaxed over
them: by merges of best score first for BPE models, each merge an edge over two
neighbouring ones. Characters on no edge fall back to bytes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, require

SPACE = "▁"
#: Distinct units whose ids a process keeps, and as many that it has kept before.
CACHE = 300_000
#: Characters indexed at a time, and units that are relaxed together rather than each by a queue.
INDEXED, LONG = 1 << 19, 64
#: Characters of a text that are looked at at a time.
SLICE = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
        yield tag >> 3, data[at : at + size]
        at += size


def unsupported(path: str) -> str | None:
    """What in a model file this module can't do, if anything. The numbers of the fields of a model file."""
    with open(path, "rb") as f:
        fields = list(_fields(f.read()))
    inside = lambda number: {k: v for n, part in fields if n == number for k, v in _fields(part)}
    trainer, normaliser = inside(2), inside(3)
    kinds = {dict(_fields(part)).get(3, 1) for n, part in fields if n == 1}
    if trainer.get(3, 1) != 2:
        return "the model isn't a BPE model"
    if trainer.get(24, 0):
        return "spaces are pieces' ends"
    if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1):
        return "the model normalises texts"
    if 4 in kinds:
        return "the model has pieces that users defined"
    return None


class Model:
    """A SentencePiece BPE model's vocabulary, encoder and decoder. A model of another kind, or one that normalises texts, is refused (ValueError), as its ids would differ."""

    _units = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def __init__(self, path: str):
        import sentencepiece

        if why := unsupported(path):
            raise ValueError(f"{path}: {why}")
        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        n = processor.get_piece_size()
        self.pieces = [processor.id_to_piece(i) for i in range(n)]
        self.scores = np.array([processor.get_score(i) for i in range(n)])  # of equal ones the leftmost merges first
        self.bytes_ids = np.full(256, processor.unk_id())
        normal = []
        for i, piece in enumerate(self.pieces):
            if processor.is_byte(i):
                self.bytes_ids[int(piece[3:5], 16)] = i
            elif not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)):
                normal.append(i)
        inner = [p for p in (self.pieces[i] for i in normal) if SPACE in p.lstrip(SPACE)]
        if inner:
            raise ValueError(f"units aren't independent: pieces such as {inner[0]!r} have a space inside")
        self.prefix = processor.encode("a", out_type=str)[0].startswith(SPACE)
        self.values = [b"" if processor.is_control(i) else bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.values[processor.unk_id()] = " ⁇ ".encode()
        self.longest = max(len(self.pieces[i]) for i in normal)
        self.keys_per_suffix = self.longest // 4 + 1  # a character more than the longest piece at least
        letters = sorted({c for i in normal for c in self.pieces[i]})
        self.rank = np.full(0x110000, len(letters) + 1, np.uint16)
        self.rank[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.normal = np.array(normal)
        self.lengths = np.array([len(self.pieces[i]) for i in normal])
        self.low, self.high = self._piece_keys(0), self._piece_keys(0xFFFF)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _piece_keys(self, fill: int) -> np.ndarray:
        """Pieces as keys of four characters each, filled up with the least or the greatest character."""
        out = np.full((len(self.normal), 4 * self.keys_per_suffix), fill, U64)
        for row, i in enumerate(self.normal):
            out[row, : len(self.pieces[i])] = self.rank[[ord(c) for c in self.pieces[i]]]
        return _packed(out)

    def _edges(self, ranks: np.ndarray) -> np.ndarray:
        """edge[start, length - 1]: the piece there, or -1."""
        n = len(ranks)
        padded = np.full(n + 4 * self.keys_per_suffix, 0, U64)
        padded[:n] = ranks
        four = (padded[:-3] << U64(48)) | (padded[1:-2] << U64(32)) | (padded[2:-1] << U64(16)) | padded[3:]
        keys = [four[4 * k : 4 * k + n] for k in range(self.keys_per_suffix)]
        suffixes = np.lexsort(keys[::-1])
        ordered = [k[suffixes] for k in keys]
        low, high = _search(ordered, self.low), _search(ordered, self.high)
        count = high - low
        which = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
        edges = np.full((n, self.longest), -1, np.int32)
        edges[suffixes[place], self.lengths[which] - 1] = self.normal[which]
        return edges

    def _relaxed_long(self, edges: np.ndarray, start: int, end: int) -> tuple[list[int], list[int]]:
        """Boundaries of one long unit's symbols, merged by a queue of edges."""
        after = {i: i + 1 for i in range(start, end)}  # symbol start -> its end
        before = {i + 1: i for i in range(start, end)}
        queue: list = []

        def offer(a: int, b: int) -> None:
            if b in after and after[b] - a <= self.longest and (piece := edges[a, after[b] - a - 1]) >= 0:
                heapq.heappush(queue, (-self.scores[piece], a, b, after[b]))

        for i in range(start, end - 1):
            offer(i, i + 1)
        while queue:
            _, a, b, c = heapq.heappop(queue)
            if after.get(a) != b or after.get(b) != c:
                continue
            after[a], before[c] = c, a
            del after[b], before[b]
            offer(a, c)
            if a in before:
                offer(before[a], a)
        starts = sorted(after)
        return starts, [after[s] for s in starts]

    def _learn(self, units: list[str]) -> None:
        text = "\0".join(units)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(u) for u in units])
        begins = np.cumsum(sizes + 1) - sizes - 1
        ranks = self.rank[codes]
        ranks[begins[1:] - 1] = 0xFFFE  # nothing matches across units
        edges = self._edges(ranks)
        start = np.concatenate([np.arange(b, b + s) for b, s in zip(begins.tolist(), sizes.tolist()) if s <= LONG] or [np.zeros(0, int)])
        unit = np.repeat(np.arange(len(units)), np.where(sizes <= LONG, sizes, 0))
        end = start + 1
        moving = np.ones(len(start), bool)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(start):
            pair = (unit[1:] == unit[:-1]) & (end[1:] - start[:-1] <= self.longest)
            piece = np.full(len(start), -1)
            at = np.flatnonzero(pair)
            piece[at] = edges[start[at], end[at + 1] - start[at] - 1]
            score = np.where(piece >= 0, self.scores[piece], -np.inf)
            first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            best = np.maximum.reduceat(score, first)
            of = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(unit)]])))
            moving = np.isfinite(best)
            done.append((start[~moving[of]], end[~moving[of]]))
            top = np.flatnonzero((score == best[of]) & moving[of])
            top = top[np.concatenate([[True], of[top][1:] != of[top][:-1]])[: len(top)]]  # the leftmost of a unit
            end[top] = end[top + 1]
            keep = moving[of]
            keep[top + 1] = False
            start, end, unit = start[keep], end[keep], unit[keep]
        for i in np.flatnonzero(sizes > LONG):
            done.append(tuple(np.array(x) for x in self._relaxed_long(edges, int(begins[i]), int(begins[i] + sizes[i]))))
        start, end = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, int), np.zeros(0, int))
        order = np.argsort(start)
        start, end = start[order], end[order]
        ids = edges[start, np.minimum(end - start, self.longest) - 1]
        owner = np.searchsorted(begins, start, "right") - 1
        lost = np.flatnonzero(ids < 0)
        if len(lost):  # single characters without a piece, as their bytes
            parts = [text[i].encode() for i in start[lost].tolist()]
            count = np.ones(len(ids), int)
            count[lost] = [len(p) for p in parts]
            flat = np.repeat(ids, count)
            flat[np.repeat(ids < 0, count)] = self.bytes_ids[np.frombuffer(b"".join(parts), np.uint8)]
            ids, owner = flat, np.repeat(owner, count)
        raw = ids.astype("<i4").tobytes()
        bounds = np.searchsorted(owner, np.arange(len(units) + 1)) * 4
        self.known.update((u, raw[a:b]) for u, a, b in zip(units, bounds[:-1].tolist(), bounds[1:].tolist()))

    def _slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE:
            end = text.find(SPACE, at + SLICE)
            while 0 < end and text[end - 1] == SPACE:
                end = text.find(SPACE, end + 1)
            if end < 0:
                break
            yield text[at:end]
            at = end
        yield text[at:]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split, missing = [], set()
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}
        for text in texts:
            rows = []
            if text:
                for part in self._slices((SPACE if self.prefix else "") + text.replace(" ", SPACE)):
                    units = self._units.findall(part)
                    missing.update(u for u in units if u not in self.known)
                    rows.append(units)
            split.append(rows)
        again = missing & self.older.keys()
        self.known.update((u, self.older[u]) for u in again)
        batch, size = [], 0
        for u in missing - again:
            batch.append(u)
            size += len(u) + 1
            if size > INDEXED:
                self._learn(batch)
                batch, size = [], 0
        if batch:
            self._learn(batch)
        known = self.known
        return [np.frombuffer(b"".join([known[u] for units in rows for u in units]), "<i4") for rows in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, bytes put together again, the added space taken away."""
        values = self.values
        text = b"".join([values[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def _packed(ranks: np.ndarray) -> np.ndarray:
    four = ranks.reshape(len(ranks), -1, 4)
    return (four[:, :, 0] << U64(48)) | (four[:, :, 1] << U64(32)) | (four[:, :, 2] << U64(16)) | four[:, :, 3]


def _search(ordered: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Binary search of all wanted keys at once: how many suffixes come before each."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(ordered[0]), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        less, equal = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for k, keys in enumerate(ordered):
            have, want = keys[middle], wanted[open_, k]
            less |= equal & (have < want)
            equal &= have == want
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """This process's model from the file."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, ids, n_ids, and whether decoding them gives the text back (round_trip).

    A null or empty text has no ids and comes back as empty. Rows with equal or
    null keys are encoded each by itself; an empty table gives an empty result; other
    columns don't matter. Texts are indexed about a million characters at a time, cut
    at spaces; a text without any is indexed whole, at some 100 bytes a character.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            first = 0
            texts = [t or "" for t in batch.column(1).to_pylist()]
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last]) < 2 * SLICE):
                    size += len(texts[last])
                    last += 1
                ids = m.encode(texts[first:last])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                back = [m.decode(x) == t for x, t in zip(ids, texts[first:last])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists, pa.array(np.diff(offsets).astype(np.int64)), pa.array(back)], [key, "ids", "n_ids", "round_trip"])
                first = last

    return require(docs, key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, n_ids long, round_trip boolean")


def decoded(encodings: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row a row of ids: key and text; null ids give a null text."""
    kind = encodings.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.slice(first, 512)
                texts = [None if x is None else m.decode(np.array(x, np.int64)) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [key, "text"])

    return require(encodings, key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
