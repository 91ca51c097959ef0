"""Media columns: chroma fingerprints of recordings, and their alignment.

A recording is a binary column of little-endian 16-bit samples. Its spectrum is
folded into frames of twelve pitch classes; filters that compare rectangles of
frames and pitch classes (summed by an integral image) give two bits each, and a
frame's sixteen filters make one packed 32-bit integer. Recordings with an integer
in common are joined by Spark, on the query's side also by the integer with its
least certain bit flipped; the differences of their places are counted in a
histogram of offsets, and every offset that has a vote is checked by its bit errors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require, written
from .components import SHARE

RATE, FRAME, HOP = 4000, 1024, 128
#: Frames that a filter spans, and filters.
SPAN, FILTERS = 16, 16
#: Largest share of different bits, and least number of common integers, of recordings that match. Of the given tables' recordings unrelated ones come down to 0.24 at the best of their offsets, noisy excerpts to 0.06 at most.
BIT_ERROR, OVERLAP = 0.2, 24
_LEVELS = np.array([-0.25, 0.0, 0.25])
#: The bit of a filter's two that changes at each level.
_TURNS = np.array([1, 2, 1], np.uint32)


@lru_cache
def _pitch_classes(rate: int, frame: int) -> np.ndarray:
    """Which part of each frequency goes to which pitch class."""
    frequency = np.fft.rfftfreq(frame, 1 / rate)
    out = np.zeros((len(frequency), 12))
    heard = np.flatnonzero((frequency >= 100) & (frequency <= 0.45 * rate))
    pitch = 12 * np.log2(frequency[heard] / 220)
    low = np.floor(pitch).astype(int)
    out[heard, low % 12] = 1 - (pitch - low)
    out[heard, (low + 1) % 12] += pitch - low
    return out.astype(np.float32)


def _rectangles(i: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
    """The two sides of filter i: rectangles (first frame, last, first pitch class, last) on a ring of pitch classes laid out twice."""
    kind, band = i % 4, (i * 5) % 12
    height = (3, 4, 6, 2)[(i // 4) % 4]
    if kind == 0:  # earlier against later
        return [(0, SPAN // 2, band, band + height)], [(SPAN // 2, SPAN, band, band + height)]
    if kind == 1:  # lower against higher
        return [(0, SPAN, band, band + height)], [(0, SPAN, band + height, band + 2 * height)]
    if kind == 2:  # crosswise
        half = SPAN // 2
        return [(0, half, band, band + height), (half, SPAN, band + height, band + 2 * height)], [(half, SPAN, band, band + height), (0, half, band + height, band + 2 * height)]
    third = SPAN // 4  # the middle against both ends
    return [(third, SPAN - third, band, band + height)], [(0, third, band, band + height), (SPAN - third, SPAN, band, band + height)]


def fingerprint(samples: np.ndarray, rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> tuple[np.ndarray, np.ndarray]:
    """Packed integers of a recording, one a hop (none if it is too short), and the same with the bit flipped whose filter lies nearest to a level."""
    count = (len(samples) - frame) // hop + 1
    if count < SPAN:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    window, classes = np.hanning(frame).astype(np.float32), _pitch_classes(rate, frame)
    frames = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop]
    chroma = np.concatenate([np.abs(np.fft.rfft(frames[i : i + 512] * window, axis=1)) ** 2 @ classes for i in range(0, count, 512)])
    chroma /= np.linalg.norm(chroma, axis=1, keepdims=True) + 1e-9
    image = np.zeros((count + 1, 25))
    image[1:, 1:] = np.tile(chroma, 2).cumsum(0).cumsum(1)
    n = count - SPAN + 1
    packed, weak, least = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.full(n, np.inf)

    def area(rectangles: list[tuple[int, int, int, int]]) -> np.ndarray:
        return sum(image[b : b + n, d] - image[a : a + n, d] - image[b : b + n, c] + image[a : a + n, c] for a, b, c, d in rectangles)

    for i in range(FILTERS):
        plus, minus = _rectangles(i)
        value = np.log((1 + area(plus)) / (1 + area(minus)))
        level = np.digitize(value, _LEVELS)
        packed |= (level ^ (level >> 1)).astype(np.uint32) << np.uint32(2 * i)
        away = np.abs(value[:, None] - _LEVELS)
        nearest, distance = away.argmin(axis=1), away.min(axis=1)
        nearer = distance < least
        weak[nearer], least[nearer] = _TURNS[nearest[nearer]] << np.uint32(2 * i), distance[nearer]
    return packed, packed ^ weak


def fingerprints(media: DataFrame, key: str, samples: str, rate: int = RATE) -> DataFrame:
    """(key, fingerprint array<int>, weak array<int>) of each recording; weak: each integer with its least certain bit flipped. A null, empty or too short recording has empty ones; repeated rows each have their own row; other columns don't matter."""
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                prints = [fingerprint(np.frombuffer(x.as_py() or b"", "<i2", len(x.as_py() or b"") // 2).astype(np.float32), rate) for x in part.column(1)]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p, _ in prints])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([p[k] for p in prints]).view(np.int32))) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], [key, "fingerprint", "weak"])

    return require(media, key, samples).mapInArrow(run, f"`{key}` {kind}, fingerprint array<int>, weak array<int>")


def _classes(prints: DataFrame, key: str) -> DataFrame:
    """(class, name, fingerprint, copies): equal fingerprints once, named by their least key; `class` tells them apart where names are null or the same."""
    classes = prints.where(F.size("fingerprint") > 0).groupBy("fingerprint").agg(F.min(key).alias("name"), F.count("*").alias("copies"))
    return classes.withColumn("class", F.monotonically_increasing_id())


def _weak(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, query_at, code): the integers with their least certain bit flipped of all recordings of each class. Equal fingerprints may have different ones, and each is looked for, once."""
    both = prints.where(F.size("fingerprint") > 0).select("fingerprint", "weak").distinct().join(classes.select("fingerprint", "class"), "fingerprint")
    return both.select("class", F.posexplode("weak").alias("query_at", "code")).distinct()


def members(prints: DataFrame, key: str) -> DataFrame:
    """(key, name): every recording, once a row, and the name of its class of equal fingerprints (as in `aligned`); null for one without a fingerprint, which is in no class."""
    classes = prints.where(F.size("fingerprint") > 0).groupBy("fingerprint").agg(F.min(key).alias("name"))
    return prints.select(key, "fingerprint").join(classes, "fingerprint", "left").select(key, "name")


def _votes(asked: DataFrame, stored: DataFrame, weak: DataFrame | None) -> DataFrame:
    """(query, match, offset, votes): the histogram of offsets of recordings that have an integer in common.

    Integers that hold more than one in SHARE of all places (rests, held tones) are
    dealt over so many tasks that none has more than that share; of the queries'
    places with these there is then one row for each of their tasks.
    """
    places = stored.select(F.col("class").alias("match"), F.posexplode("fingerprint").alias("at", "code"))
    counts = places.groupBy("code").agg(F.count("*").alias("n"))
    total = stored.agg(F.coalesce(F.sum(F.size("fingerprint")), F.lit(0))).first()[0]
    frequent = written(counts.where(F.col("n") * SHARE > total).select("code", F.ceil(F.col("n") * SHARE / total).cast("int").alias("parts")), "frequent")  # SHARE rows at most
    parts = lambda df: df.join(F.broadcast(frequent), "code", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    looked = asked.select(F.col("class").alias("query"), F.posexplode("fingerprint").alias("query_at", "code"))
    looked = looked if weak is None else looked.union(weak)
    left = parts(looked).select("query", "query_at", "code", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = parts(places).select("match", "at", "code", F.pmod(F.xxhash64("match"), F.col("parts")).cast("int").alias("part"))
    return left.join(right, ["code", "part"]).groupBy("query", "match", (F.col("at") - F.col("query_at")).alias("offset")).agg(F.count("*").alias("votes"))


def aligned(prints: DataFrame, queries: DataFrame, key: str, bit_error: float = BIT_ERROR, overlap: int = OVERLAP) -> DataFrame:
    """Matches of queries with recordings: query, match (least keys of their classes of equal fingerprints), query_copies, match_copies, offset, votes, overlap, bit_error.

    `offset`: where in the match the query begins, in hops. Every recording is
    indexed; classes of equal fingerprints are compared once. A pair is looked at
    where an integer, or the query's with its least certain bit flipped (if there is a column `weak`), is
    equal (recordings of one class may differ in `weak`; all of theirs are looked for): at every such offset with `overlap` integers. Of those with at most
    `bit_error` different bits the one with the least share (then the least offset)
    is returned. Empty fingerprints match nothing, so an empty table gives an empty
    result; a null key is the name of a class only if no other key has it. `members` tells
    which recordings a class has. Runs Spark jobs when it is called: both sides' classes
    are written once.
    """
    stored, asked = written(_classes(prints, key), "recordings"), written(_classes(queries, key), "queries")
    weak = written(_weak(queries, asked), "weak") if "weak" in queries.columns else None
    sizes = lambda df, name, n: df.select(F.col("class").alias(name), F.size("fingerprint").alias(n))
    votes = _votes(asked, stored, weak).join(sizes(asked, "query", "n_a"), "query").join(sizes(stored, "match", "n_b"), "match")
    from_a, from_b = F.greatest(F.lit(0), -F.col("offset")), F.greatest(F.lit(0), F.col("offset"))
    some = votes.withColumn("from_a", from_a).withColumn("from_b", from_b).withColumn("overlap", F.least(F.col("n_a") - from_a, F.col("n_b") - from_b)).where(F.col("overlap") >= overlap)
    offsets = some.groupBy("query", "match").agg(F.collect_list(F.struct("offset", "votes", "from_a", "from_b", "overlap")).alias("offsets"))
    pairs = offsets.join(asked.select(F.col("class").alias("query"), F.col("name").alias("query_name"), F.col("fingerprint").alias("a"), F.col("copies").alias("query_copies")), "query").join(
        stored.select(F.col("class").alias("match"), F.col("name").alias("match_name"), F.col("fingerprint").alias("b"), F.col("copies").alias("match_copies")), "match"
    )

    def checked(o):
        part = lambda c, start: F.slice(c, start + 1, o["overlap"])
        wrong = F.aggregate(F.zip_with(part("a", o["from_a"]), part("b", o["from_b"]), lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("long").bitwiseAND(0xFFFFFFFF))), F.lit(0), lambda s, x: s + x)
        return F.struct((wrong / (o["overlap"] * 32.0)).alias("bit_error"), o["offset"].alias("offset"), o["votes"].alias("votes"), o["overlap"].alias("overlap"))

    best = pairs.select(F.col("query_name").alias("query"), F.col("match_name").alias("match"), "query_copies", "match_copies", F.array_min(F.transform("offsets", checked)).alias("best")).where(F.col("best.bit_error") <= bit_error)
    return best.select("query", "match", "query_copies", "match_copies", "best.offset", "best.votes", "best.overlap", "best.bit_error")


def melodies(vectors: DataFrame, key: str, vector: str, excerpt: bool = False, notes_a_row: int = 256) -> DataFrame:
    """(key, samples): a recording of each vector, one note a number: its size gives the pitch. With `excerpt`, the middle part alone, cut at an odd place and with noise in it. A null vector has no samples; a null or missing number is a rest."""
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        time = np.arange(notes_a_row) / RATE
        tones = 8000 * np.sin(2 * np.pi * 220 * 2.0 ** (np.arange(24)[:, None] / 12) * time)
        tones = np.concatenate([tones, np.zeros((1, notes_a_row))]).astype("<i2")
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                recordings = []
                for k, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    values = np.array([np.nan if x is None else x for x in v or []], float)
                    pitch = np.where(np.isfinite(values), np.clip(np.round(12 + np.nan_to_num(values) * 48), 0, 23), 24).astype(int)
                    wave = tones[pitch].ravel()
                    if excerpt and len(wave):
                        noise = np.random.Generator(np.random.PCG64(0 if k is None else abs(int(k)))).normal(0, 800, len(wave))
                        wave = (wave + noise).clip(-32768, 32767).astype("<i2")[len(wave) // 4 + 37 : 3 * len(wave) // 4]
                    recordings.append(wave.tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(recordings, pa.binary())], [key, "samples"])

    return require(vectors, key, vector).mapInArrow(run, f"`{key}` {kind}, samples binary")
