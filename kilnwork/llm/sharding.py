"""Documents dealt over shards of nearly equal bytes by a histogram sort.

The order is that of a hash of the text, then of the id's. Exact bytes below
candidate boundaries are counted in all partitions at once, and the candidates are
drawn closer around each splitter until the bytes below it are near enough to its
share. Only counts of a fixed number of candidates reach the driver. The rows are
then exchanged once, cut into blocks of a bounded size within each shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import require, written

SHARDS = 16
#: Candidate boundaries for each splitter in a round.
PROBES = 64
#: By how much of a shard's share the bytes below a splitter may differ from what is due.
TOLERANCE = Fraction(1, 1000)
#: By how much they may differ (or by half the largest document) so that a group of equal texts isn't cut in two.
WHOLE_GROUP = Fraction(1, 100)
#: Bytes of text that a task of the exchange gets, about.
BLOCK = 16 << 20
#: Rows of block counts up to which they are broadcast; more are joined.
BROADCAST_ROWS = 100_000
_LEAST, _MOST = -(1 << 63), 1 << 63


@dataclass
class Bucket:
    """What lies from one boundary to the next."""

    bytes: int
    rows: int
    least: int
    most: int


def _histogram(keys: DataFrame, column: str, cuts: list[int]) -> list[Bucket]:
    """The buckets between boundaries, in order; a row belongs to the bucket of the last boundary that isn't over its key. One row a bucket and task is shuffled, one a bucket reaches the driver."""
    bounds = np.array(cuts, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(bounds) + 1
        sums, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        for batch in batches:
            key, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = np.searchsorted(bounds, key, "right")
            np.add.at(sums, at, size)
            rows += np.bincount(at, minlength=n)
            np.minimum.at(least, at, key)
            np.maximum.at(most, at, key)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (np.arange(n), sums, rows, least, most)], ["bucket", "bytes", "rows", "least", "most"])

    counted = keys.select(column, "size").mapInArrow(run, "bucket long, bytes long, rows long, least long, most long")
    sums = counted.groupBy("bucket").agg(F.sum("bytes"), F.sum("rows"), F.min("least"), F.max("most")).collect()
    found = {r[0]: Bucket(*r[1:]) for r in sums}
    return [found.get(i, Bucket(0, 0, 0, 0)) for i in range(len(cuts) + 1)]


@dataclass
class Splitter:
    """The search for one boundary: it is at `low` (with `below_low` bytes below it) or after, and at `high` or before."""

    due: Fraction
    low: int
    high: int
    below_low: int
    below_high: int
    inside: Bucket

    def settled(self, tolerance: Fraction) -> bool:
        near = min(abs(self.due - self.below_low), abs(self.due - self.below_high)) <= tolerance
        return near or self.inside.rows <= 1 or self.inside.least == self.inside.most

    def best(self) -> tuple[int, Fraction]:
        """(boundary, what is wrong with it): the nearer one of both."""
        low, high = abs(self.due - self.below_low), abs(self.due - self.below_high)
        return (self.low, low) if low <= high else (self.high, high)

    def probes(self, n: int) -> list[int]:
        """Both ends, and keys in reach, all the same distance apart."""
        first, last = max(self.low, self.inside.least), min(self.high, self.inside.most)
        return sorted({first + (last - first) * i // (n + 1) for i in range(1, n + 2)} | {self.low, self.high})


def _refined(count: Callable[[list[int]], list[Bucket]], dues: list[Fraction], whole: Bucket, tolerance: Fraction, probes: int) -> list[Splitter]:
    """Splitters of keys in `whole`, each with the closest boundaries around what is due."""
    splitters = [Splitter(due, _LEAST, _MOST, 0, whole.bytes, whole) for due in dues]
    while open_ := [s for s in splitters if not s.settled(tolerance)]:
        cuts = sorted(set().union(*(s.probes(probes) for s in open_)) - {_LEAST, _MOST})
        buckets = count(cuts)
        below = np.cumsum([0] + [b.bytes for b in buckets]).tolist()
        edges = [_LEAST, *cuts, _MOST]
        for s in open_:
            # The last bucket that begins at or under what is due and within reach.
            at = max(0, int(np.searchsorted(below[1:], float(s.due), "left")))
            at = min(at, len(buckets) - 1)
            while at and below[at] > s.due:
                at -= 1
            while at < len(buckets) - 1 and below[at + 1] < s.due:
                at += 1
            s.low, s.high, s.below_low, s.below_high, s.inside = edges[at], edges[at + 1], below[at], below[at + 1], buckets[at]
    return splitters


def splitters(keys: DataFrame, shards: int, tolerance: Fraction = TOLERANCE, whole_group: Fraction = WHOLE_GROUP, probes: int = PROBES) -> tuple[list[tuple[int, int]], int]:
    """(boundaries, all bytes) for keys(group, own, size): a row is behind a boundary if its (group, own) isn't under it. Runs a Spark job a round."""
    total = keys.agg(F.sum("size"), F.count("*"), F.min("group"), F.max("group"), F.max("size")).first()
    if not total[1]:
        return [], 0
    whole, largest = Bucket(*total[:4]), total[4]
    share = Fraction(whole.bytes, shards)
    found = _refined(lambda cuts: _histogram(keys, "group", cuts), [share * i for i in range(1, shards)], whole, tolerance * share, probes)
    bounds = []
    for s in found:
        at, wrong = s.best()
        if wrong > max(whole_group * share, Fraction(largest, 2)) and s.inside.rows > 1 and s.inside.least == s.inside.most:
            # One group of equal texts lies across the splitter and is too heavy to stay whole.
            group = s.inside.least
            own = keys.where(F.col("group") == group)
            edge = own.agg(F.min("own"), F.max("own")).first()
            (t,) = _refined(lambda cuts: _histogram(own, "own", cuts), [s.due - s.below_low], Bucket(s.inside.bytes, s.inside.rows, *edge), tolerance * share, probes)
            place, _ = t.best()
            bounds.append((group, place) if place < _MOST else (group + 1, _LEAST))
        else:
            # No key lies from the low boundary to the least one inside, nor from the greatest one inside to the high boundary.
            bounds.append((at, _LEAST))
    return sorted(bounds), whole.bytes


def _shard(bounds: list[tuple[int, int]]) -> Column:
    """How many boundaries aren't over the row."""
    out = F.lit(0)
    for group, own in bounds:
        if group >= _MOST:
            continue
        behind = F.col("group") > group
        out = out + (behind | ((F.col("group") == group) & (F.col("own") >= own))).cast("int")
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", tolerance: Fraction = TOLERANCE) -> DataFrame:
    """Each row once: key, text, size (UTF-8 bytes and 1), text_crc32, law ("bytes"), shard, slot (from 0 in each shard, without gaps) and grown_shard (null: another number of shards moves any row).

    The shards' sizes are as near to equal as the documents allow: the bytes below
    each boundary differ from their due by `tolerance` of a share, or by half the
    document that lies across. Equal texts stay in one shard unless that costs more
    than a hundredth of a share (or half the largest document); a heavier group is cut
    between ids. Rows with equal id and text can't be told apart, and stay together.
    A null text counts as empty (and as equal to it), a null id as an id; a text of
    any length counts whole; an empty table gives an empty result; other columns
    don't matter. Within a shard, slots go by block, then by the keys' order. Runs
    Spark jobs when it is called, and writes keys (24 bytes a row) to the shared folder.
    """
    bytes_ = F.coalesce(F.col(text), F.lit(""))
    source = require(docs, key, text).select(
        F.col(key).alias("id"), F.col(text).alias("body"), F.xxhash64(bytes_).alias("group"), F.xxhash64(F.col(key)).alias("own"),
        (F.octet_length(bytes_) + 1).cast("long").alias("size"), F.crc32(bytes_).alias("crc"),
    )
    keys = written(source.select("group", "own", "size"), "keys")
    bounds, total = splitters(keys, shards, tolerance)
    blocks = max(1, -(-total // (shards * BLOCK)))
    placed = lambda df: df.withColumn("shard", _shard(bounds)).withColumn("block", F.pmod(F.xxhash64("own", "group"), F.lit(blocks)).cast("int"))
    counts = placed(keys).groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = F.broadcast(starts) if shards * blocks <= BROADCAST_ROWS else starts
    order = Window.partitionBy("shard", "block").orderBy("group", "own")
    rows = placed(source).withColumn("nth", F.row_number().over(order)).join(starts, ["shard", "block"])
    slot = (F.col("start") + F.col("nth") - 1).alias("slot")
    return rows.select(F.col("id").alias(key), F.col("body").alias(text), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))
