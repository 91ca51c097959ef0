"""Quality classifier: kernel ridge by random Fourier features, calibrated by isotonic regression.

Statistics of each whole text (shape of words, lines, symbols, repetition) are
computed once and kept as a table. Random Fourier features of the standardised
statistics approximate a Gaussian kernel; each partition sums its rows' normal
equations, and only these sums, of fixed size and number, reach the driver. A part
of the labelled rows is held back from them: their raw scores, counted in bins,
give an isotonic map from raw score to the chance of label 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, SPACED, U64, Rolling, mix, per_document, require, text_blocks, word_bounds, word_counts, written
from .quality_rules import measures

FEATURES = 256
RIDGE = 1e-3
#: Standard deviations of the random frequencies times the root of the number of statistics.
WIDTH = 0.7
#: Partitions in which the normal equations are summed; as many sums reach the driver.
PARTS = 32
#: Bins of raw scores for the calibration, and their range.
BINS, LOW, HIGH = 512, -2.0, 2.0
#: Of the labelled rows one in so many serves the calibration alone.
FOLDS = 5
#: Rows that each pool of the calibration has more than it counts.
PRIOR = 1.0

_CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": b"0123456789",
    "stop": b".,;:",
    "loud": b"!?",
    "bar": b"|",
    "mark": b"#*$%&<>",
    "other": b"\"'()[]{}=+-_/\\@~^`",
}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}
_TABLES["high"] = np.arange(256) >= 128


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each document of a block."""
    n = len(offsets) - 1
    m = measures(data, offsets, (5,))
    starts, ends, of = word_bounds(data, offsets, SPACED)
    doc_of = np.repeat(np.arange(n), np.diff(offsets))
    size, words = np.maximum(np.diff(offsets), 1), np.maximum(m["n_words"], 1)
    columns = [np.log1p(np.diff(offsets)), np.log1p(m["n_words"])]
    columns += [np.bincount(doc_of, table[data], n) / size for table in _TABLES.values()]
    length = ends - starts
    mean = np.bincount(of, length, n) / words
    columns += [mean, np.sqrt(np.maximum(np.bincount(of, length.astype(float) ** 2, n) / words - mean**2, 0))]
    hashes = Rolling(BYTE_CODES[data]).hash(starts, ends)
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1]))
    columns.append(word_counts(of[same], n) / words)
    order = np.argsort(mix(hashes ^ mix(of.astype(U64) + U64(1))), kind="stable")
    keyed = mix(hashes ^ mix(of.astype(U64) + U64(1)))[order]
    fresh = np.concatenate([[True], keyed[1:] != keyed[:-1]])[: len(keyed)]
    columns.append(np.log1p(word_counts(of[order][fresh], n)) - np.log1p(m["n_words"]))
    last = data[ends - 1] if len(ends) else data[:0]
    first = data[starts] if len(starts) else data[:0]
    capital = _TABLES["upper"][first]
    columns += [np.bincount(of, capital, n) / words, np.bincount(of, _TABLES["stop"][last], n) / words, np.bincount(of, _TABLES["loud"][last] | _TABLES["mark"][last], n) / words]
    shout = (length > 1) & _TABLES["upper"][data[np.minimum(starts + 1, max(len(data) - 1, 0))]] if len(starts) else capital
    columns.append(np.bincount(of, shout, n) / words)
    lines = per_document(doc_of, data == 10, n) + 1
    columns += [np.log1p(words / lines), m["n_repeat_words"] / words, m["dup_chars_5"] / np.maximum(m["word_chars"], 1), m["dup_line_chars"] / np.maximum(m["n_chars"], 1), m["n_symbols"] / words]
    return np.stack(columns, 1).astype(np.float32)


N_STATISTICS = statistics(np.zeros(0, np.uint8), np.array([0, 0])).shape[1]


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ()) -> DataFrame:
    """(key, further columns, statistics): the statistics as 32-bit floats in a binary column."""
    names = [key, *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data, offsets in text_blocks(batch.column(len(names))):
                rows = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(first, n) for i in range(len(names))], pa.array([r.tobytes() for r in rows], pa.binary())], [*names, "statistics"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return require(docs, *names, text).mapInArrow(run, schema + ", statistics binary")


class Kernel:
    """Standardised statistics and their random Fourier features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int):
        random = np.random.Generator(np.random.PCG64(11))
        self.mean, self.scale = mean, scale
        self.frequencies = random.normal(0, WIDTH / np.sqrt(len(mean)), (len(mean), features))
        self.phases = random.uniform(0, 2 * np.pi, features)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -5, 5)
        return np.concatenate([np.ones((len(z), 1)), z / np.sqrt(z.shape[1]), np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)], 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), N_STATISTICS).astype(float)


def _summed(df: DataFrame, label: str, of_rows) -> np.ndarray | None:
    """The sum over all rows of of_rows(statistics, labels), an array; one partial sum for each partition reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = of_rows(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = [np.frombuffer(r.part) for r in df.select("statistics", label).mapInArrow(run, "part binary").collect()]
    return np.sum(parts, axis=0) if parts else None


def isotonic(counts: list[tuple[int, float, float]], prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over (bin, ones, rows): places of raw scores and their values, which rise.

    A pool's value is its share of ones with `prior` rows more at the share of all;
    between the pools' centres (of rows) values are interpolated, and beyond the
    outermost they go half the way to 0 or 1, so that scores still rank within a pool.
    """
    share = sum(c[1] for c in counts) / sum(c[2] for c in counts)
    centre = lambda b: LOW + (b + 0.5) * (HIGH - LOW) / BINS
    pools: list[list[float]] = []  # ones, rows, sum of centres
    for b, ones, rows in sorted(counts):
        pools.append([ones, rows, rows * centre(b)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    x, y = [p[2] / p[1] for p in pools], [(p[0] + prior * share) / (p[1] + prior) for p in pools]
    y = np.maximum.accumulate(y).tolist()  # small pools lean more to the share of all
    return np.array([min(LOW, x[0]) - 1, *x, max(HIGH, x[-1]) + 1]), np.array([y[0] / 2, *y, (1 + y[-1]) / 2])


def fitted(table: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", features: int = FEATURES, ridge: float = RIDGE) -> Callable[[np.ndarray], np.ndarray]:
    """A function from statistics to scores, learnt from a table of `document_statistics` and the labels of rows that aren't held out."""
    marks = labels.where(F.col(label).isNotNull() & ~held_out(key)).select(F.col(key), (F.col(label) >= 1).cast("int").alias("mark"))
    usable = table.join(marks, key).withColumn("fold", F.crc32(F.concat(F.lit("fold "), F.col(key).cast("string")).cast("binary")) % FOLDS)
    # Dealt by the key, as equal texts, of which there may be many, have equal statistics.
    usable = written(usable.select(key, "statistics", "mark", "fold").repartition(PARTS, F.xxhash64(key)).drop(key), "labelled")
    fit = usable.where("fold <> 0").coalesce(PARTS)

    moments = _summed(fit, "mark", lambda x, y: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]))
    if moments is None:
        return lambda x: np.full(len(x), 0.5)
    n, d = moments[0], N_STATISTICS
    mean = moments[1 : d + 1] / n
    scale = np.sqrt(np.maximum(moments[d + 1 :] / n - mean**2, 1e-8))
    kernel = Kernel(mean, scale, features)
    size = 1 + d + features

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = kernel(x)
        return np.concatenate([(k.T @ k).ravel(), k.T @ (2 * y - 1)])

    sums = _summed(fit, "mark", equations)
    weights = np.linalg.solve(sums[: size * size].reshape(size, size) + ridge * n * np.eye(size), sums[size * size :])
    raw = lambda x: kernel(x) @ weights

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.clip((raw(_matrix(batch.column(0))) - LOW) * BINS / (HIGH - LOW), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], ["bin", "mark"])

    counts = usable.where("fold = 0").select("statistics", "mark").mapInArrow(binned, "bin int, mark int").groupBy("bin").agg(F.sum("mark").alias("ones"), F.count("*").alias("rows")).collect()
    if not counts:
        return lambda x: np.clip((raw(x) + 1) / 2, 0, 1)
    at, value = isotonic([(r.bin, float(r.ones), float(r.rows)) for r in counts])
    return lambda x: np.interp(raw(x), at, value)


def held_out(key: str) -> Column:
    """Whether crc32 of the key as text leaves 1 divided by 3 (a null key: false)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", features: int = FEATURES, ridge: float = RIDGE) -> DataFrame:
    """One row a document: key, held_out, score (0 to 1), predicted (1 if the score is 0.5 or more).

    held_out: crc32 of the key as text leaves 1 divided by 3; such rows' labels
    are never read. Of labels with equal keys all count; null labels don't. An
    empty or null text is scored like any other. Without any usable label every
    score is 0.5; without calibration rows the raw score is cut to 0..1; with one
    class only, scores lie on its side of 0.5. Rows with a null key are scored, not
    held out, and never learnt from. Repeated rows get equal scores; very long texts
    are scored whole. An empty table gives an empty result; other columns don't
    matter. Runs Spark jobs when it is called, and writes tables to the shared folder.
    """
    table = written(document_statistics(docs, key, text), "statistics")
    predict = fitted(table, labels, key, label, features, ridge)
    kind = docs.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = predict(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [key, "held_out", "score", "predicted"])

    return table.select(key, "statistics", held_out(key).alias("held_out")).mapInArrow(score, f"`{key}` {kind}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of docs, with all columns, whose score is `least` or more. Texts aren't shuffled: statistics are computed again as rows pass."""
    predict = fitted(document_statistics(docs, key, text), labels, key, label)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data, offsets in text_blocks(batch.column(at)):
                yield batch.slice(first, n).filter(pa.array(predict(statistics(data, offsets).astype(float)) >= least))

    return docs.mapInArrow(run, docs.schema)
