"""Embeddings and nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, counts, tokenize
from ..sources.shared import merged, spread, written

DIMENSIONS = 64
RANKED = 9
#: Vectors in a block, and bytes of query blocks that are broadcast; more are joined without.
BLOCK, BROADCAST_BYTES = 4096, 8 << 20
#: Vectors that a level of centres is fitted on at most for each centre, and rounds of fitting.
SAMPLE, ROUNDS = 32, 8
#: Vectors of a leaf in a large table (in a small one, the root of their number), and the most cells of the first level.
LEAF, CELLS = 2048, 1024
#: Blocks of a leaf that meet a query block under one key; a leaf with more is dealt over several keys.
BLOCKS_A_KEY = 16
#: Cells whose leaves a query ranks; queries of a sample whose exact neighbours tell how many leaves to look into; share of these neighbours that must be covered.
NEAR_CELLS, ASKED, COVERED = 32, 64, 0.95


def hash_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Counts of tokens in buckets by their hash, scaled to unit length; all 0 without tokens. Worked out within the row: each bucket is listed once more than it occurs, so that the runs of the sorted list are all buckets in their order."""
    bucket = lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dimensions).cast("int")
    listed = F.concat(F.transform(tokenize(text), bucket), F.sequence(F.lit(0), F.lit(dimensions - 1)))
    found = F.transform(counts(listed), lambda n: (n - 1).cast("double"))

    def scaled(c: Column) -> Column:
        norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
        return bound(norm, lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))

    return bound(found, scaled)


def hash_embeddings(df: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, embedding) of each row."""
    return df.select(key, hash_embedding(F.col(text), dimensions).alias("embedding"))


def embedded(df: DataFrame, key: str, text: str, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """With a column `embedding`: a ready one is kept, else `embed` (a pandas UDF around a model, say) or the hashing default makes it."""
    return df if "embedding" in df.columns else df.withColumn("embedding", (embed or hash_embedding)(F.col(text)))


def embedded_once(new: DataFrame, stored: DataFrame, text: str = "document", embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """`new` with the `embedding` that `stored` has for an equal text (by its hash); each other text goes to the model once. Runs Spark jobs when it is called, and writes the texts' embeddings to the shared folder."""
    key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    texts = new.select(key.alias("text_key"), F.coalesce(F.col(text), F.lit("")).alias("text_")).groupBy("text_key").agg(F.first("text_").alias("text_"))
    known = stored.where("embedding is not null").select(key.alias("text_key"), "embedding").join(texts.select("text_key"), "text_key", "left_semi")
    known = written(known.groupBy("text_key").agg(F.first("embedding").alias("embedding")), "known")
    unseen = texts.join(known, "text_key", "left_anti").select("text_key", (embed or hash_embedding)(F.col("text_")).alias("embedding"))
    made = written(unseen, "embedded")
    return new.withColumn("text_key", key).join(known.unionByName(made), "text_key").drop("text_key")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix, without Python values."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _blocks(df: DataFrame, names: list[str], prefix: str) -> DataFrame:
    """Rows packed into blocks: a list for each name, and the vectors as one binary matrix. A task's small batches are put together first."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema}

    def block(part: pa.Table) -> pa.RecordBatch:
        columns = [c.combine_chunks() for c in part.columns]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), c) for c in columns[:-1]]
        return pa.RecordBatch.from_arrays([*lists, pa.array([_matrix(columns[-1]).tobytes()], pa.binary())], [*[prefix + n for n in names], prefix + "matrix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= BLOCK:
                whole = pa.Table.from_batches(held)
                for first in range(0, len(whole) - BLOCK + 1, BLOCK):
                    yield block(whole.slice(first, BLOCK))
                held = whole.slice(len(whole) - len(whole) % BLOCK).to_batches()
        if sum(map(len, held)):
            yield block(pa.Table.from_batches(held))

    schema = ", ".join(f"`{prefix}{n}` array<{fields[n]}>" for n in names) + f", {prefix}matrix binary"
    return df.select(*names, "embedding").where("embedding is not null").mapInArrow(run, schema)


def _distances(q: np.ndarray, c: np.ndarray, q_at: np.ndarray, c_at: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows, by differences."""
    out = np.empty(len(q_at))
    for i in range(0, len(q_at), 1 << 16):
        out[i : i + (1 << 16)] = ((c[c_at[i : i + (1 << 16)]] - q[q_at[i : i + (1 << 16)]]) ** 2).sum(axis=1)
    return out


def _best(q: np.ndarray, c: np.ndarray, pages: np.ndarray, places: np.ndarray, candidates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of each query's nearest rows: one matrix product tells which can be among them, and these are ranked by exact differences."""
    c_norm, q_norm = (c**2).sum(axis=1), (q**2).sum(axis=1)
    which, at = [], []
    for first in range(0, len(q), 256):
        rough = c_norm - 2 * (q[first : first + 256] @ c.T) + q_norm[first : first + 256, None]
        if candidates < len(c):
            reach = np.partition(rough, candidates - 1, axis=1)[:, candidates - 1]
        else:
            reach = rough.max(axis=1)
        # Sums of the product err by a share of the norms; whoever may be as near as the last is looked at.
        slack = 1e-9 + 1e-12 * (c_norm.max(initial=0) + q_norm[first : first + 256])
        i, j = np.nonzero(rough <= (reach + 2 * slack)[:, None])
        which.append(i + first)
        at.append(j)
    which, at = np.concatenate(which), np.concatenate(at)
    distance = _distances(q, c, which, at)
    order = np.lexsort((places[at], pages[at], np.round(distance, RANKED), which))
    which, at, distance = which[order], at[order], distance[order]
    nth = np.arange(len(which)) - np.searchsorted(which, which)
    kept = nth < candidates
    return which[kept], at[kept], distance[kept]


_NAMES = ["query_id", "chunk_id", "page_id", "chunk_index"]


def _compared(pairs: DataFrame, kinds: dict[str, str], candidates: int) -> DataFrame:
    """(query_id, chunk_id, page_id, chunk_index, distance): the best of each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                ids, chunk, page, index = (row[n].values for n in ("q_query_id", "c_chunk_id", "c_page_id", "c_chunk_index"))
                q = np.frombuffer(row["q_matrix"].as_buffer()).reshape(len(ids), -1)
                c = np.frombuffer(row["c_matrix"].as_buffer()).reshape(len(chunk), -1)
                which, place, distance = _best(q, c, page.to_numpy(zero_copy_only=False), index.to_numpy(zero_copy_only=False), candidates)
                take = pa.array(place)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), chunk.take(take), page.take(take), index.take(take), pa.array(distance)], [*_NAMES, "distance"])

    return pairs.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in _NAMES) + ", distance double")


def _rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """A task's rows, `most` at a time, so that it never holds more than these and a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for first in range(0, len(batch), most):
            held.append(batch.slice(first, most))
            if sum(map(len, held)) >= most:
                whole = pa.Table.from_batches(held)
                yield whole.slice(0, most)
                held = whole.slice(most).to_batches()
    if sum(map(len, held)):
        yield pa.Table.from_batches(held)


def _found(ids: pa.Array, q: np.ndarray, part: pa.Table, candidates: int) -> pa.RecordBatch:
    """The best of these rows for each query."""
    column = lambda n: part.column(n).combine_chunks()
    which, place, distance = _best(q, _matrix(column("embedding")), *(column(n).to_numpy(zero_copy_only=False) for n in ("page_id", "chunk_index")), candidates)
    take = pa.array(place)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(which)), *(column(n).take(take) for n in _NAMES[1:]), pa.array(distance)], [*_NAMES, "distance"])


def _found_schema(kinds: dict[str, str]) -> str:
    return ", ".join(f"{n} {kinds[n]}" for n in _NAMES) + ", distance double"


def _led(leaders: DataFrame, rows: DataFrame, lead: Callable, use: Callable, schema: str) -> DataFrame:
    """use(lead(leaders of a cell), rows of it), some rows at a time. Each cell's leaders come before its rows in one sorted partition, so a task holds one cell's leaders and one batch of plain rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, state = None, [], None
        for batch in batches:
            cell, follows = batch.column("cell").to_numpy(), batch.column("follows").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(follows) != 0)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if not follows[a]:
                    if cell[a] != current:
                        current, held, state = cell[a], [], None
                    held.append(batch.slice(a, b - a))
                elif cell[a] == current:
                    state = lead(pa.Table.from_batches(held)) if state is None else state
                    yield use(state, pa.Table.from_batches([batch.slice(a, b - a)]))

    both = leaders.withColumn("follows", F.lit(0)).unionByName(rows.withColumn("follows", F.lit(1)), allowMissingColumns=True)
    return both.repartition("cell").sortWithinPartitions("cell", "follows").mapInArrow(run, schema)


def _ranked(found: DataFrame, candidates: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.round("distance", RANKED), "page_id", "chunk_index")
    return found.withColumn("vec_rank", F.row_number().over(best)).where(F.col("vec_rank") <= candidates)


def nearest(chunks: DataFrame, queries: DataFrame, candidates: int = 20) -> DataFrame:
    """(query_id, chunk_id, page_id, chunk_index, distance, vec_rank): the `candidates` nearest by squared Euclidean distance, exactly.

    Blocks of queries meet all blocks of chunks (the exact answer needs every pair);
    each pair of blocks yields at most `candidates` rows a query, and a window picks
    the best of all. The queries are written and weighed when this is called; if they
    are small (BROADCAST_BYTES), each task has them and passes over its chunks a block
    at a time, so that it holds one block however many there are. For many queries over many chunks see `nearest_probed`.
    """
    kinds = {f.name: f.dataType.simpleString() for f in (*chunks.schema, *queries.schema)}
    asked = written(queries.where("embedding is not null").select("query_id", "embedding"), "queries")
    weight = asked.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0)) * 8).first()[0]
    if weight <= BROADCAST_BYTES:
        rows = asked.toArrow()
        ids = rows.column("query_id").combine_chunks()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if len(ids):
                q = _matrix(rows.column("embedding").combine_chunks())
                for part in _rows(batches, BLOCK):
                    yield _found(ids, q, part, candidates)

        found = chunks.select(*_NAMES[1:], "embedding").where("embedding is not null").mapInArrow(run, _found_schema(kinds))
        return _ranked(found, candidates)
    pairs = _blocks(chunks, _NAMES[1:], "c_").crossJoin(_blocks(asked, ["query_id"], "q_"))
    return _ranked(_compared(pairs, kinds, candidates), candidates)


#: Entries other than 0 that a vector has on average at most for the join by shared dimensions to be worth it.
SPARSE = 24
#: Sets of entries that a vector may lose (see `_candidates`) up to which each gives a key.
SETS = 1024
_SLACK = 1e-9


def _shared_keys(order: list[int], dot: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(vector, embedding) to (vector, embedding, norm, key), norm being the squared length: two unit vectors whose product is `dot` or more have a key in common.

    Dimensions are looked at in `order`. Of a pair that shares three dimensions or more,
    the first three lie in either vector's prefix: if at most two of a vector's entries
    before some place are shared, the product can't exceed the root of the two largest
    squares there and all squares behind it, and the prefix ends where that is under
    `dot`. A pair that shares fewer needs two entries in either vector that make up
    `dot`; such vectors also have the single dimensions of the prefix behind which less
    than `dot` is left. A vector of zeros is near to zeros alone.
    """
    limit = dot * dot - _SLACK
    many = len(order)

    def keys(x: np.ndarray) -> Iterator[int]:
        some = np.flatnonzero(x)
        if not len(some):
            yield -1
            return
        square = x[some] ** 2
        left = 1 - np.cumsum(square)
        top = np.sort(square)[::-1]
        end, largest, second = len(some), 0.0, 0.0
        for k, v in enumerate(square):
            largest, second = (v, largest) if v > largest else (largest, max(second, v))
            if largest + second + left[k] < limit:
                end = k + 1
                break
        for a, b, c in combinations(some[:end].tolist(), 3):
            yield ((a * many + b) * many + c) * 2
        if top[:2].sum() >= limit:
            for k, d in enumerate(some.tolist()):
                yield d * 2 + 1
                if left[k] < limit:
                    break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(1))
                own = [list(keys(v)) for v in x[:, order]]
                at = np.repeat(np.arange(len(batch)), [len(k) for k in own])
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array((x**2).sum(axis=1)[at]), pa.array([k for v in own for k in v], pa.int64())], ["vector", "embedding", "norm", "key"])

    return run


def _sets(square: np.ndarray, lost: float) -> tuple[np.ndarray, np.ndarray]:
    """(how many entries each row can lose at most, how many sets of entries that is at most), of squares of the entries that aren't 0."""
    most = (np.cumsum(np.sort(square, axis=1), axis=1) <= lost).sum(axis=1)
    ways = np.cumsum([float(comb(square.shape[1], k)) for k in range(square.shape[1] + 1)])
    return most, ways[most]


def _by_size(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, places, squares) of the entries that aren't 0, for rows that have equally many."""
    sizes = (x != 0).sum(axis=1)
    for n in np.unique(sizes):
        of = np.flatnonzero(sizes == n)
        for rows in np.split(of, range(1024, len(of), 1024)):
            places = np.nonzero(x[rows])[1].reshape(len(rows), n)
            yield rows, places, np.take_along_axis(x[rows], places, 1) ** 2


def _long(lost: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The (vector, embedding) that have more than SETS sets of entries to lose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                long = [rows[_sets(square, lost)[1] > SETS] for rows, _, square in _by_size(_matrix(batch.column(1)))]
                yield batch.take(pa.array(np.concatenate(long)))

    return run


def _kept_keys(lost: float, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(vector, embedding) to (vector, key, kept): a key for each set of dimensions that is left of a vector when entries with squares of `lost` at most in all are taken away, and the sum of the squares that are left. Vectors with more than SETS of them have none."""
    code = np.random.Generator(np.random.PCG64(7)).integers(-(2**63), 2**63 - 1, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            vector = batch.column(0).to_numpy()
            for rows, places, square in _by_size(_matrix(batch.column(1))):
                most, ways = _sets(square, lost)
                short = ways <= SETS
                # Zeros are near to zeros alone, and have lost nothing.
                whole, codes = square.sum(axis=1) if places.shape[1] else np.ones(len(rows)), code[places]
                for k in range(most[short].max(initial=0) + 1):
                    some = np.flatnonzero(short & (most >= k))
                    away = np.array(list(combinations(range(places.shape[1]), k)), np.int64).reshape(comb(places.shape[1], k), k)
                    mass = square[some][:, away].sum(axis=2)
                    i, j = np.nonzero(mass <= lost)
                    key = codes[some].sum(axis=1)[i] - codes[some[i][:, None], away[j]].sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(vector[rows[some[i]]]), pa.array(key), pa.array(whole[some[i]] - mass[i, j])], ["vector", "key", "kept"])

    return run


def _candidates(ours: DataFrame, theirs: DataFrame, dot: float, size: int) -> DataFrame:
    """(asked, vector), each once: pairs of vectors (vector, embedding; unit ones, or zeros) that hold all pairs whose product is `dot` or more.

    The dimensions that two such vectors share hold so much of either that the product
    of both parts' squared lengths is dot * dot or more (Cauchy and Schwarz). What a
    vector has besides is therefore a small set of its entries; each set that it may
    lose gives a key, of what is left, and the two meet at the key of what they share.
    The few vectors of many entries that could lose more than SETS sets meet all
    others by dimensions that both must have (`_shared_keys`). Runs Spark jobs.
    """
    limit = dot * dot - 10 * _SLACK
    keyed = lambda df: df.select("vector", "embedding").mapInArrow(_kept_keys(1 - limit, size), "vector long, key long, kept double")
    asked = keyed(ours).select(F.col("vector").alias("asked"), "key", F.col("kept").alias("own"))
    pairs = merged(asked, keyed(theirs), "key").where(F.col("own") * F.col("kept") >= limit).select("asked", "vector")
    long = lambda df, name: written(df.select("vector", "embedding").mapInArrow(_long(1 - limit), "vector long, embedding array<double>"), name)
    our_long, their_long = long(ours, "long"), long(theirs, "long")
    sides = [(a, b) for some, a, b in ((our_long, our_long, theirs), (their_long, ours, their_long)) if not some.isEmpty()]
    if sides:
        rare = theirs.select(F.posexplode("embedding").alias("at", "x")).where("x <> 0").groupBy("at").count().collect()  # a row a dimension
        often = dict(rare)
        run = _shared_keys(sorted(range(size), key=lambda d: (often.get(d, 0), d)), dot)
        shared = lambda df: df.select("vector", "embedding").mapInArrow(run, "vector long, embedding array<double>, norm double, key long").select("vector", "key")
        for a, b in sides:
            pairs = pairs.union(merged(shared(a).withColumnRenamed("vector", "asked"), shared(b), "key").select("asked", "vector"))
    return pairs.distinct()


def nearest_within(chunks: DataFrame, queries: DataFrame, threshold: float, candidates: int) -> DataFrame:
    """Like `nearest`, but only what lies within the threshold (by the rounded distance); exact, and for sparse vectors of unit length (hash embeddings) or of zeros without a product of all with all.

    Equal vectors are looked at once, whoever has them; of a vector's chunks the first
    `candidates` can be among the nearest. Vectors then meet by the dimensions that two
    within the threshold share (see `_candidates`), and the distance decides. Other
    vectors (dense ones of a model, say, or those not of unit length) are compared by
    `nearest`. Runs Spark jobs when it is called, and writes both sides' embeddings (so
    that none is made twice), the distinct vectors (with their chunks) and the pairs
    within the threshold to the shared folder. None of these is broadcast.
    """
    whole = lambda df: df.where("embedding is not null").withColumn("embedding", F.col("embedding").cast("array<double>"))
    stored, asked = written(whole(chunks.select(*_NAMES[1:], "embedding")), "chunks"), written(whole(queries.select("query_id", "embedding")), "queries")
    first = Window.partitionBy("embedding").orderBy("page_id", "chunk_index", "chunk_id")
    members = stored.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= candidates).drop("nth")
    held = members.groupBy("embedding").agg(F.collect_list(F.struct(*_NAMES[1:])).alias("members"))  # `candidates` each at most
    numbered = lambda df, name: written(df.withColumn("vector", F.monotonically_increasing_id()), name)
    theirs, ours = numbered(held, "vectors"), numbered(asked.select("embedding").distinct(), "asked")
    both = theirs.drop("members").unionByName(ours)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    entries = F.size(F.filter("embedding", lambda x: x != 0))
    odd = F.count_if(~((F.abs(norm - 1) < _SLACK) | (norm == 0)) | norm.isNull())
    about = both.agg(odd.alias("odd"), F.avg(entries).alias("entries"), F.max(F.size("embedding")).alias("size"), F.min(F.size("embedding")).alias("least")).first()
    dot = 1 - (threshold + 1e-9) / 2
    if about.odd or about.size != about.least or about.entries is None or about.entries > SPARSE or dot <= 0.5:
        return nearest(stored, asked, candidates).where(F.round("distance", RANKED) <= threshold)
    # The distance by the product over the few entries that aren't 0.
    sparse = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("at"), x.alias("x"))), lambda e: e["x"] != 0)
    pairs = _candidates(spread(ours), spread(theirs), dot, about.size)
    pairs = merged(pairs, ours.select(F.col("vector").alias("asked"), sparse.alias("entries"), norm.alias("own")), "asked")
    pairs = merged(pairs, theirs.select("vector", "embedding", norm.alias("norm")), "vector")
    product = F.aggregate("entries", F.lit(0.0), lambda s, e: s + e["x"] * F.get(F.col("embedding"), e["at"]))
    near = pairs.select("asked", "vector", F.greatest(F.lit(0.0), F.col("own") + F.col("norm") - 2 * product).alias("distance"))
    near = written(near.where(F.round("distance", RANKED) <= threshold), "near")
    named = merged(near, theirs.select("vector", F.inline("members")), "vector")
    best = Window.partitionBy("asked").orderBy(F.round("distance", RANKED), "page_id", "chunk_index")
    ranked = named.withColumn("vec_rank", F.row_number().over(best)).where(F.col("vec_rank") <= candidates)
    found = merged(merged(asked, ours, "embedding").select("query_id", F.col("vector").alias("asked")), ranked, "asked")
    return found.select(*_NAMES, "distance", "vec_rank")


def _means(x: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by k-means, begun at vectors all over the list."""
    centres = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)]
    for _ in range(rounds):
        of = _nearest_cells(x, centres, 1)[:, 0]
        count = np.bincount(of, minlength=len(centres))
        sums = np.stack([np.bincount(of, x[:, k], len(centres)) for k in range(x.shape[1])], 1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def _nearest_cells(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    rough = (centres**2).sum(axis=1) - 2 * (x @ centres.T)
    if n < len(centres):
        some = np.argpartition(rough, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(rough, some, 1), axis=1, kind="stable"), 1)
    return np.argsort(rough, axis=1, kind="stable")


def _celled(df: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """df with `cell`, a row for each of the `n` nearest cells."""
    names = [c for c in df.columns if c != "cell"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cells = _nearest_cells(_matrix(batch.column("embedding")), centres, n)
                rows = batch.take(pa.array(np.repeat(np.arange(len(batch)), cells.shape[1])))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cells.ravel().astype(np.int64))], [*names, "cell"])

    return df.select(*names).where("embedding is not null").mapInArrow(run, f"{schema}, cell long")


def _cell_blocks(df: DataFrame, names: list[str], prefix: str) -> DataFrame:
    """(cell, lists, matrix): each task's rows of a cell in blocks."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blocks() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            cell = whole.column("cell").to_numpy()
            order = np.argsort(cell, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                for i in range(0, len(rows), BLOCK):
                    part = whole.take(pa.array(rows[i : i + BLOCK]))
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(n).combine_chunks()) for n in names]
                    matrix = _matrix(part.column("embedding").combine_chunks())
                    yield pa.RecordBatch.from_arrays([pa.array(cell[rows[i : i + 1]]), *lists, pa.array([matrix.tobytes()], pa.binary())], ["cell", *[prefix + n for n in names], prefix + "matrix"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= 16 * BLOCK:
                yield from blocks()
                held.clear()
        if sum(map(len, held)):
            yield from blocks()

    schema = "cell long, " + ", ".join(f"`{prefix}{n}` array<{fields[n]}>" for n in names) + f", {prefix}matrix binary"
    return df.select("cell", *names, "embedding").mapInArrow(run, schema)


@dataclass
class CellTree:
    """Vectors in leaves of cells. centres: of the first level, at most CELLS; leaves(cell, first, centres): of each cell, `first` being the number of its first leaf; placed(chunk_id, page_id, chunk_index, embedding, leaf): every vector; keys(leaf, salts): over how many keys a leaf is dealt; dealt(cell, chunk_id, page_id, chunk_index, embedding): the vectors by key; rows: how many vectors."""

    centres: np.ndarray
    leaves: DataFrame
    placed: DataFrame
    keys: DataFrame
    dealt: DataFrame
    rows: int

    @property
    def blocks(self) -> DataFrame:
        """The vectors of each key in blocks."""
        return _cell_blocks(self.dealt.repartition("cell"), _NAMES[1:], "c_")


def cell_tree(chunks: DataFrame, leaf: int | None = None) -> CellTree | None:
    """Every vector of chunks(chunk_id, page_id, chunk_index, embedding) in a leaf, of which there are as many as the table asks for; None without vectors.

    Both levels' centres are fitted on bounded samples (those with the least hashes of
    their ids: SAMPLE a centre, of all vectors and of each cell). A leaf that holds
    many (copies, say) is dealt over several keys, so that no key grows. Runs Spark
    jobs, and writes the vectors to the shared folder.
    """
    vectors = chunks.where("embedding is not null").select(*_NAMES[1:], "embedding")
    rows = vectors.count()
    if not rows:
        return None
    many = -(-rows // (leaf or max(8, min(LEAF, int(rows**0.5)))))
    top = min(CELLS, int(np.ceil(many**0.5)))
    each = -(-many // top)
    first = vectors.orderBy(F.xxhash64("chunk_id")).limit(SAMPLE * top).select("embedding").toArrow()
    centres = _means(_matrix(first.column(0).combine_chunks()), top)
    celled = written(_celled(vectors, centres, 1), "cells")

    def fit(cell: pa.Table) -> pa.Table:
        number = cell.column("cell")[0].as_py()
        found = _means(_matrix(cell.column("embedding").combine_chunks()), each)
        return pa.table({"cell": pa.array([number]), "first": pa.array([number * each]), "centres": pa.array([found.tobytes()], pa.binary())})

    by_hash = Window.partitionBy("cell").orderBy(F.xxhash64("chunk_id"), "chunk_id")
    sample = celled.withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= SAMPLE * each).select("cell", "embedding")
    leaves = written(sample.groupBy("cell").applyInArrow(fit, "cell long, first long, centres binary"), "leaves")

    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}

    def fitted(cell: pa.Table) -> tuple[int, np.ndarray]:
        return cell.column("first")[0].as_py(), np.frombuffer(cell.column("centres")[0].as_buffer())

    def place(state: tuple[int, np.ndarray], part: pa.Table) -> pa.RecordBatch:
        x = _matrix(part.column("embedding").combine_chunks())
        at = _nearest_cells(x, state[1].reshape(-1, x.shape[1]), 1)[:, 0]
        embedding = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([*(part.column(n).combine_chunks() for n in _NAMES[1:]), embedding, pa.array(at + state[0])], [*_NAMES[1:], "embedding", "leaf"])

    schema = ", ".join(f"{n} {kinds[n]}" for n in _NAMES[1:]) + ", embedding array<double>, leaf long"
    placed = written(_led(leaves, celled, fitted, place, schema), "placed")
    keys = written(placed.groupBy("leaf").agg(F.ceil(F.count("*") / (BLOCK * BLOCKS_A_KEY)).cast("int").alias("salts")), "keys")
    salted = placed.join(keys, "leaf").withColumn("cell", _key(F.col("leaf"), F.pmod(F.xxhash64("chunk_id"), F.col("salts"))))
    dealt = written(salted.select("cell", *_NAMES[1:], "embedding"), "dealt")
    return CellTree(centres, leaves, placed, keys, dealt, rows)


def _key(leaf: Column, salt: Column) -> Column:
    return F.shiftleft(leaf, 20) + salt


def _leaves(tree: CellTree, queries: DataFrame, leaves: int | None, cells: int) -> DataFrame:
    """(query_id, leaf, place): the nearest leaves of the nearest cells of each query, in order; all of them if `leaves` is None."""
    asked = _cell_blocks(_celled(queries.select("query_id", "embedding"), tree.centres, min(cells, len(tree.centres))), ["query_id"], "q_")
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                ids, first = row["q_query_id"].values, row["first"].as_py()
                q = np.frombuffer(row["q_matrix"].as_buffer()).reshape(len(ids), -1)
                centres = np.frombuffer(row["centres"].as_buffer()).reshape(-1, q.shape[1])
                at = _nearest_cells(q, centres, len(centres) if leaves is None else min(leaves, len(centres)))
                gap = np.take_along_axis((centres**2).sum(axis=1) - 2 * (q @ centres.T), at, 1)  # less the query's own length
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(q)), at.shape[1]))), pa.array(at.ravel() + first), pa.array(gap.ravel())], ["query_id", "leaf", "gap"])

    near = asked.join(tree.leaves, "cell").mapInArrow(run, f"query_id {kind}, leaf long, gap double")
    found = near.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("gap", "leaf")))
    return (found if leaves is None else found.where(F.col("place") <= leaves)).select("query_id", "leaf", "place")


def leaves_to_probe(tree: CellTree, queries: DataFrame, candidates: int = 20, covered: float = COVERED, asked: int = ASKED) -> tuple[int, int]:
    """(leaves, cells) that a query has to look into so that `covered` of the neighbours are found, measured: `asked` of the queries (a bounded sample) are answered exactly, in one pass over the vectors, and the places of their neighbours' leaves tell. Runs Spark jobs."""
    sample = written(queries.where("embedding is not null").orderBy(F.xxhash64("query_id")).limit(asked), "asked")
    exact = nearest(tree.placed, sample, candidates).select("query_id", "chunk_id")
    hits = written(exact.join(tree.placed.select("chunk_id", "leaf"), "chunk_id"), "hits")  # `asked` times `candidates` rows at most, but for repeated ids
    total, cells = hits.count(), min(NEAR_CELLS, len(tree.centres))
    while True:
        ranked = hits.join(_leaves(tree, sample, None, cells), ["query_id", "leaf"]).select("place")
        wanted = int(np.ceil(covered * total))
        if ranked.count() >= wanted or cells >= len(tree.centres):
            break
        cells = min(2 * cells, len(tree.centres))
    places = ranked.groupBy("place").count().orderBy("place").collect()  # as many as there are hits at most
    seen = 0
    for place, n in places:
        seen += n
        if seen >= wanted:
            return place, cells
    return 1, cells


def nearest_probed(chunks: DataFrame, queries: DataFrame, candidates: int = 20, tree: CellTree | None = None, leaves: int | None = None, covered: float = COVERED) -> DataFrame:
    """Like `nearest`, but a query looks only into the leaves near to it: approximate, and no product of all with all.

    The tree is built, or given (kept with a store). How many leaves are looked into is
    given, or measured on some of these queries (`leaves_to_probe`), so that recall
    doesn't rest on what vectors are like: where they lie in clusters a few leaves do,
    where they don't most of them are read. A key's queries and then
    its vectors come to one task as sorted rows; it holds the queries of one key (so their number
    is what its memory grows with) and a batch of vectors, and no key has more than some BLOCKS_A_KEY full blocks. With all leaves the
    result is exact. Query ids must be distinct.
    """
    tree = tree or cell_tree(chunks)
    if tree is None:
        return nearest(chunks, queries, candidates)
    queries = queries.where("embedding is not null").select("query_id", "embedding")
    cells = len(tree.centres)
    if leaves is None:
        leaves, cells = leaves_to_probe(tree, queries, candidates, covered)
    kinds = {f.name: f.dataType.simpleString() for f in (*tree.placed.schema, *queries.schema)}
    probes = _leaves(tree, queries, leaves, cells).join(tree.keys, "leaf")
    probes = probes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("query_id", _key(F.col("leaf"), F.col("salt")).alias("cell"))
    asked = probes.join(queries.withColumn("embedding", F.col("embedding").cast("array<double>")), "query_id").select("cell", "query_id", "embedding")

    def queries_of(cell: pa.Table) -> tuple[pa.Array, np.ndarray]:
        return cell.column("query_id").combine_chunks(), _matrix(cell.column("embedding").combine_chunks())

    def best(state: tuple[pa.Array, np.ndarray], part: pa.Table) -> pa.RecordBatch:
        return _found(*state, part, candidates)

    return _ranked(_led(asked, tree.dealt, queries_of, best, _found_schema(kinds)), candidates)
