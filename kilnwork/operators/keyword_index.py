"""A keyword index as tables, BM25 scores, and patches of the index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import runs, tokenize
from ..sources.shared import written
from ..sources.store import DamagedStore, Table, Version, commit, current, current_name, new_name, write_table

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Decimals on which scores are ranked, as sums come in any order.
RANKED = 9
#: Asked tokens (rows of query, token, count and idf) that are broadcast; more are joined without, or searched in groups of queries.
BROADCAST_ASKED = 200_000
#: Chunks of a block that is scored as one. A search's blocks have WIDE times as many, and its groups of queries WIDE times as many tokens: each query's work in a block has fixed costs, and each group makes the blocks again.
BLOCK, WIDE = 4096, 8
#: What rounding may add to a sum of bounds.
SLACK = 1e-6
#: Share of the bounds by which sums of single precision may be off.
ROUGH = 4e-5
#: Tokens of a block whose part of a score is a matrix product, at most; a token is worth it if that share of all pairs of query and chunk has it. Queries of one product.
COMMON, WORTH, TOGETHER = 64, 1 / 128, 64


@dataclass
class KeywordIndex:
    """tokens(chunk_id, page_id, chunk_index, tokens), postings, terms(token, df, idf) and corpus(n_chunks, n_tokens, avgdl); any of them may be stored ones."""

    tokens: DataFrame
    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame


def token_table(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "page_id", "chunk_index", tokenize(F.col("document")).alias("tokens"))


def postings(tokens: DataFrame) -> DataFrame:
    """(chunk_id, page_id, chunk_index, token, tf, dl). A chunk's tokens are counted within its row, as runs of the sorted list, so nothing is shuffled."""
    counted = tokens.select("chunk_id", "page_id", "chunk_index", F.size("tokens").cast("long").alias("dl"), F.explode(runs(F.col("tokens"))).alias("run"))
    return counted.select("chunk_id", "page_id", "chunk_index", F.col("run.value").alias("token"), F.col("run.n").cast("long").alias("tf"), "dl")


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row (n_chunks, n_tokens, avgdl); chunks without tokens count."""
    return _corpus(tokens.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long").alias("n_tokens")))


def _corpus(sums: DataFrame) -> DataFrame:
    return sums.select("n_chunks", "n_tokens", F.when(F.col("n_chunks") > 0, F.col("n_tokens") / F.col("n_chunks")).alias("avgdl"))


def term_stats(frequencies: DataFrame, corpus: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """(token, df, idf) from (token, df): a negative idf becomes epsilon times the average of the raw ones."""
    raw = frequencies.crossJoin(F.broadcast(corpus)).select("token", "df", (F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    average = raw.agg(F.avg("raw").alias("average"))  # one row
    return raw.crossJoin(F.broadcast(average)).select("token", "df", F.when(F.col("raw") < 0, epsilon * F.col("average")).otherwise(F.col("raw")).alias("idf"))


def _frequencies(tokens: DataFrame) -> DataFrame:
    """(token, df) of a table of tokens; what a chunk repeats is dropped within its row, without sorting it."""
    return tokens.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def of_tokens(tokens: DataFrame) -> KeywordIndex:
    posted, corpus = postings(tokens), corpus_stats(tokens)
    return KeywordIndex(tokens, posted, term_stats(_frequencies(tokens), corpus), corpus)


def build(chunks: DataFrame) -> KeywordIndex:
    """The index of all chunks; of none it is empty."""
    return of_tokens(token_table(chunks))


def stored(index: KeywordIndex) -> KeywordIndex:
    """The index with its tokens and terms written to the shared folder (Spark jobs), so that a search doesn't tokenise chunks again. Postings are counted within a row of tokens, so these aren't written a second time."""
    tokens = written(index.tokens, "tokens")
    posted, corpus = postings(tokens), written(corpus_stats(tokens), "corpus")
    return KeywordIndex(tokens, posted, written(term_stats(_frequencies(tokens), corpus), "terms"), corpus)


#: Segments of a stored index from which a patch merges them.
SEGMENTS = 8
_PARTS = ("tokens", "gone", "df", "sums")


def _segments(version: Version) -> list[int]:
    return sorted(int(n.removeprefix("sums-")) for n in version.tables if n.startswith("sums-"))


def _sums(tokens: DataFrame) -> DataFrame:
    return corpus_stats(tokens).select("n_chunks", "n_tokens")


def _no_ids(df: DataFrame) -> DataFrame:
    return df.select("chunk_id").where("false")


def _write_segment(spark: SparkSession, path: str, name: str, number: int, tokens: DataFrame, gone: DataFrame, out: DataFrame | None = None) -> dict[str, Table]:
    """A segment's tables. The tokens are written first, and frequencies and sums counted from what is written, so that no chunk is tokenised twice; those of the tokens `out` are taken off."""
    made = {f"tokens-{number}": write_table(tokens, path, name, f"tokens-{number}")}
    new = made[f"tokens-{number}"].read(spark, path)
    df, sums = _frequencies(new), _sums(new)
    if out is not None:
        off = _frequencies(out).select("token", (-F.col("df")).alias("df"))
        df = df.unionByName(off).groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0")
        sums = sums.unionByName(_sums(out).select((-F.col("n_chunks")).alias("n_chunks"), (-F.col("n_tokens")).alias("n_tokens")))
    return made | {f"{part}-{number}": write_table(rows, path, name, f"{part}-{number}") for part, rows in (("gone", gone), ("df", df), ("sums", sums))}


def whole_segment(index: KeywordIndex, path: str, name: str, number: int = 0) -> dict[str, Table]:
    """The tables of a version that holds an index as one segment. Only the index's tokens are read, once."""
    return _write_segment(index.tokens.sparkSession, path, name, number, index.tokens, _no_ids(index.tokens))


def save(index: KeywordIndex, path: str, keep: int | None = None) -> str:
    """A new version that holds this index alone, as one segment."""
    spark, name = index.tokens.sparkSession, new_name()
    before = current_name(spark, path)
    commit(spark, path, Version(name, before, whole_segment(index, path, name)), keep)
    return name


def patch_segment(spark: SparkSession, path: str, version: Version | None, name: str, added: DataFrame, removed: DataFrame, most: int = SEGMENTS) -> dict[str, Table]:
    """The index tables of a version that follows: chunks with the ids `removed` go, then the chunks `added` come. Only a segment of what changes is written (its tokens, the ids that are gone, and what both do to frequencies and sums); with `most` segments they are merged into one."""
    numbers = [] if version is None else _segments(version)
    new = token_table(added)
    if not numbers:
        return whole_segment(of_tokens(new), path, name)
    old = opened(spark, path, version)
    ids = written(removed.select("chunk_id").distinct(), "gone")
    if len(numbers) >= most:
        return whole_segment(patch_add(patch_remove(old, ids), added), path, name, numbers[-1] + 1)
    out = written(old.tokens.join(ids, "chunk_id", "left_semi"), "out")
    kept = {n: t for n, t in version.tables.items() if n.rpartition("-")[0] in _PARTS}
    return kept | _write_segment(spark, path, name, numbers[-1] + 1, new, ids, out)


def save_patch(spark: SparkSession, path: str, added: DataFrame, removed: DataFrame, keep: int | None = None, most: int = SEGMENTS) -> str:
    """A new version of a stored index, without the chunks `removed` and with those `added`. What doesn't change isn't written; a damaged index raises, and another writer's version meanwhile is a StaleStore."""
    version, name = current(spark, path), new_name()
    commit(spark, path, Version(name, version and version.name, patch_segment(spark, path, version, name, added, removed, most)), keep)
    return name


def opened(spark: SparkSession, path: str, version: Version) -> KeywordIndex:
    """The index that a version's segments make up: a chunk counts unless a later segment says that it is gone."""
    numbers = _segments(version)
    if not numbers:
        raise DamagedStore(f"{path}/{version.name} holds no index")
    parts = {part: [version.tables[f"{part}-{k}"].read(spark, path) for k in numbers] for part in _PARTS}
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    tokens = parts["tokens"][0]
    if len(numbers) > 1:
        gone = union([g.withColumn("last", F.lit(k)) for g, k in zip(parts["gone"], numbers)]).groupBy("chunk_id").agg(F.max("last").alias("last"))
        numbered = union([t.withColumn("segment", F.lit(k)) for t, k in zip(parts["tokens"], numbers)])
        tokens = numbered.join(gone, "chunk_id", "left").where("last is null or last <= segment").drop("last", "segment")
    corpus = _corpus(union(parts["sums"]).agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens")))
    df = parts["df"][0] if len(numbers) == 1 else union(parts["df"]).groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
    return KeywordIndex(tokens, postings(tokens), term_stats(df, corpus), corpus)


def load(spark: SparkSession, path: str) -> KeywordIndex | None:
    """The stored index, for searching: None if there is none, or if it is damaged (the search then goes by vectors alone). To patch an index, use `load_to_patch`."""
    try:
        return load_to_patch(spark, path)
    except DamagedStore:
        return None


def load_to_patch(spark: SparkSession, path: str) -> KeywordIndex | None:
    """The stored index; None if there is none. A damaged one raises."""
    version = current(spark, path)
    return None if version is None else opened(spark, path, version)


def _patched(index: KeywordIndex, tokens: DataFrame, posted: DataFrame, delta: DataFrame, sign: int) -> KeywordIndex:
    """The index with new tokens and postings, and what follows from the changed chunks' tokens (delta) alone."""
    changed = _frequencies(delta).select("token", (sign * F.col("df")).alias("df"))
    frequencies = index.terms.select("token", "df").unionByName(changed).groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
    one = corpus_stats(delta).select((sign * F.col("n_chunks")).alias("n_chunks"), (sign * F.col("n_tokens")).alias("n_tokens"))
    corpus = _corpus(index.corpus.select("n_chunks", "n_tokens").unionByName(one).agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens")))
    return KeywordIndex(tokens, posted, term_stats(frequencies, corpus), corpus)


def patch_add(index: KeywordIndex, chunks: DataFrame) -> KeywordIndex:
    """The index with new chunks. Only these are tokenised; of the rest, frequencies are read, and postings passed on."""
    new = token_table(chunks)
    return _patched(index, index.tokens.unionByName(new), index.postings.unionByName(postings(new)), new, 1)


def patch_remove(index: KeywordIndex, ids: DataFrame) -> KeywordIndex:
    """The index without the chunks of these ids (those that it doesn't have don't matter)."""
    ids = ids.select("chunk_id").distinct()
    old = index.tokens.join(ids, "chunk_id", "left_semi")
    return _patched(index, index.tokens.join(ids, "chunk_id", "left_anti"), index.postings.join(ids, "chunk_id", "left_anti"), old, -1)


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, token, qtf): a token that a query repeats counts each time."""
    return queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


#: Queries whose scores are held for a block at once.
COLUMNS = 256


def scores(index: KeywordIndex, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, chunk_id, page_id, chunk_index, score) of all chunks that share a token with the query.

    All of a chunk's tokens lie in its row, so its scores are summed where it lies, in
    blocks, and nothing is shuffled but the chunks' ids, once, to see which ids more
    than one row has. Those rows' postings are joined and summed by id. Queries are
    taken in groups of some BROADCAST_ASKED tokens, as in `search`. Runs Spark jobs
    when it is called.
    """
    corpus = index.corpus.first()
    asked = written(query_tokens(queries).join(index.terms.select("token", "idf"), "token").select("query_id", "token", "qtf", "idf"), "asked")
    repeated = written(index.tokens.groupBy(*_CHUNK).agg(F.count("*").alias("n")).where("n > 1").select(*_CHUNK), "repeated")
    same = F.lit(True)
    for c in _CHUNK:
        same = same & F.col("t." + c).eqNullSafe(F.col("r." + c))
    tokens, parts = index.tokens, []
    if not repeated.isEmpty():
        again = index.tokens.alias("t").join(repeated.alias("r"), same, "left_semi")
        tokens = index.tokens.alias("t").join(repeated.alias("r"), same, "left_anti")
        part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        parts.append(postings(again).join(asked, "token").crossJoin(F.broadcast(index.corpus)).groupBy("query_id", *_CHUNK).agg(F.sum(part).alias("score")))
    parts += [_scored(tokens, rows, corpus.avgdl or 1.0, k1, b) for rows in _groups(asked, BROADCAST_ASKED)]
    return reduce(DataFrame.unionByName, parts)


def _groups(asked: DataFrame, most: int) -> list[pa.Table]:
    """Asked tokens in groups of queries, each of some `most` tokens."""
    groups = max(1, -(-asked.count() // most))
    return [(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g) if groups > 1 else asked).toArrow() for g in range(groups)]


def _scored(tokens: DataFrame, rows: pa.Table, avgdl: float, k1: float, b: float) -> DataFrame:
    """All scores of one group of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(rows, 1)
        for batch in _blocks(batches):
            entries = _block(batch, 0, asked, avgdl, k1, b)
            many, tf, norm = entries.many, entries.tf[entries.order], entries.norm[entries.order]
            for first in range(0, len(asked.queries), COLUMNS):
                some = asked.queries[first : first + COLUMNS]
                total, met = np.zeros((len(some), many)), np.zeros((len(some), many), bool)
                for q, (terms, weights) in enumerate(some):
                    for t, w in zip(terms, weights):
                        at = slice(entries.bounds[t], entries.bounds[t + 1])
                        # A row has a token once, so no place is named twice; factors in the SQL's order.
                        total[q, entries.rows[at]] += w * tf[at] * (k1 + 1) / norm[at]
                        met[q, entries.rows[at]] = True
                for part in range(0, len(some), 16):
                    of, at = np.nonzero(met[part : part + 16])
                    if len(of):
                        ids = asked.ids.take(pa.array(of + part + first)).cast(rows.schema.field("query_id").type)
                        yield pa.RecordBatch.from_arrays([ids, *(batch.column(c)[0].values.take(pa.array(at)) for c in _CHUNK), pa.array(total[of + part, at])], ["query_id", *_CHUNK, "score"])

    return tokens.select(*_CHUNK, "tokens").mapInArrow(run, _found_schema(tokens, rows))


def _found_schema(tokens: DataFrame, rows: pa.Table) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema}
    return f"query_id {from_arrow_type(rows.schema.field('query_id').type).simpleString()}, " + ", ".join(f"{c} {kinds[c]}" for c in _CHUNK) + ", score double"


def _block_of(part: pa.Table) -> pa.RecordBatch:
    """Chunks as a block, one row: their ids, dl, the block's own vocabulary, and entries (row, place of the token in it, tf) by row."""
    lists = part.column("tokens").combine_chunks().fill_null([])
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    many = max(1, len(coded.dictionary))
    pair, tf = np.unique(np.repeat(np.arange(len(part)), sizes) * many + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    numbers = [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (sizes, pair // many, pair % many, tf)]
    return pa.RecordBatch.from_arrays([*(one(part.column(c).combine_chunks()) for c in _CHUNK), one(coded.dictionary), *numbers], [*_CHUNK, "vocabulary", "dl", "row", "term", "tf"])


def _blocks(batches: Iterator[pa.RecordBatch], wide: int = 1) -> Iterator[pa.RecordBatch]:
    """A task's rows in blocks of `wide` times BLOCK, made and used within one Python process, so that it never holds more than one and a batch of rows."""
    most = wide * BLOCK
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for first in range(0, len(batch), most):
            held.append(batch.slice(first, most))
            if sum(map(len, held)) >= most:
                whole = pa.Table.from_batches(held)
                yield _block_of(whole.slice(0, most))
                held = whole.slice(most).to_batches()
    if sum(map(len, held)):
        yield _block_of(pa.Table.from_batches(held))


_CHUNK = ["chunk_id", "page_id", "chunk_index"]


class Asked:
    """Queries as lists of tokens (places in a common vocabulary) and weights (count times idf), and the best scores that each has got so far."""

    def __init__(self, rows: pa.Table, candidates: int):
        coded = rows.column("token").combine_chunks().dictionary_encode()
        asked = rows.column("query_id").combine_chunks().dictionary_encode()
        self.vocabulary, self.ids, self.candidates = coded.dictionary, asked.dictionary, candidates
        of, term = asked.indices.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)
        weight = rows.column("qtf").to_numpy() * rows.column("idf").to_numpy()
        order = np.lexsort((term, of))
        cuts = np.flatnonzero(np.diff(of[order])) + 1
        self.queries = list(zip(np.split(term[order], cuts), np.split(weight[order], cuts))) if len(of) else []
        self.best = [np.zeros(0) for _ in self.queries]
        self.terms, self.lifts, self.starts = term[order], np.maximum(weight[order], 0), np.concatenate([[0], cuts]).astype(np.int64)
        self.thresholds = np.full(len(self.queries), -np.inf)
        self.weights, self.of = weight[order], of[order]
        self.often = np.bincount(term, minlength=len(self.vocabulary))

    def matrix(self, tokens: np.ndarray) -> np.ndarray:
        """The weights of these tokens, a row a query."""
        place = np.full(len(self.vocabulary), -1)
        place[tokens] = np.arange(len(tokens))
        at = np.flatnonzero(place[self.terms] >= 0)
        made = np.zeros((len(self.queries), len(tokens)), np.float32)
        made[self.of[at], place[self.terms[at]]] = self.weights[at]
        return made

    def hopeful(self, most: np.ndarray) -> np.ndarray:
        """The queries for which a block may hold something, by the most that each token adds to a score there."""
        if not len(self.queries):
            return np.zeros(0, np.int64)
        bound = np.add.reduceat(self.lifts * most[self.terms], self.starts)
        return np.flatnonzero((bound > 0) & (bound + SLACK >= self.thresholds))  # scores that aren't over 0 don't count

    def threshold(self, query: int) -> float:
        """The least score that can still be among the best."""
        best = self.best[query]
        return best[0] if len(best) == self.candidates else -np.inf

    def got(self, query: int, scores: np.ndarray) -> None:
        self.best[query] = np.sort(np.concatenate([self.best[query], scores]))[-self.candidates :]
        self.thresholds[query] = self.threshold(query)


class Postings:
    """A block's entries that some query asks for: what each adds to a score before its weight, by row and by token, and the most that a token adds here."""

    def __init__(self, row: np.ndarray, term: np.ndarray, part: np.ndarray, rows: int, terms: int):
        self.term, self.part, self.terms, self.many = term.astype(np.int32), part, terms, rows
        self.first = np.searchsorted(row, np.arange(rows + 1))
        self.order = np.argsort(term, kind="stable")
        self.rows, self.parts = row[self.order].astype(np.int32), part[self.order].astype(np.float32)
        self.bounds = np.searchsorted(term[self.order], np.arange(terms + 1))
        self.most = np.zeros(terms)
        np.maximum.at(self.most, term, part)
        self.weights, self.dense = np.zeros(terms), np.zeros(terms, bool)
        self.scored = 0

    def having(self, terms: np.ndarray) -> np.ndarray:
        """Rows with any of these tokens."""
        return np.unique(np.concatenate([np.zeros(0, self.rows.dtype), *(self.rows[self.bounds[t] : self.bounds[t + 1]] for t in terms)]))

    def score(self, rows: np.ndarray) -> np.ndarray:
        self.scored += len(rows)
        if not len(rows):
            return np.zeros(0)
        sizes = self.first[rows + 1] - self.first[rows]
        ends = np.cumsum(sizes)
        entry = np.arange(ends[-1]) + np.repeat(self.first[rows] - (ends - sizes), sizes)
        return np.add.reduceat(self.weights[self.term[entry]] * self.part[entry], ends - sizes)

    def common(self, asked: Asked, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(query, what the common tokens, those in `dense`, add to each row's score), as one product for some queries at a time. Each is gone with the next."""
        pairs = asked.often * np.diff(self.bounds)
        tokens = np.argsort(-pairs, kind="stable")[:COMMON]
        tokens = tokens[pairs[tokens] >= WORTH * self.many * max(1, len(asked.queries))]
        self.dense[:] = False
        self.dense[tokens] = True
        parts = np.zeros((len(tokens), self.many), np.float32)
        for i, t in enumerate(tokens):
            at = slice(self.bounds[t], self.bounds[t + 1])
            parts[i, self.rows[at]] = self.parts[at]
        weights, room = asked.matrix(tokens), np.empty((TOGETHER, self.many), np.float32)
        for first in range(0, len(queries), TOGETHER):
            some = queries[first : first + TOGETHER]
            yield from zip(some, np.matmul(weights[some], parts, out=room[: len(some)]))

    def best(self, terms: np.ndarray, weights: np.ndarray, asked: Asked, query: int, total: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores): all rows of this block that may be among the query's best.

        What the tokens add to each row is summed in single precision, to `total` if it
        has the common tokens' part (see `common`). Rows that may reach the threshold by
        it, or some of the block's own best as long as there is none, are scored.
        """
        there = self.bounds[terms + 1] > self.bounds[terms]
        terms, weights = terms[there], weights[there]
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0)
        others = np.flatnonzero(~self.dense[terms]) if total is not None else np.arange(len(terms))
        total = np.zeros(self.many, np.float32) if total is None else total
        if len(others):
            at = [slice(a, b) for a, b in zip(self.bounds[terms[others]].tolist(), self.bounds[terms[others] + 1].tolist())]
            added = np.concatenate([self.parts[x] for x in at])
            added *= np.repeat(weights[others].astype(np.float32), [x.stop - x.start for x in at])
            np.add.at(total, np.concatenate([self.rows[x] for x in at], dtype=np.intp), added)
        slack = SLACK + ROUGH * float(np.abs(weights) @ self.most[terms])
        least = float(asked.threshold(query)) - slack
        if least == -np.inf and self.many >= asked.candidates:
            # So many rows as there are candidates reach what the best of as many parts of the block do.
            parts = min(self.many, 16 * asked.candidates)
            highest = total[: self.many // parts * parts].reshape(parts, -1).max(axis=1)
            least = float(np.partition(highest, -asked.candidates)[-asked.candidates]) - 2 * slack
        rows = np.flatnonzero(total >= least) if least > 0 else self.having(terms)
        self.weights[terms] = weights
        scores = self.score(rows)
        self.weights[terms] = 0
        asked.got(query, scores)
        kept = (scores + SLACK >= asked.threshold(query)) & (np.round(scores, RANKED) > 0)
        return rows[kept], scores[kept]


def _block(batch: pa.RecordBatch, i: int, asked: Asked, avgdl: float, k1: float, b: float) -> Postings:
    numbers = lambda c: np.frombuffer(batch.column(c)[i].as_buffer(), np.int32).astype(np.int64)
    dl, row, term, tf = map(numbers, ("dl", "row", "term", "tf"))
    place = pc.index_in(batch.column("vocabulary")[i].values, asked.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
    known = place[term] >= 0 if len(term) else np.zeros(0, bool)
    row, term, tf = row[known], place[term[known]], tf[known]
    norm = tf + k1 * (1 - b + b * dl[row] / avgdl)
    made = Postings(row, term, tf * (k1 + 1) / norm, len(dl), len(asked.vocabulary))
    made.tf, made.norm = tf, norm  # by row, as `part` is
    return made


def _searched(tokens: DataFrame, rows: pa.Table, avgdl: float, candidates: int, k1: float, b: float) -> DataFrame:
    query = rows.schema.field("query_id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(rows, candidates)
        for batch in _blocks(batches, WIDE):
            entries = _block(batch, 0, asked, avgdl, k1, b)
            found = [(q, *entries.best(*asked.queries[q], asked, q, total)) for q, total in entries.common(asked, asked.hopeful(entries.most))]
            found = [f for f in found if len(f[1])]
            if found:
                take = pa.array(np.concatenate([r for _, r, _ in found]))
                ids = asked.ids.take(pa.array(np.repeat([q for q, *_ in found], [len(r) for _, r, _ in found]))).cast(query)
                yield pa.RecordBatch.from_arrays([ids, *(batch.column(c)[0].values.take(take) for c in _CHUNK), pa.array(np.concatenate([s for *_, s in found]))], ["query_id", *_CHUNK, "score"])

    return tokens.select(*_CHUNK, "tokens").mapInArrow(run, _found_schema(tokens, rows))


def search(index: KeywordIndex, queries: DataFrame, candidates: int = 20, k1: float = K1, b: float = B) -> DataFrame:
    """The best `candidates` by score (ties by place in the index) with a score over 0, and their bm25_rank.

    Chunks are searched in blocks; a task keeps each query's best scores so far, and
    leaves out the chunks that can't reach the last of them (see `Postings.best`).
    What a block yields are whole scores of chunks that may be among the best, and a
    window picks these. Queries are taken in groups of some BROADCAST_ASKED tokens, each in one
    pass over the blocks, so what tasks hold of them is bounded. Runs Spark jobs when it is called.
    """
    corpus = index.corpus.first()
    asked = written(query_tokens(queries).join(index.terms.select("token", "idf"), "token").select("query_id", "token", "qtf", "idf"), "asked")
    parts = [_searched(index.tokens, rows, corpus.avgdl or 1.0, candidates, k1, b) for rows in _groups(asked, WIDE * BROADCAST_ASKED)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = Window.partitionBy("query_id").orderBy(F.col("ranked").desc(), "page_id", "chunk_index")
    ranked = found.withColumn("ranked", F.round("score", RANKED)).withColumn("bm25_rank", F.row_number().over(best))
    return ranked.where(F.col("bm25_rank") <= candidates).where("ranked > 0").select("query_id", *_CHUNK, "score", "bm25_rank")
