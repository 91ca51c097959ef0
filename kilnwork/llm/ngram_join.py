"""N-gram Jaccard self-join by a MinHash LSH forest.

Texts with equal sets of word shingles are one node. A tree of the forest is a
prefix trie: the tree's part of every node's signature is a path, and rows sorted
by path lay the trie out. Nodes that share the shortest prefix worth a look meet
(of many, each two blocks by themselves), sorted. The trie is then walked from the
longest prefixes on: nodes below one of its points are compared by their whole
signatures and, if they can be similar, grouped. A prefix is shortened only for
points that still hold several groups, and at most until the chance that a pair at
the threshold shares a prefix in some tree reaches the target recall. What the
groups of all trees connect is verified exactly from the texts, in blocks of
bounded size, and links are counted, not emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTE_CODES, SPACED, U64, Rolling, mix, text_blocks, word_bounds, written
from .components import components, joined
from .windows import identified

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH = 16, 8
#: Chance that a pair just at the threshold is found.
RECALL = 0.9995
#: Standard deviations of an estimated similarity that a candidate may lie below the threshold.
SLACK = 5.5
#: Nodes of a prefix in a block; two blocks meet in a task.
GATHERED = 4096
#: Rows of a trie that a task walks at a time, whole prefixes; and nodes of a point compared at once.
WALKED, COMPARED = 32_768, 1024
#: Nodes, and shingles, in a block; two blocks meet in a task.
BLOCK, BLOCK_SHINGLES = 768, 1_000_000

_RANDOM = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 64, (2, TREES * DEPTH), dtype=U64)
_FLIPS, _FACTORS = _RANDOM[0], _RANDOM[1] | U64(1)


def prefix_depth(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold is found with the recall's chance: shortening ends there."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document's word shingles, sorted, and where each document's begin. A text with fewer words has one shingle, all of them; one without words has none."""
    n = len(offsets) - 1
    starts, ends, of = word_bounds(data, offsets, SPACED)
    words = Rolling(Rolling(BYTE_CODES[data]).hash(starts, ends))
    begins = np.searchsorted(of, np.arange(n + 1))
    at = np.arange(max(0, len(starts) - size + 1))
    at = at[of[at] == of[at + size - 1]]
    count = np.diff(begins)
    short = np.flatnonzero((count > 0) & (count < size))
    hashes = np.concatenate([words.hash(at, at + size), words.hash(begins[short], begins[short + 1])])
    doc = np.concatenate([of[at], short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    fresh = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])])[: len(doc)]
    return hashes[fresh], np.searchsorted(doc[fresh], np.arange(n + 1))


def _signed(size: int):
    """(doc, tag, node, n, signature) of each row: the node is the hash of its set of shingles; the signature 16 bits a value, so that a tree's path is a string of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, data, offsets in text_blocks(batch.column(2)):
                hashes, begins = shingles(data, offsets, size)
                some = np.flatnonzero(np.diff(begins))
                signature = np.zeros((rows, TREES * DEPTH), U64)
                node = np.zeros(rows, U64)
                if len(some):
                    node[some] = mix(np.add.reduceat(mix(hashes + U64(17)), begins[some]) ^ mix(np.diff(begins)[some].astype(U64)))
                    for i in range(TREES * DEPTH):
                        signature[some, i] = np.minimum.reduceat((hashes ^ _FLIPS[i]) * _FACTORS[i], begins[some])
                small = (mix(signature) >> U64(48)).astype(">u2")
                mask = np.diff(begins) == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), batch.column(1).slice(first, rows), pa.array(node.astype(np.int64), mask=mask), pa.array(np.diff(begins).astype(np.int64)), pa.array([x.tobytes() for x in small], pa.binary())],
                    ["doc", "tag", "node", "n", "signature"],
                )

    return run


def _least_connected(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each a place that has itself as label) after the places a and b have been joined pair by pair."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def walked(point: np.ndarray, paths: np.ndarray, signatures: np.ndarray, shortest: int, threshold: float) -> np.ndarray:
    """For each row of a trie (point: its shortest prefix, paths sorted within it) the row that its group is named by."""
    n, width = signatures.shape
    near = threshold - SLACK * (threshold * (1 - threshold) / width) ** 0.5
    equal = paths[1:] == paths[:-1]
    shared = np.concatenate([[-1], np.where(point[1:] != point[:-1], -1, np.where(equal.all(axis=1), paths.shape[1], equal.argmin(axis=1)))])
    label = np.arange(n)
    for depth in range(paths.shape[1], shortest - 1, -1):
        heads = np.flatnonzero(shared < depth)
        sizes = np.diff(np.append(heads, n))
        head = np.repeat(heads, sizes)
        other = np.flatnonzero(label != label[head])
        if not len(other):
            continue  # each point holds one group: nothing to find here
        alike = np.concatenate([(signatures[x] == signatures[head[x]]).mean(axis=1) for x in np.array_split(other, -(-len(other) // COMPARED))])
        close = other[alike >= near]
        label = _least_connected(label, close, head[close])
        apart = np.unique(head[label != label[head]])
        size_of = dict(zip(heads.tolist(), sizes.tolist()))
        a, b = [], []
        for h in apart.tolist():
            m = size_of[h]
            if m < 3:
                continue
            members = np.arange(h, h + m)
            signs = _signs(signatures[members])
            groups = label[members]
            for i in range(0, m, COMPARED):
                part = slice(i, i + COMPARED)
                found = (signs[part] @ signs.T >= near * signs.shape[1]) & (groups[part, None] != groups[None])
                # One link a row and group is enough: the first to each other group that it is near to.
                x, y = np.nonzero(found)
                _, once = np.unique(groups[x + i] * n + groups[y], return_index=True)
                a.append(members[x[once] + i])
                b.append(members[y[once]])
        if a:
            label = _least_connected(label, np.concatenate(a), np.concatenate(b))
    return label


def _signs(signatures: np.ndarray) -> np.ndarray:
    """Four signs for each value: products of two rows' signs estimate how many of their values are equal."""
    bits = np.stack([(signatures >> k) & 1 for k in range(4)], 2).reshape(len(signatures), -1)
    return bits.astype(np.float32) * 2 - 1


def _grouped(shortest: int, threshold: float):
    """(a, b): an edge from each row's node to the node that its group is named by; from rows (prefix, a, b, path, node, signature) sorted by these."""

    def edges(table: pa.Table) -> pa.RecordBatch:
        keys = np.stack([table.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
        point = np.cumsum(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        as_matrix = lambda k: np.frombuffer(b"".join(table.column(k).to_pylist()), ">u2").astype(np.uint16).reshape(len(table), -1)
        node = table.column(4).to_numpy()
        name = node[walked(point, as_matrix(3), as_matrix(5), shortest, threshold)]
        some = name != node
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(name[some])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) > WALKED:
                table = pa.Table.from_batches(held)
                keys = np.stack([table.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
                cut = len(keys) - int((keys == keys[-1]).all(axis=1)[::-1].argmin()) if not (keys == keys[-1]).all() else 0
                if cut:  # the last prefix may go on in the next batch
                    yield edges(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
        if sum(map(len, held)):
            yield edges(pa.Table.from_batches(held))

    return run


def _met(nodes: DataFrame, shortest: int) -> DataFrame:
    """(prefix, a, b, path, node, signature): nodes that share a tree's shortest prefix; of a prefix with many, each two blocks (a, b) by themselves, so that all pairs of nodes meet."""
    step = 2 * DEPTH
    paths = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring("signature", t * step + 1, F.lit(step)).alias("path")))
    rows = nodes.select("node", F.explode(paths).alias("way")).select("node", "way.path", F.xxhash64("way.tree", F.substring("way.path", 1, 2 * shortest)).alias("prefix"))
    many = written(rows.groupBy("prefix").agg(F.count("*").alias("rows")).where("rows > 1").withColumn("many", F.col("rows")), "prefixes")
    total = many.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    signed = joined(rows, many, "prefix", "rows", total).join(nodes.select("node", "signature"), "node")
    blocks = F.ceil(F.col("many") / GATHERED).cast("int")
    return signed.select("prefix", "path", "node", "signature", F.explode(_units(F.pmod(F.xxhash64("node"), blocks).cast("int"), blocks)).alias("unit")).select("prefix", "unit.a", "unit.b", "path", "node", "signature")


def _units(side: Column, blocks: Column) -> Column:
    """The block pairs that a row of this block takes part in."""
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least(side, other).alias("a"), F.greatest(side, other).alias("b")))


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share."""
    m = len(sets)
    of = np.repeat(np.arange(m), [len(s) for s in sets])
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    rank = np.cumsum(shared) - 1
    keep = shared[inverse]
    column, of = rank[inverse[keep]], of[keep]
    total = np.zeros((m, m), np.float64)
    width = max(1, min(4_000_000 // m, int(shared.sum())))
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    for start in range(0, int(shared.sum()), width):
        here = slice(np.searchsorted(column, start), np.searchsorted(column, start + width))
        present = np.zeros((m, width), np.float32)
        present[of[here], column[here] - start] = 1
        total += present @ present.T
    return total.astype(np.int64)


def _verified(threshold: float, size: int):
    """(node, links, root) from rows (component, a, b, side, node, text) sorted by component and block pair: exact similarities of a block pair's nodes."""
    t = Fraction(threshold).limit_denominator(10_000)

    def unit(rows: pa.Table) -> list[tuple[int, int, int]]:
        node = rows.column(4).to_numpy()
        _, once = np.unique(node, return_index=True)  # a repeated row comes twice
        if len(once) < 2:
            return []
        a, b, side, node = rows.column(1)[0].as_py(), rows.column(2)[0].as_py(), rows.column(3).to_numpy()[once], node[once]
        sets = []
        for _, n, data, offsets in text_blocks(rows.column(5).take(pa.array(once))):
            hashes, begins = shingles(data, offsets, size)
            sets += [hashes[begins[i] : begins[i + 1]] for i in range(n)]
        n = np.array([len(s) for s in sets])
        shared = _intersections(sets)
        linked = (t.denominator + t.numerator) * shared >= t.numerator * (n[:, None] + n[None])
        np.fill_diagonal(linked, False)
        if a != b:
            linked &= side[:, None] != side[None]
        links = linked.sum(axis=1)
        root = np.arange(len(sets))
        while True:  # the least linked node's root, until nothing moves
            new = np.minimum(root, np.where(linked, root[None], len(sets)).min(axis=1))
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = np.flatnonzero(links)
        return list(zip(node[some].tolist(), links[some].tolist(), node[root[some]].tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        out: list[tuple[int, int, int]] = []

        def emitted() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], [], []))], ["node", "links", "root"])
            out.clear()
            return batch

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if key != tuple(keys[x]):
                    if held:
                        out += unit(pa.Table.from_batches(held))
                    held, key = [], tuple(keys[x])
                held.append(batch.slice(x, y - x))
            if len(out) > 10_000:
                yield emitted()
        if held:
            out += unit(pa.Table.from_batches(held))
        yield emitted()

    return run


def _classed(docs: DataFrame, threshold: float, size: int, recall: float, key: str, text: str) -> DataFrame:
    """(doc, tag, component, copy_of, class_id, n_links) of each row; the component names the class and is null without words."""
    source = identified(docs, key, text)
    shortest = prefix_depth(threshold, recall)
    rows = written(source.mapInArrow(_signed(size), "doc long, tag long, node long, n long, signature binary"), "signatures")
    first = F.min(F.struct("doc", "tag", "n", "signature")).alias("first")
    nodes = written(rows.where("node is not null").groupBy("node").agg(first, F.count("*").alias("copies")).select("node", "first.*", "copies"), "nodes")

    edges = _met(nodes, shortest).repartition("prefix", "a", "b").sortWithinPartitions("prefix", "a", "b", "path", "node").mapInArrow(_grouped(shortest, threshold), "a long, b long")
    members = written(components(edges).join(nodes.select("node", "n", "doc", "tag"), "node"), "members")

    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = written(members.groupBy("component").agg(F.count("*").alias("many"), blocks.alias("blocks")), "sizes")
    placed = joined(members, sizes, "component", "many", members.count()).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    wanted = placed.select("doc", "tag", "node", "component", "side", _units(F.col("side"), F.col("blocks")).alias("units"))
    texts = source.join(wanted, ["doc", "tag"]).dropDuplicates(["doc", "tag"])  # a repeated row once
    texts = texts.select("component", F.explode("units").alias("unit"), "side", "node", "text")
    paired = texts.select("component", "unit.a", "unit.b", "side", "node", "text").repartition("component", "a", "b").sortWithinPartitions("component", "a", "b")
    verified = written(paired.mapInArrow(_verified(threshold, size), "node long, links long, root long"), "verified")

    links = verified.groupBy("node").agg(F.sum("links").alias("n_links"))
    parts = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = written(nodes.select("node", "doc", "copies").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    classes = named.groupBy("component").agg(F.min("doc").alias("class_id"), F.count("*").alias("many"))
    about = joined(named, classes, "component", "many", named.count()).join(links, "node", "left")
    about = written(about.select("node", "component", F.col("doc").alias("copy_of"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "copies"), "about")
    worded = joined(rows.where("node is not null").select("doc", "tag", "node"), about, "node", "copies", rows.count())
    wordless = rows.where("node is null").select("doc", "tag", F.lit(None).cast("long"), "doc", "doc", F.lit(0).cast("long"))
    return worded.select("doc", "tag", "component", "copy_of", "class_id", "n_links").union(wordless)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, tag (by which rows of equal keys are told apart, see `identified`), copy_of, class_id, n_links, worded (whether it has words).

    copy_of: the least key of the documents with the same set of shingles.
    n_links: how many other sets of shingles are similar to its own by the
    threshold or more. class_id: the least key of all that these links and copies
    connect. A text without words (or null) is its own class without links; one
    with fewer words than a shingle has all of them as its only shingle. Repeated
    rows are copies of each other. A null key is returned as the least long; an
    empty table gives an empty result; other columns don't matter. Runs Spark jobs
    when it is called, and writes tables to the shared folder.
    """
    classed = _classed(docs, threshold, size, recall, key, text)
    return classed.select(F.col("doc").alias(key), "tag", "copy_of", "class_id", "n_links", F.col("component").isNotNull().alias("worded"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each class of near duplicates one document with all its columns: the one with the least key, of equal keys the one whose text has the least tag, of rows that are equal in both the one with the least hash of its other columns. Documents without words all stay, each distinct row once."""
    some = F.coalesce(F.length(F.btrim(docs[text], F.lit(" \t\n\v\f\r"))) > 0, F.lit(False))
    worded, wordless = docs.where(some), docs.where(~some).distinct()
    classes = _classed(worded, threshold, size, recall, key, text)
    first = classes.groupBy("component").agg(F.min(F.struct("doc", "tag")).alias("first")).select("first.doc", "first.tag")
    others = F.xxhash64(F.to_json(F.struct(*[docs[c] for c in docs.columns if c != text], F.lit(0).alias("end")))).alias("others")
    rows = identified(worded, key, text, F.struct(*[docs[c] for c in docs.columns]).alias("row"), others).drop("text")
    kept = rows.join(first, ["doc", "tag"]).groupBy("doc", "tag").agg(F.min_by("row", "others").alias("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns]).unionByName(wordless)
