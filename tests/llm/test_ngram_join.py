import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnwork.llm import ngram_join
from kilnwork.llm.components import components, joined
from tests.llm import brute


def corpus(seed):
    r = random.Random(seed)
    rows = [(None, None), (1, ""), (2, "a b"), (3, "a  b"), (4, "a b c"), (None, "lone words here"), (2, "x y z")]
    key = 10
    for _ in range(25):
        base = [f"w{r.randint(0, 300)}" for _ in range(r.randint(4, 200))]
        for _ in range(r.choice([1, 1, 2, 3, 12])):
            text = list(base)
            for _ in range(r.randint(0, 5)):
                text[r.randrange(len(text))] = f"w{r.randint(0, 300)}"
            rows.append((key, " ".join(text)))
            key += r.randint(0, 1)
    return rows + rows[5:15]


@pytest.mark.parametrize(("seed", "block"), [(1, 256), (2, 256), (3, 3)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, 0, "n") for k, t in rows], "doc_id long, text string, node int, leader string").repartition(3)
    got = ngram_join.near_duplicates(df).select("doc_id", "copy_of", "class_id", "n_links").collect()
    assert sorted(map(tuple, got)) == brute.near_duplicates(rows)


def test_a_hot_prefix_meets_in_blocks(spark, monkeypatch):
    """Thousands of nodes of one prefix: no unit has more than two blocks, and every two nodes meet in one."""
    monkeypatch.setattr(ngram_join, "GATHERED", 256)
    trees = [lambda i: (5).to_bytes(16, "big"), lambda i: (7 if i % 100 == 0 else i + 1000).to_bytes(8, "big") + bytes(8)]
    rows = [(i, bytearray(b"".join(t(i) for t in trees) + b"".join(((t << 32) + i).to_bytes(8, "big") + bytes(8) for t in range(2, 16)))) for i in range(2000)]
    units = {}
    for r in ngram_join._met(spark.createDataFrame(rows, "node long, signature binary"), 4).collect():
        units.setdefault((r.prefix, r.a, r.b), set()).add(r.node)
    small = [u for u in units if (u[1], u[2]) == (0, 0) and len(units[u]) == 20]
    assert len({u[0] for u in units}) == 2 and len(small) == 1 and max(map(len, units.values())) <= 2 * 1.3 * 256
    assert {(x, y) for u in units.values() if len(u) > 20 for x in u for y in u if x < y} == {(x, y) for y in range(2000) for x in range(y)}


def test_the_trie_is_walked_until_groups_are_one():
    """Groups are what likeness connects within a prefix, whatever the order; nothing is grouped across prefixes."""
    r = np.random.default_rng(5)
    n, width = 400, ngram_join.TREES * ngram_join.DEPTH
    base = r.integers(0, 1 << 16, (12, width)).astype(np.uint16)
    kind = r.integers(0, 12, n)
    signatures = base[kind].copy()
    change = r.random((n, width)) < 0.12
    signatures[change] = r.integers(0, 1 << 16, int(change.sum()))
    signatures[:, :4] = 9  # one shortest prefix, shared by all
    point = np.sort(r.integers(0, 2, n))
    order = np.lexsort((*signatures[:, 7::-1].T, point))
    kind, signatures = kind[order], signatures[order]
    label = ngram_join.walked(point, signatures[:, :8], signatures, 4, 0.8)
    first = {}
    for i in range(n):
        first.setdefault((point[i], kind[i]), i)
    assert [first[point[i], kind[i]] for i in range(n)] == label.tolist()


def test_recall_of_pairs_at_the_threshold(spark):
    """2,000 pairs at a similarity of 81 / 99, and for each a text at 70 / 90, which is no link."""
    r, rows = random.Random(21), []
    for i in range(2000):
        words = [f"w{r.randrange(10**9)}" for _ in range(94)]
        other = words[:]
        other[47:52] = [f"w{r.randrange(10**9)}" for _ in range(5)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(other)), (3 * i + 2, " ".join(words[:74]))]
    got = {x.doc_id: x.n_links for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[3 * i] <= 1 and got[3 * i + 1] <= 1 and got[3 * i + 2] == 0 for i in range(2000))
    assert sum(got[3 * i] == 1 == got[3 * i + 1] for i in range(2000)) >= 0.999 * 2000


def test_equal_crcs_under_one_key(spark):
    seen = {}
    r = random.Random(1)
    while True:
        text = " ".join(f"w{r.randrange(10**6)}" for _ in range(8))
        crc = zlib.crc32(text.encode())
        if crc in seen:
            break
        seen[crc] = text
    rows = [(None, text), (None, seen[crc])]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({x.tag for x in got}) == 2 and sorted(x.text for x in ngram_join.one_of_each(spark.createDataFrame([(1, text), (1, seen[crc]), (1, text)], "doc_id long, text string")).collect()) == sorted([text, seen[crc]])


def test_documents_that_share_half_their_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GATHERED", 256)
    r = random.Random(9)
    header, rows = [f"h{i}" for i in range(70)], []
    for i in range(2000):
        body = [f"w{r.randrange(10**6)}" for _ in range(30)]
        rows.append((i, " ".join(header + body)))
        if i % 20 == 0:
            rows.append((10_000 + i, " ".join(header + body[:-1] + ["other"])))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(x.doc_id, x.class_id, x.n_links) for x in got} == {(k, k % 10_000, int(k % 20 == 0)) for k, _ in rows}


def test_empty(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_prefixes_shorten_until_the_recall():
    assert ngram_join.prefix_depth(0.8, 0.9995) == 4
    assert ngram_join.prefix_depth(0.99, 0.9) == 8


def test_frequent_keys_are_joined_like_others(spark):
    rows = spark.createDataFrame([(0 if i % 2 else i, i) for i in range(3000)], "k long, v long").repartition(3)
    keyed = rows.groupBy("k").count().withColumn("twice", 2 * F.col("k"))
    assert {tuple(r) for r in joined(rows, keyed, "k", "count", 3000).collect()} == {(0 if i % 2 else i, i, 0 if i % 2 else 2 * i) for i in range(3000)}


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 40), (40, 70), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 70: 40, 100: 40}


def test_components_of_paths_stars_and_random_graphs(spark):
    dice = random.Random(3)
    path = list(range(1000, 1060))
    dice.shuffle(path)
    links = list(zip(path, path[1:])) + [(2000, x) for x in range(1900, 1990)] + [(x, 3000) for x in range(3001, 3050)]
    links += [(dice.randrange(4000, 4300), dice.randrange(4000, 4300)) for _ in range(200)]
    root = {x: x for link in links for x in link}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    linked = {x for a, b in links if a != b for x in (a, b)}
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in rows) == sorted((x, top(x)) for x in linked)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_keeps_distinct_rows(spark):
    text = "one two three four five six"
    rows = [(None, None, "a", 1), (None, "", "b", 2), (1, "", "x", 3), (1, "", "y", 4), (1, "", "y", 4), (2, " \n", "z", 5), (7, text, "q", 9), (7, text, "p", 9), (7, text, "p", 9), (8, text, "r", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string, node int")
    kept = [sorted(map(str, ngram_join.one_of_each(df.repartition(n)).collect())) for n in (1, 3)]
    assert kept[0] == kept[1] and len(kept[0]) == 6
    assert {r.tag for r in ngram_join.one_of_each(df).collect()} >= {"a", "b", "x", "y", "z"}
    assert ngram_join.one_of_each(df.where("false")).collect() == []
