import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from kilnwork.llm import lz_dedup, suffix_dedup
from kilnwork.llm.windows import _ANCHOR, Grain, _listed, frequent_grams, identified
from tests.llm import brute


def corpus(seed, words, longest):
    """Texts made of shared passages, with edits, copies, nulls, empty texts and repeated keys."""
    r = random.Random(seed)
    vocabulary = ["ab", "ba", "é", "x", "abba", "日本", "q.", "z"] if seed % 2 else [f"w{i}" for i in range(40)]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(20, longest))] for _ in range(8)]
    rows = [(None, None), (5, ""), (6, "short"), (None, " ".join(passages[0]))]
    for k in range(words):
        text = []
        for _ in range(r.randint(0, 4)):
            text += [w if r.random() > 0.01 else r.choice(vocabulary) for w in r.choice(passages)]
            text += [r.choice(vocabulary) for _ in range(r.randint(0, 30))]
        rows.append((r.randint(0, words), r.choice([" ", "  ", "\n"]).join(text)))
    rows += rows[4:8] + [(7, "a" * 350), (8, "ab" * 200), (9, "lo " * 90)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(k, "x", t, "y") for k, t in rows], "doc_id long, anchor string, text string, doc string").repartition(3)


@pytest.mark.parametrize(("seed", "giant", "rare"), [(1, 20_000, 256), (2, 20_000, 4), (2, 2, 256), (3, 3, 10)])
def test_suffix_dedup_equals_brute_force(spark, seed, giant, rare):
    rows = corpus(seed, 60, 90)
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(table(spark, rows), giant=giant, rare=rare).collect())) == brute.suffix_dedup(rows)


@pytest.mark.parametrize(("seed", "giant", "rare"), [(1, 20_000, 256), (2, 20_000, 4), (4, 2, 256), (5, 3, 10)])
def test_lz_dedup_equals_brute_force(spark, seed, giant, rare):
    rows = corpus(seed, 60, 90)
    assert sorted(map(tuple, lz_dedup.lz_dedup(table(spark, rows), giant=giant, rare=rare).collect())) == brute.lz_dedup(rows)


def test_frequent_grams_leave_their_contexts_to_others(spark):
    r = random.Random(8)
    shared = "".join(r.choice("abcdefgh ") for _ in range(300))
    rows = [(i, "".join(r.choice("ijklmnop ") for _ in range(150)) + shared + "".join(r.choice("ijklmnop ") for _ in range(150))) for i in range(400)]
    source, grain = identified(table(spark, rows), "doc_id", "text"), Grain(False, suffix_dedup.WIDTH, suffix_dedup.GRAM)
    hashes = frequent_grams(source, grain)
    assert len(hashes) == 300 - suffix_dedup.GRAM + 1
    most = []
    for these in (hashes[:0], hashes):
        listed = source.mapInArrow(_listed(grain, False, these), _ANCHOR)
        most.append(listed.groupBy("anchor").agg(F.countDistinct("context").alias("n")).agg(F.max("n")).first()[0])
    assert most[0] > 300 and most[1] < 100
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(table(spark, rows)).collect())) == brute.suffix_dedup(rows)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.suffix_dedup(empty).collect() == [] == lz_dedup.lz_dedup(empty).collect()


def test_blind_trie_sorts():
    r = random.Random(3)
    for _ in range(200):
        n = r.randint(1, 9)
        strings = [bytes(r.choice(b"ab\0") for _ in range(n)) for _ in range(r.randint(1, 30))]
        order, common = suffix_dedup.blind_trie([int.from_bytes(s, "big") for s in strings], n)
        got = [strings[i] for i in order]
        assert got == sorted(strings)
        for i in range(1, len(got)):
            assert common[i] == next((d for d in range(n) if got[i][d] != got[i - 1][d]), n)


def test_suffix_order_sorts():
    r = np.random.default_rng(1)
    texts, group = r.integers(97, 99, (300, 60)).astype(np.uint8), r.integers(0, 9, 300)
    texts[::3] = texts[0]
    texts[::3, 50:] = r.integers(97, 99, (100, 10))
    order, common = suffix_dedup.suffix_order(texts, group)
    rows = [(group[i], texts[i].tobytes()) for i in order]
    assert rows == sorted(rows)
    for i in range(1, 300):
        expected = next((d for d in range(60) if rows[i][1][d] != rows[i - 1][1][d]), 60) if rows[i][0] == rows[i - 1][0] else 0
        assert common[i] == expected


@pytest.mark.parametrize("depth", [0, 1, 3, 9])
def test_multikey_quicksort_sorts(depth):
    r = np.random.default_rng(depth)
    symbols, group = r.integers(0, 3, (500, 6)).astype(np.uint64) << np.uint64(62), r.integers(0, 4, 500)
    order, of = suffix_dedup.multikey(symbols, group, depth)
    rows = [(group[i], *symbols[i, :depth].tolist()) for i in order]
    assert rows == sorted(rows) and [a == b for a, b in zip(rows, rows[1:])] == (of[1:] == of[:-1]).tolist()


def test_equal_crcs_under_one_key(spark):
    """A text and another of the same CRC-32 keep their own spans."""
    r, seen = random.Random(3), {}
    for _ in range(400_000):
        end = f"{r.randrange(10**9)}"
        seen[zlib.crc32(("x" * 150 + end).encode())] = end
    while True:
        other = f"{r.randrange(10**9)}"
        hit = seen.get(zlib.crc32(("y" * 350 + other).encode()))
        if hit is not None:
            break
    rows = [(None, "x" * 150 + hit), (None, "y" * 350 + other)]
    assert len({r.tag for r in identified(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}) == 2
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute.suffix_dedup(rows)
