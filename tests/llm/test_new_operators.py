"""Conversation repair, lexical search and sharding against plain restatements."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kilnwork.llm import lexical, repair, sharding

TALK = "conv_id long, turn long, role string, text string"


# Conversations.


def damage(rows):
    """{conversation: rows (turn, role, text) in order}."""
    space = lambda x: " " if x is None else str(x)
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text, own = space(role), space(text), out[conv]
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired lines) for rows (role, text, must go, truncated): all ways by cost, then audit."""
    allowed = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, last, lines = heapq.heappop(queue)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(lines)
        told = {"u": "user", "a": "assistant"}
        for initial in "ua":
            if (last, initial) in allowed:
                heapq.heappush(queue, (cost + 5, audit + "I", i, initial, (*lines, told[initial] + ":")))
        if i < len(rows):
            role, text, gone, short = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, last, lines))
            if not gone:
                if (last, role[:1]) in allowed:
                    heapq.heappush(queue, (cost + 5 * short, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
                for initial in "ua":
                    if (last, initial) in allowed:
                        heapq.heappush(queue, (cost + 1 + 5 * short, audit + "R", i + 1, initial, (*lines, f"{told[initial]}:{text}")))


def restated(rows):
    out = {}
    for conv, own in damage(rows).items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0))
        turns = {t for t, *_ in own if t is not None}
        seen, faults, told = set(), Counter(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\v\f\r")
            kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            faults[kind] += 1
            seen.add((role, text))
            told.append((role, text, kind in ("blank", "duplicate"), kind == "truncated"))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        cost, audit, lines = cheapest(told)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    for conv, *_ in rows:
        out.setdefault(conv, (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
    return out


def talks(seed, conversations=120, longest=14):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations)]:
        turn = -2
        for _ in range(r.randint(1, longest)):
            turn += r.choice([1, 1, 1, 2, 5])
            text = r.choice(["Good.", "Why?", "no end", "", " \n", "Yes! ", "a.b", None, f"t{r.random()}.", f"x {r.random()}"])
            rows.append((conv, None if turn == -1 else turn, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "sender", "User"]), text))
    r.shuffle(rows)
    return rows


def reported(df):
    return {r[0]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.mark.parametrize("limits", [{}, {"long_rows": 3, "piece_bits": 1}, {"long_chars": 0, "piece_bits": 3}])
def test_repair(spark, limits):
    rows = talks(len(limits))
    table = spark.createDataFrame(rows, TALK).withColumn("piece", F.lit("x")).repartition(3)
    got = reported(repair.report(repair.damaged(table), **limits))
    assert got == restated(rows)


def test_repair_of_one_long_conversation_and_of_repeats(spark):
    r = random.Random(5)
    rows = [(7, i, r.choice(["user", "assistant", "system"]), r.choice(["Same.", f"{i}.", f"{i}", "", "other?"])) for i in range(3000)]
    table = spark.createDataFrame(rows, TALK)
    expected = restated(rows)
    assert reported(repair.report(repair.damaged(table))) == expected == reported(repair.report(repair.damaged(table), long_rows=5000))
    turns = repair.repaired_turns(repair.damaged(table)).orderBy("position").collect()
    assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == expected[7][-1]
    twice = spark.createDataFrame([(1, 0, "user", "A."), (1, 0, "user", "A."), (1, 1, "assistant", "B.")], TALK)
    for limits in ({}, {"long_rows": 1, "piece_bits": 0}):
        assert reported(repair.report(repair.as_rows(twice), **limits))[1][:7] == (0, 0, 1, 0, 1, 2, "KDK")


def test_repair_of_nothing(spark):
    assert repair.report(repair.damaged(spark.createDataFrame([], TALK))).collect() == []


def test_there_are_few_vectors_and_blocks_are_their_steps():
    t = repair.Tables(3)
    assert len(t.vectors) < 100
    r = random.Random(1)
    import numpy as np

    for _ in range(20):
        pieces = [[r.randrange(repair.SYMBOLS) for _ in range(r.randint(0, 11))] for _ in range(5)]
        ends = [r.randrange(len(t.vectors)) for _ in pieces]
        got = t.behind(np.array([s for p in pieces for s in p], np.int64), np.cumsum([0, *map(len, pieces)]), np.array(ends)).tolist()
        expected = []
        for p, v in zip(pieces, ends):
            own = []
            for s in reversed(p):
                own.append(v)
                v = int(t.step[v, s])
            assert int(t.through(np.array(p, np.int64))[ends[pieces.index(p)]]) == v or pieces.count(p) > 1
            expected += own[::-1]
        assert got == expected


# Lexical search.

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def ranked(docs, items, top=10):
    bags = [(k, Counter(terms(t))) for k, t in docs]
    bags = [(k, b, sum(b.values())) for k, b in bags if b]
    n_docs, words = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for k, b, n in bags:
            m = 100 - 90 + 90 * n * n_docs // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if b[t])
            if score > 0:
                scored.append((-score, k is not None, k or 0, k))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_lexical_search(spark, monkeypatch, seed):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 50)
    monkeypatch.setattr(lexical, "FIRST", 4)
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "é", "한국", "7", "A", "a", "B-c"]
    text = lambda n: r.choice([" ", ", ", "\n"]).join(r.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, text(r.choice([0, 1, 3, 20, 200]))) for i in range(400)] + [(1000, None), (None, "w1 w39"), (1001, "w39 " * 5000), (1002, "w39"), (1003, "w39")]
    docs += [(2000 + i, docs[5][1]) for i in range(30)]
    items = [(i, text(r.choice([1, 4, 30]))) for i in range(12)] + [(50, None), (51, ""), (52, "unknown"), (53, "w39 w39"), (54, " ".join(words * 3 + [f"z{i}" for i in range(90)]))]
    got = found(lexical.search(spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit(1)).repartition(3), spark.createDataFrame(items, "item_id long, text string")))
    assert got == ranked(docs, items)
    monkeypatch.setattr(lexical, "GROUP_ITEMS", 4)
    assert found(lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))) == got


def test_lexical_search_leaves_groups_unscored():
    import numpy as np

    r = np.random.default_rng(3)
    row, term = np.unique(r.integers(0, 4000 * 30, 40_000))[:, None].T.repeat(2, axis=0)
    row, term = row // 30, term % 30
    block = lexical.Block(np.full(4000, 10), row, term, np.ones(len(row), np.int64), 4000, 40_000, 30)
    weights = np.arange(1, 31) ** 3
    best, scores, looked_at = block.best(np.arange(30), weights, np.arange(4000), 10)
    whole = np.bincount(row, (weights[term] * block.gives).astype(float), 4000).astype(int)
    assert scores.tolist() == sorted(whole.tolist(), reverse=True)[:10] and whole[best].tolist() == scores.tolist()
    assert looked_at < 2000


def test_lexical_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.where("false"), items).collect() == [] == lexical.search(docs, items.where("false")).collect()


# Shards.


def held(df, docs, shards, loosest):
    rows = df.collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(docs)
    assert all(r.size == size(r.text) and r.text_crc32 == zlib.crc32((r.text or "").encode()) and r.law == "bytes" and r.grown_shard is None for r in rows)
    slots, bytes_ = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        bytes_[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    share = sum(bytes_.values()) / shards
    assert all(abs(bytes_[s] - share) <= loosest(share) for s in range(shards)), (bytes_, share)
    return rows


def test_sharding(spark):
    r = random.Random(4)
    docs = [(i, "é" * r.randint(0, 200)) for i in range(3000)] + [(None, None), (None, ""), (5000, None)] + [(6000 + i, "copy " * 30) for i in range(40)]
    largest = 401
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shard", F.lit("x")).withColumn("size", F.lit(0)).repartition(3)
    rows = held(sharding.sharded(df), docs, 16, lambda share: max(largest, 0.02 * share) + 1)
    assert len({x.shard for x in rows if x.text == "copy " * 30}) == 1


def test_a_third_of_all_bytes_in_equal_texts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 1000)
    r = random.Random(2)
    docs = [(i, "same text") for i in range(2000)] + [(10_000 + i, str(r.random())[: r.randint(2, 18)]) for i in range(3000)]
    held(sharding.sharded(spark.createDataFrame(docs, "doc_id long, text string"), 16), docs, 16, lambda share: 0.01 * share + 19)


def test_shards_of_little_and_of_one_giant(spark):
    for docs in ([], [(1, "a")], [(1, "a")] * 5, [(1, "x" * 100_000)] + [(i, "y") for i in range(50)]):
        df = sharding.sharded(spark.createDataFrame(docs, "doc_id long, text string"), 4)
        held(df, docs, 4, lambda share: 100_001 + share)


def test_splitters_meet_their_tolerance(spark):
    keys = spark.range(200_000).select(F.xxhash64("id").alias("group"), F.col("id").alias("own"), F.lit(10).cast("long").alias("size"))
    bounds, total = sharding.splitters(keys, 7, Fraction(1, 1000))
    below = [keys.where(F.col("group") < g).count() * 10 for g, _ in bounds]
    assert total == 2_000_000 and all(abs(b - total * (i + 1) / 7) <= total / 7000 for i, b in enumerate(below))
