"""Golden cases of cleaning, cutting, tokenising and page breaks."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from kilnwork.functions import pagebreaks, text
from kilnwork.operators import vectors


def values(spark, f, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_tokenize(spark):
    got = values(spark, text.tokenize, "학교에서 수강신청을 합니다", "학교으로", "에서", "는 나 A 7", "2026년 ABC12가", "Étion", None, "")
    assert got == [["학교", "수강신청", "합니다"], ["학교으"], ["에서"], [], ["2026", "abc", "12"], ["tion"], [], []]


@pytest.mark.parametrize(("n", "sizes"), [(0, []), (1, [1]), (450, [450]), (451, [451, 1]), (500, [500, 50]), (900, [500, 450]), (901, [500, 451, 1])])
def test_chunk_text(spark, n, sizes):
    assert [len(c) for c in values(spark, text.chunk_text, "é" * n)[0]] == sizes


def test_chunk_text_null_and_bad_overlap(spark):
    assert values(spark, text.chunk_text, None) == [[]]
    with pytest.raises(ValueError, match="overlap"):
        text.chunk_text(F.col("x"), 10, 10)


def test_chunks_rebuild_the_text(spark):
    source = "".join(chr(97 + i * 7 % 26) for i in range(2345))
    chunks = values(spark, lambda c: text.chunk_text(c, 100, 30), source)[0]
    assert "".join(c[:70] for c in chunks) == source


def test_noise_lines(spark):
    assert values(spark, text.is_noise_line, "   ", "-----", "------", "abcdefg---", "abcdef----", "ㅋㅋㅋㅋㅋㅋ") == [True, False, True, False, True, True]


def test_clean_markdown(spark):
    source = "# 공지\n\n본문 **강조** [링크](http://a.b) 안내\n\n|---|---|---|\n\n```\ncode\n```\n끝입니다"
    assert values(spark, text.clean_markdown, source, None, "") == ["공지 본문 강조 링크 안내 끝입니다", "", ""]


def test_page_path(spark):
    assert values(spark, lambda c: text.page_path(F.lit("교무처"), c), "  2026년 / 학사 일정(안)_v1.2 ") == ["교무처/2026년-학사-일정안_v12"]


def test_tags(spark):
    df = spark.createDataFrame([(["notice", "pdf"],), (None,)], "tags array<string>")
    assert [r[0] for r in df.select(text.merged_tags(F.col("tags"))).collect()] == [["notice", "pdf", "updated"], ["pdf", "updated"]]


def test_page_breaks(spark):
    cases = {
        "---\nfoo": "\n\nfoo",
        "학교\n\n-----\n\n에서 끝났다.": "학교에서 끝났다.",
        "문장이다.\n\n-----\n\n다음": "문장이다.\n\n다음",
        "|번호|이름|\n|---|---|\n|1|가|\n\n-----\n\n|---|---|\n|2|나|": "|번호|이름|\n|---|---|\n|1|가|\n|2|나|",
        "": "",
        "one": "one",
        "hy-\nphen": "hyphen",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id int, text string")
    got = {r.id: r.text for r in pagebreaks.merge_page_breaks(df, "id", "text").collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_page_breaks_of_null_and_repeated_keys(spark):
    rows = [(None, "a"), (1, "x\ny"), (1, "p\nq"), (None, None)]
    got = pagebreaks.merge_page_breaks(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, "a"), (1, "x\ny"), (1, "p\nq"), (None, "")], key=str)


def plain_without_rules(text):
    out, last = [], ""
    for line in text.split("\n"):
        rule = re.fullmatch(r"\|(?:[-:]+\|)+", line.strip())
        if rule and re.match(r"\|\s*[0-9]+\s*\|", last):
            continue
        if line.strip() and not rule:
            last = line.strip()
        out.append(line)
    return "\n".join(out)


def plain_joined(parts):
    text = parts[0]
    for part in parts[1:]:
        tail, head = text.rstrip(), part.lstrip()
        gap = "\n" if tail.endswith("|") and head.startswith("|") else "" if tail and tail[-1] not in pagebreaks.SENTENCE_END else "\n\n"
        text = tail + gap + head
    return text


def test_page_breaks_equal_a_plain_loop(spark):
    r = random.Random(4)
    lines = ["| 1 | a |", "|2|", "|---|", "|:-|-:|", " |--| ", "||", "|-||-|", "", "  ", "text", "end.", "|", "| x |", "-|-"]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randint(0, 12))) for _ in range(400)]
    assert values(spark, pagebreaks.without_repeated_rules, *texts) == [plain_without_rules(t) for t in texts]
    parts = [[r.choice([" ", "", "a ", " b.", "|c|", "\n|d|\n", "e|", "f"]) for _ in range(r.randint(1, 6))] for _ in range(300)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "i int, p array<string>")
    assert [x[0] for x in df.orderBy("i").select(pagebreaks.joined_segments(F.col("p"))).collect()] == [plain_joined(p) for p in parts]


def test_runs_and_spaces(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,)], "t array<string>")
    got = df.select(text.runs(F.col("t")), text.counts(F.col("t"))).collect()
    assert [None if r[0] is None else [tuple(x) for x in r[0]] for r in got] == [[("a", 1), ("b", 2)], [], []] and [r[1] for r in got] == [[1, 2], [], []]
    spaces = [" ", "\t", "\u00a0", "\u3000", "x", "y y", "\n"]
    r = random.Random(6)
    texts = ["".join(r.choice(spaces) for _ in range(r.randint(0, 9))) for _ in range(200)]
    assert values(spark, text.collapsed, *texts) == [" ".join(t.split()) for t in texts]


def test_a_hash_embedding_counts_tokens(spark):
    got = values(spark, text.tokenize, "aa bb aa")[0]
    buckets = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 64 for t in got]
    norm = sum(buckets.count(b) ** 2 for b in set(buckets)) ** 0.5
    found = values(spark, vectors.hash_embedding, "aa bb aa", "", None)
    assert found[0] == pytest.approx([buckets.count(b) / norm for b in range(64)]) and found[1] == [0.0] * 64 == found[2]
