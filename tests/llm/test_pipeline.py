"""The pipeline's stages: what each promises, held against plain restatements."""

import random

import public_tokenizers
import pytest

import corpus_pipeline
from tests.llm import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    shared = " ".join(word() for _ in range(60))
    rows, labels = [], []
    for i in range(120):
        text = " ".join(word() for _ in range(r.randint(60, 150)))
        good = i % 4 > 0
        if i % 10 == 1:
            text += " " + shared + " card 4111111111111111 end"
        if i % 30 == 2:
            text = rows[1][1].replace(" ", "  ", 1)
        rows.append((i, text if good else text.upper().replace(" ", "!! "), "en", "s", len(text)))
        labels.append((i, int(good), 0))
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        after[name] = docs = spark.createDataFrame(docs.collect(), docs.schema)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(after[n].columns == columns for n in list(after)[:-1])
    good = {r.doc_id: r.text for r in after["quality"].collect()}
    assert set(good) == {i for i in range(120) if i % 4}
    one = {r.doc_id: r.text for r in after["near_duplicates"].collect()}
    assert set(one) == {c for _, c, *_ in [(x[0], x[2]) for x in brute.near_duplicates(list(good.items()))]}
    short = {r.doc_id: (r.text, r.n_chars) for r in after["repeats"].collect()}
    assert {i: len(t) for i, (t, _) in short.items()} == {k: n - gone for k, n, gone, *_ in brute.suffix_dedup(list(one.items()))}
    assert all(len(t) == n for t, n in short.values())
    clean = {r.doc_id: r.text for r in after["personal_data"].collect()}
    assert set(clean) == set(short) and not any("4111111111111111" in t for t in clean.values())
    assert all(clean[i] == t for i, (t, _) in short.items() if "4111" not in t)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths: dict = {}
    for p in after["packing"].collect():
        lengths[p.doc_id] = lengths.get(p.doc_id, 0) + p.length
    assert lengths == {i: len(tokenizer.encode(t).ids) + 1 for i, t in clean.items()}


def test_run_equals_the_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in rows.collect()} <= {i for i in range(120) if i % 4} and rows.count() > 50


def test_empty(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.collect() == []


def test_stages_on_odd_rows(spark, folder, tmp_path):
    """Null and empty texts, null and equal ids, repeated rows, and columns that operators use names of."""
    words = " ".join(f"word{i}" for i in range(70))
    rows = [
        (None, None, "a", 1, 0), (None, "", "b", 2, 0), (1, "", "x", 3, 0), (1, "", "y", 4, 0), (1, "", "y", 4, 0), (None, "short text", "n", 5, 9), (None, "other text", "n", 5, 9),
        (7, words, "q", 6, 1), (7, words, "p", 7, 1), (7, words, "p", 7, 1), (8, words + " tail", "r", 8, 2), (9, "card 4111 1111 1111 1111", "s", 9, 3),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string, node int, n_chars long").repartition(3)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    told = lambda df: sorted(map(str, df.collect()))
    assert told(stages["quality"](spark, docs, str(tmp_path))) == told(docs)
    one = stages["near_duplicates"](spark, docs, str(tmp_path))
    kept = [tuple(r) for r in one.collect()]
    others = {r for r in rows if not (r[1] or "").startswith("word")}
    assert one.columns == docs.columns and {r for r in kept if r in others} == others and len(kept) == len(others) + 1
    assert [r[0] for r in kept if r not in others] == [7]
    cut = stages["repeats"](spark, docs, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in cut) == sorted(str(r[0]) for r in rows) and all(r.text is not None and r.n_chars == len(r.text) for r in cut)
    assert {r.text for r in cut if r.doc_id == 7} == {words} and len(next(r.text for r in cut if r.doc_id == 8)) < 20
    private = stages["personal_data"](spark, docs, str(tmp_path)).collect()
    assert sum(r.text is None for r in private) == 1 and sum(r.text == "" for r in private) == 4 and not any("4111 1111" in (r.text or "") for r in private)
    pieces = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert sum(p.start == 0 for p in pieces) == len(rows) and sum(p.doc_id is None for p in pieces) == 4 and sum(p.doc_tokens == 1 for p in pieces) == 5
