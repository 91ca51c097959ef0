"""Keyword index, fusion, sync, ingest and stores on small golden cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnwork.operators import chunks as chunking
from kilnwork.operators import fusion, ingest, keyword_index, prompts, sync, vectors
from kilnwork.plans import jobs
from kilnwork.sources import store, wiki
from kilnwork.sources.shared import written
from kilnwork.streaming.updates import into_store

CHUNK = "chunk_id string, page_id long, chunk_index int, title string, path string, document string"


@pytest.fixture(scope="module")
def chunks(spark):
    texts = ["수강 신청 기간", "수강 정정 기간 기간", "수강 학사 일정", "", "도서관 운영"]
    return spark.createDataFrame([(f"page_{i}_chunk_0", i, 0, f"t{i}", f"p/{i}", t) for i, t in enumerate(texts)], CHUNK).cache()


def test_bm25(spark, chunks):
    queries = spark.createDataFrame([(0, "수강 기간"), (1, "기간 기간"), (2, "수강"), (3, "없음"), (4, "a")], "query_id long, query string")
    got = {(r.query_id, r.page_id): (round(r.score, 6), r.bm25_rank) for r in keyword_index.search(keyword_index.build(chunks), queries).collect()}
    assert got == {
        (0, 1): (0.554303, 1), (0, 0): (0.487606, 2), (0, 2): (0.185159, 3),
        (1, 1): (0.791699, 1), (1, 0): (0.604894, 2),
        (2, 0): (0.185159, 1), (2, 2): (0.185159, 2), (2, 1): (0.158454, 3),
    }


@pytest.mark.parametrize("seed", range(2))
def test_search_equals_the_ranked_scores(spark, monkeypatch, seed):
    import random

    monkeypatch.setattr(keyword_index, "BLOCK", 64)
    r = random.Random(seed)
    words = [f"word{i}" for i in range(80)]
    often = [1 / (i + 1) for i in range(80)]
    rows = [(f"c{i}", i // 3, i % 3, "t", "p", " ".join(r.choices(words, often, k=r.randint(0, 40)))) for i in range(900)]
    rows += [(f"d{i}", 500 + i, 0, "t", "p", rows[7][5]) for i in range(60)]
    chunks = spark.createDataFrame(rows, CHUNK).repartition(4)
    queries = spark.createDataFrame([(i, " ".join(r.choices(words, k=r.randint(1, 25)))) for i in range(30)] + [(90, rows[7][5]), (91, "nothing"), (92, "")], "query_id long, query string")
    index = keyword_index.build(chunks)
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "page_id", "chunk_index")
    expected = keyword_index.scores(index, queries).withColumn("bm25_rank", F.row_number().over(order)).where("bm25_rank <= 20 and round(score, 9) > 0")
    told = lambda df: sorted((x.query_id, x.chunk_id, round(x.score, 6), x.bm25_rank) for x in df.collect())
    assert told(keyword_index.search(index, queries)) == told(expected)
    monkeypatch.setattr(keyword_index, "BROADCAST_ASKED", 50)
    assert told(keyword_index.search(index, queries)) == told(expected)


def test_a_search_leaves_most_chunks_unscored():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    often = 1 / np.arange(1, 401)
    pairs = np.unique(np.repeat(np.arange(8000), 30) * 400 + r.choice(400, 240_000, p=often / often.sum()))
    row, term = np.divmod(pairs, 400)
    rows = pa.table({"query_id": pa.array([0] * 12), "token": pa.array([str(t) for t in (0, 1, 2, 3, 5, 8, 13, 40, 90, 180, 250, 399)]), "qtf": pa.array([1] * 12), "idf": pa.array(np.log(8000 / np.bincount(term, minlength=400)[[0, 1, 2, 3, 5, 8, 13, 40, 90, 180, 250, 399]]))})
    asked = keyword_index.Asked(rows, 20)
    place = np.full(400, -1)
    place[[int(t) for t in asked.vocabulary.to_pylist()]] = np.arange(12)
    known = place[term] >= 0
    block = keyword_index.Postings(row[known], place[term[known]], np.ones(known.sum()), 8000, 12)
    terms, weights = asked.queries[0]
    found, scores = block.best(terms, weights, asked, 0)
    whole = np.bincount(row[known], weights[np.argsort(terms)][place[term[known]]], 8000)
    assert np.allclose(np.sort(scores)[-20:], np.sort(whole)[-20:]) and block.scored < 0.5 * (whole > 0).sum()


def test_empty_index(spark, chunks):
    queries = spark.createDataFrame([(0, "수강 기간")], "query_id long, query string")
    assert keyword_index.search(keyword_index.build(chunks.where("false")), queries).collect() == []
    assert jobs.hybrid_search(chunks.where("false"), keyword_index.build(chunks), queries).collect() == []


def test_patches_equal_a_rebuild(spark, chunks):
    index = keyword_index.build(chunks)
    some = chunks.where("page_id in (1, 3)")
    back = keyword_index.patch_add(keyword_index.patch_remove(index, some), some)
    rows = lambda i: sorted((r.token, r.df, round(r.idf, 9)) for r in i.terms.collect())
    assert rows(back) == rows(index)


def test_a_patch_tokenises_only_what_is_new(spark, chunks, tmp_path):
    path = str(tmp_path / "index")
    keyword_index.save(keyword_index.build(chunks.where("page_id <> 4")), path)
    index = keyword_index.patch_add(keyword_index.load_to_patch(spark, path), chunks.where("page_id = 4"))
    read = {f.split("/")[-2] for f in index.terms.inputFiles()}
    assert read == {"df-0", "sums-0"}
    removed = keyword_index.patch_remove(index, spark.createDataFrame([("page_0_chunk_0",), ("unknown",)], "chunk_id string"))
    whole = keyword_index.build(chunks.where("page_id <> 0"))
    for name in ("postings", "terms", "corpus"):
        rows = [sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in getattr(i, name).select(*getattr(whole, name).columns).collect()) for i in (removed, whole)]
        assert rows[0] == rows[1]
    nothing = keyword_index.patch_remove(index, chunks.select("chunk_id"))
    assert nothing.terms.collect() == [] and tuple(nothing.corpus.first()) == (0, 0, None)


def test_replaced_pages_and_index(spark, chunks):
    pages = spark.createDataFrame([(1, "t1", "p/1", "새 글자"), (3, "t3", "p/3", ""), (8, "t8", "p/8", "x" * 501)], "page_id long, title string, path string, content string")
    after, index, counts = jobs.replace_pages(chunks, keyword_index.build(chunks), pages)
    assert sorted((r.page_id, r.chunk_index) for r in after.collect()) == [(0, 0), (1, 0), (2, 0), (4, 0), (8, 0), (8, 1)]
    assert {r.page_id: r.n_chunks for r in counts.collect()} == {1: 1, 3: 0, 8: 2}
    terms = lambda i: sorted((r.token, r.df, round(r.idf, 9)) for r in i.terms.collect())
    assert terms(index) == terms(keyword_index.build(after))


def test_full_index_tables(spark, chunks):
    pages = spark.createDataFrame([(7, "t", "p/7", [])], "page_id long, title string, path string, tags array<string>")
    after, index = jobs.full_index_tables(pages, spark.createDataFrame([(7, "long enough a body")], "page_id long, content string"), chunks)
    assert [(r.chunk_id, len(r.embedding)) for r in after.collect()] == [("page_7_chunk_0", vectors.DIMENSIONS)] and index.corpus.first().n_tokens == 3


def test_an_embedding_hook_is_used_for_chunks_and_queries(spark, chunks):
    length = lambda c: F.array(F.length(c).cast("double"))
    asked = spark.createDataFrame([(0, "12345678")], "query_id long, query string")
    assert jobs.hybrid_search(chunks, None, asked, top=1, embed=length).first().chunk_id == "page_0_chunk_0"
    ready = chunks.withColumn("embedding", F.array(F.lit(1.0)))
    assert vectors.embedded(ready, "chunk_id", "document", length).first().embedding == [1.0]


def test_cleaning_stands_once_in_the_plan(spark, chunks):
    pages = spark.createDataFrame([(7, "t", "p/7", [])], "page_id long, title string, path string, tags array<string>")
    plan = jobs.full_index(pages, spark.createDataFrame([(7, "b")], "page_id long, content string"), chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<!--") == 1


def test_fusion_ties(spark):
    near = spark.createDataFrame([(0, "A", 1), (0, "B", 2), (0, "C", 3)], "query_id long, chunk_id string, vec_rank int")
    words = spark.createDataFrame([(0, "C", 1), (0, "D", 2), (0, "A", 3)], "query_id long, chunk_id string, bm25_rank int")
    got = [(r.chunk_id, r.vec_rank, r.bm25_rank, round(r.rrf_score, 6)) for r in fusion.fused(near, words).orderBy("fused_rank").collect()]
    assert got == [("A", 1, 3, 0.032266), ("C", 3, 1, 0.032266), ("B", 2, -1, 0.016129), ("D", -1, 2, 0.016129)]
    lists = [near.withColumnRenamed("vec_rank", "rank"), words.withColumnRenamed("bm25_rank", "rank")]
    assert [r.chunk_id for r in fusion.fused_rankings(lists).orderBy("fused_rank").collect()] == ["A", "C", "B", "D"]


def test_nearest_equals_the_expression(spark):
    rows = [(f"c{i}", i, 0, [float((i * j) % 7) for j in range(4)]) for i in range(40)]
    stored = spark.createDataFrame(rows, "chunk_id string, page_id long, chunk_index int, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0]), (1, [0.0] * 4)], "query_id long, embedding array<double>")
    got = {(r.query_id, r.chunk_id, round(r.distance, 9)) for r in vectors.nearest(stored, asked, 100).collect()}
    pairs = asked.withColumnRenamed("embedding", "e").crossJoin(stored).select("query_id", "chunk_id", F.round(vectors.squared_distance(F.col("e"), F.col("embedding")), 9))
    assert got == {tuple(r) for r in pairs.collect()}


def test_nearest_with_ties_and_large_norms(spark):
    rows = [(f"c{i}", i, 0, [1e4 + i % 5, -1e4, float(i % 3)]) for i in range(200)]
    stored = spark.createDataFrame(rows, "chunk_id string, page_id long, chunk_index int, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(0, [1e4, -1e4, 0.0])], "query_id long, embedding array<double>")
    expected = sorted(((r[3][0] - 1e4) ** 2 + r[3][2] ** 2, r[1]) for r in rows)[:25]
    assert [(round(r.distance, 9), r.page_id) for r in vectors.nearest(stored, asked, 25).orderBy("vec_rank").collect()] == expected
    assert vectors.nearest(stored.where("false"), asked).collect() == [] == vectors.nearest(stored, asked.where("false")).collect()


def test_probing_all_leaves_is_exact_and_some_nearly_so(spark):
    import numpy as np

    r = np.random.default_rng(2)
    rows = [(f"c{i}", i, 0, [float(x) for x in r.normal(0, 1, 16)]) for i in range(3000)]
    rows += [(f"d{i}", 5000 + i, 0, [1.0] * 16) for i in range(500)]  # copies
    stored = spark.createDataFrame(rows, "chunk_id string, page_id long, chunk_index int, embedding array<double>").repartition(3)
    asked = stored.where("page_id % 50 = 0").select(F.col("page_id").alias("query_id"), "embedding")
    found = lambda df: {(x.query_id, x.chunk_id) for x in df.collect()}
    exact = found(vectors.nearest(stored, asked, 10))
    tree = vectors.cell_tree(stored)
    assert tree.placed.count() == 3500 and tree.leaves.count() > 4
    assert found(vectors.nearest_probed(stored, asked, 10, tree, leaves=10_000)) == exact
    assert len(found(vectors.nearest_probed(stored, asked, 10, tree)) & exact) >= 0.9 * len(exact)
    assert vectors.nearest_probed(stored.where("false"), asked).collect() == []


def test_a_hot_leaf_is_dealt_over_keys(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "BLOCKS_A_KEY", 2)
    stored = spark.range(2000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.col("id").alias("page_id"), F.lit(0).alias("chunk_index"), F.array(F.lit(1.0), F.when(F.col("id") < 1500, 0.0).otherwise(F.rand(1))).alias("embedding"))
    tree = vectors.cell_tree(stored)
    assert tree.keys.agg(F.max("salts")).first()[0] > 20 and tree.blocks.groupBy("cell").agg(F.sum(F.size("c_chunk_id")).alias("n")).agg(F.max("n")).first()[0] < 100
    got = vectors.nearest_probed(stored, spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>"), 5, tree)
    assert [r.page_id for r in got.orderBy("vec_rank").collect()] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    import os

    from kilnwork import queries

    folder = f"/root/testdata/{sf}"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    stored = queries._vectors(spark, folder)
    asked = stored.where("page_id % 50 = 0").select(F.col("page_id").alias("query_id"), "embedding")
    found = lambda df: {(x.query_id, x.chunk_id) for x in df.collect()}
    exact = found(vectors.nearest(stored, asked))
    assert len(found(queries.QUERIES["vector_search_probed"](spark, folder).select("query_id", "chunk_id")) & exact) >= 0.9 * len(exact)


def test_leaves_spare_most_of_a_table_in_clusters(spark):
    import numpy as np

    r = np.random.default_rng(3)
    centres = r.normal(0, 1, (60, 24))
    rows = [(f"c{i}", i, 0, [float(x) for x in centres[i % 60] + r.normal(0, 0.15, 24)]) for i in range(6000)]
    stored = spark.createDataFrame(rows, "chunk_id string, page_id long, chunk_index int, embedding array<double>").repartition(3)
    asked = stored.where("page_id % 50 = 0").select(F.col("page_id").alias("query_id"), "embedding")
    tree = vectors.cell_tree(stored)
    leaves, cells = vectors.leaves_to_probe(tree, asked, 20)
    sizes = tree.placed.groupBy("leaf").count()
    read = vectors._leaves(tree, asked, leaves, cells).join(sizes, "leaf").agg(F.sum("count")).first()[0] / (120 * 6000)
    found = lambda df: {(x.query_id, x.chunk_id) for x in df.collect()}
    exact = found(vectors.nearest(stored, asked))
    assert read < 0.1 and len(found(vectors.nearest_probed(stored, asked, 20, tree)) & exact) >= 0.9 * len(exact)


def _hashed(spark, titles, key):
    return vectors.embedded(spark.createDataFrame([(i, t) for i, t in enumerate(titles)], f"{key} long, title string"), key, "title")


@pytest.mark.parametrize("seed", range(2))
def test_nearest_within_equals_nearest(spark, seed):
    import random

    r = random.Random(seed)
    words = [f"word{i}" for i in range(60)]
    titles = [" ".join(r.choices(words, k=r.choice([0, 1, 2, 3, 6, 9, 14]))) for _ in range(300)]
    titles += [t + " " + r.choice(words) for t in titles[:150]] + ["same title here"] * 40
    heads = _hashed(spark, titles, "page_id").select(F.concat(F.lit("c"), "page_id").alias("chunk_id"), "page_id", F.lit(0).alias("chunk_index"), "embedding")
    asked = _hashed(spark, r.sample(titles, 200) + ["same title here", ""], "query_id")
    rows = lambda df: sorted((x.query_id, x.chunk_id, round(x.distance, 6), x.vec_rank) for x in df.collect())
    for threshold in (0.2, 0.6):
        got = vectors.nearest_within(heads, asked, threshold, 3)
        assert rows(got) == rows(vectors.nearest(heads, asked, 3).where(F.round("distance", 9) <= threshold)) and rows(got)
        assert "Cartesian" not in got._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_nearest_within_of_other_vectors(spark):
    rows = [(f"c{i}", i, 0, [float(i), 1.0]) for i in range(30)]
    stored = spark.createDataFrame(rows, "chunk_id string, page_id long, chunk_index int, embedding array<double>")
    asked = spark.createDataFrame([(0, [3.0, 1.2]), (1, None)], "query_id long, embedding array<double>")
    assert [(r.page_id, r.vec_rank) for r in vectors.nearest_within(stored, asked, 1.5, 3).orderBy("vec_rank").collect()] == [(3, 1), (2, 2), (4, 3)]
    assert vectors.nearest_within(stored.where("false"), asked, 1.5, 3).collect() == []


def test_a_plan_that_only_creates_searches_for_nothing(spark):
    docs = spark.createDataFrame([(1, "d/T", "T", [1.0])], "doc_id long, path string, title string, embedding array<double>")
    assert [tuple(r) for r in ingest.plan(docs, None, None, "create").collect()] == [(1, "create", "d/T", None, "T")]


def test_sync(spark):
    pages = spark.createDataFrame([(1, ["pdf"]), (2, None), (3, [])], "page_id long, tags array<string>")
    stored = spark.createDataFrame([(f"page_{i}_chunk_0", i) for i in (1, 2, 9)], "chunk_id string, page_id long")
    _, others = sync.split_by_tag(pages)
    orphaned = sync.orphans(sync.existing_page_ids(stored), pages)
    gone = sync.to_purge(others, orphaned)
    ids = lambda df: sorted(r.page_id for r in df.collect())
    assert (ids(orphaned), ids(gone), ids(sync.purged(stored, gone))) == ([9], [2, 3, 9], [1])


def test_full_index(spark, chunks):
    pages = spark.createDataFrame([(1, "t", "p/1", ["pdf"]), (2, "t", "p/2", None), (7, "t", "p/7", [])], "page_id long, title string, path string, tags array<string>")
    bodies = spark.createDataFrame([(2, "short"), (7, "long enough a body")], "page_id long, content string")
    after = {r.chunk_id: r.document for r in jobs.full_index(pages, bodies, chunks).collect()}
    assert after == {"page_1_chunk_0": "수강 정정 기간 기간", "page_7_chunk_0": "long enough a body"}
    assert jobs.full_index(pages.where("false"), bodies, chunks).count() == 5


def test_ingest(spark):
    pages = spark.createDataFrame([(4, "T", "d/T", "ko", ["x"], "old"), (0, "Z", "d/Z", "ko", None, "zero")], "page_id long, title string, path string, locale string, tags array<string>, content string")
    heads = spark.createDataFrame([("a", 4, 0, "T", "d/T", [1.0, 0.0]), ("b", 9, 0, "G", "d/gone", [0.0, 1.0])], "chunk_id string, page_id long, chunk_index int, title string, path string, embedding array<double>")
    docs = spark.createDataFrame(
        [(1, "d/T", "T", "one", [5.0, 5.0]), (2, "d/new", "near", "two", [1.0, 0.1]), (3, "d/own", "own", "three", [9.0, 9.0]), (5, "d/x", "gone", "five", [0.0, 1.0]), (6, "d/Z", "zero", "six", [7.0, 7.0])],
        "doc_id long, path string, title string, markdown string, embedding array<double>",
    )
    plan = ingest.plan(docs, pages, heads)
    assert sorted((r.doc_id, r.action, r.path, r.page_id) for r in plan.collect()) == [(1, "update", "d/T", 4), (2, "update", "d/T", 4), (3, "create", "d/own", None), (5, "error", "d/gone", None), (6, "create", "d/Z", None)]
    assert {r.action for r in ingest.plan(docs, pages, heads, "create").collect()} == {"create"}
    after = {r.page_id: (r.title, r.tags, r.content) for r in ingest.applied(plan, docs, pages).collect()}
    assert after == {0: ("Z", None, "zero"), 4: ("near", ["pdf", "updated", "x"], "two"), 5: ("own", ["auto", "pdf"], "three"), 6: ("zero", ["auto", "pdf"], "six")}


def test_ingest_to_its_end(spark):
    pages = spark.createDataFrame([(4, "T", "d/T", "ko", ["x"], "old text"), (6, "U", "d/U", "ko", None, "other")], "page_id long, title string, path string, locale string, tags array<string>, content string")
    chunks = chunking.chunk_pages(pages)
    docs = jobs.prepared(spark.createDataFrame([(9, "d", "T", "new te\n\n-----\n\nxt"), (3, "d", "V v", "made")], "doc_id long, department string, title string, markdown string"))
    plan = ingest.plan(docs, pages, chunks.where("false").withColumn("embedding", F.array(F.lit(0.0))))
    after, cut, index, counts = jobs.apply_ingest(plan, docs, pages, chunks, keyword_index.build(chunks))
    assert {(r.page_id, r.path, r.content) for r in after.collect()} == {(4, "d/T", "new text"), (6, "d/U", "other"), (7, "d/V-v", "made")}
    assert {(r.chunk_id, r.document) for r in cut.collect()} == {("page_4_chunk_0", "new text"), ("page_6_chunk_0", "other"), ("page_7_chunk_0", "made")}
    assert {r.token for r in index.terms.collect()} == {"new", "text", "other", "made"} and {r.page_id for r in counts.collect()} == {4, 7}


def test_numbers_follow_the_order_of_keys(spark):
    keys = [7 * i % 1000 - 300 for i in range(1000)]
    got = {r.k: r.number for r in ingest.numbered(spark.createDataFrame([(k,) for k in keys], "k long").repartition(3), "k").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}
    assert ingest.numbered(spark.createDataFrame([], "k long"), "k").collect() == []


def test_similar_titles_look_at_three_chunks_only(spark):
    schema = "chunk_id string, page_id long, chunk_index int, title string, path string, embedding array<double>"
    doc = spark.createDataFrame([(1, [0.0])], "doc_id long, embedding array<double>")
    rows = [("a", 1, 0, "t", "p", [0.05**0.5]), ("b", 2, 0, "t", "p", [0.1**0.5]), ("c", 3, 0, "t", "q", [0.2**0.5])]
    assert [(r.path, r.place) for r in ingest.similar_titles(doc, spark.createDataFrame(rows, schema)).orderBy("place").collect()] == [("p", 1), ("q", 2)]
    rows = [("a", 1, 0, "t", "p", [0.01]), ("b", 2, 0, "t", "p", [0.02]), ("c", 3, 0, "t", "p", [0.03]), ("d", 4, 0, "t", "q", [0.15**0.5])]
    assert [r.path for r in ingest.similar_titles(doc, spark.createDataFrame(rows, schema)).collect()] == ["p"]


def test_histories_and_contexts(spark):
    talk = spark.createDataFrame([(0, i, r, f"{r[0]}{i}") for i, r in enumerate(["user", "assistant", "user", "assistant", "user"])], "conv_id long, turn long, role string, text string")
    hits = spark.createDataFrame([(0, 2, "two", "t", 1), (0, 1, "one", "t", 1), (0, 3, "", "u", 2)], "query_id long, fused_rank int, document string, title string, page_id long")
    row = jobs.build_prompts(talk, hits).first()
    assert [m.content for m in row.messages][1:3] == ["u2", "a3"]
    assert row.messages[-1].content == "[참고 문서]\none\n---\ntwo\n\n[질문]\nu4"
    queries = spark.createDataFrame([(0,), (1,)], "query_id long")
    assert {r.query_id: r.context for r in prompts.contexts(queries, hits).collect()}[1] == prompts.NO_HITS
    assert {r.query_id: r.titles for r in prompts.source_titles(queries, hits).collect()} == {0: ["t", "u"], 1: []}


def test_page_lists(spark):
    df = spark.createDataFrame([('{"data":{"pages":{"list":[{"id":1,"path":"a","title":"t","tags":["x"]},{"id":2}]}}}',), ("{}",), ("broken",), (None,)], "json string")
    assert [(r.page_id, r.tags) for r in wiki.page_list(df).orderBy("page_id").collect()] == [(1, ["x"]), (2, None)]
    mixed = spark.createDataFrame([('{"data":{"pages":{"list":[{"id":1,"locale":"ko"},{"id":2,"locale":"en"},{"id":3}]}}}',)], "json string")
    assert [r.page_id for r in wiki.page_list(mixed).orderBy("page_id").collect()] == [1, 3]
    assert [r.page_id for r in wiki.page_list(mixed, locale="en").orderBy("page_id").collect()] == [2, 3]


def test_store_versions(spark, chunks, tmp_path):
    path = str(tmp_path / "index")
    assert keyword_index.load(spark, path) is None
    keyword_index.save(keyword_index.build(chunks), path)
    keyword_index.save(keyword_index.build(chunks.where("page_id < 2")), path)
    assert keyword_index.load(spark, path).corpus.first().n_chunks == 2


def test_batches_into_store(spark, tmp_path):
    path, put = str(tmp_path / "chunks"), into_store(str(tmp_path / "chunks"))
    pages = spark.createDataFrame([(1, "t", "p", "x" * 600), (2, "t", "q", "y")], "page_id long, title string, path string, content string")
    put(pages, 0)
    put(pages.where("page_id = 1").withColumn("content", F.lit("new")), 1)
    stored = store.load_tables(spark, path, ["chunks"])["chunks"]
    assert sorted((r.chunk_id, r.document) for r in stored.collect()) == [("page_1_chunk_0", "new"), ("page_2_chunk_0", "y")]


def test_a_damaged_store_is_not_an_empty_one(spark, chunks, tmp_path):
    path = tmp_path / "chunks"
    put = into_store(str(path))
    pages = spark.createDataFrame([(1, "t", "p", "one"), (2, "t", "q", "two")], "page_id long, title string, path string, content string")
    put(pages, 0)
    version = (path / store.POINTER).read_text()
    (path / version).rename(path / "away")
    with pytest.raises(store.DamagedStore):
        put(pages.where("page_id = 1"), 1)
    (path / "away").rename(path / version)
    put(pages.where("page_id = 1"), 2)
    assert store.load_tables(spark, str(path), ["chunks"])["chunks"].count() == 2
    index = tmp_path / "index"
    keyword_index.save(keyword_index.build(chunks), str(index))
    (index / (index / store.POINTER).read_text() / "df-0").rename(index / "gone")
    assert keyword_index.load(spark, str(index)) is None  # a search goes on without it
    with pytest.raises(store.DamagedStore):
        keyword_index.load_to_patch(spark, str(index))


def test_a_page_twice_in_a_batch_and_old_versions(spark, tmp_path):
    path = tmp_path / "chunks"
    put = into_store(str(path))
    rows = [(1, "t", "p", x) for x in ("b", "c", "a")]
    for i in range(4):
        put(spark.createDataFrame(rows[i % 3 :] + rows[: i % 3], "page_id long, title string, path string, content string").repartition(3), i)
        assert [r.document for r in store.load_tables(spark, str(path), ["chunks"])["chunks"].collect()] == ["c"]
    assert len([x for x in path.iterdir() if x.name.startswith("v-")]) == 2


def test_chunks_by_prefix(spark):
    stored = chunking.chunk_pages(spark.createDataFrame([(i, "t", "p", "x" * 600) for i in (1, 11, -1)], "page_id long, title string, path string, content string"))
    wanted = spark.createDataFrame([(1,), (1,), (5,), (None,)], "page_id long")
    assert sorted(r.chunk_id for r in chunking.of_pages(stored, wanted).collect()) == ["page_1_chunk_0", "page_1_chunk_1"]


def test_a_plan_is_worked_out_once(spark):
    """a plan that is applied isn't run again for each of its uses."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    pages = spark.createDataFrame([(4, "T", "d/T", "ko", ["x"], "old")], "page_id long, title string, path string, locale string, tags array<string>, content string")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "doc_id long, markdown string")
    made = spark.createDataFrame([(i, "update" if i == 3 else "create", "d/T" if i == 3 else f"d/{i}", 4 if i == 3 else None, f"t{i}") for i in range(10)], "doc_id long, action string, path string, page_id long, title string")
    plan = made.mapInArrow(counted, made.schema)
    assert ingest.applied(plan, docs, pages).count() == 10 and seen.value == 10
    assert len(jobs.apply_ingest(plan, docs, pages, chunking.chunk_pages(pages))[1].collect()) == 10 and seen.value == 20


def test_few_pairs_of_titles_are_looked_at(spark):
    """titles of some words meet only if nearly all of what they hold is shared, and none that is near is lost."""
    import random

    r = random.Random(5)
    titles = [" ".join(f"w{r.randrange(4000)}" for _ in range(9)) for _ in range(2000)]
    titles += [t + " more" for t in titles[:200]]
    ours = _hashed(spark, titles, "vector").select("vector", "embedding")
    pairs = {(p.asked, p.vector) for p in vectors._candidates(ours, ours, 0.9, 64).collect()}
    x = np.array([v.embedding for v in ours.orderBy("vector").collect()])
    near = set(zip(*np.nonzero(x @ x.T >= 0.9)))
    assert near <= pairs and len(near) > 2 * 200 and len(pairs) < 3 * len(near)


def test_a_plan_is_not_broadcast(spark):
    """neither is the plan that is applied, whose titles and paths take far less room in files."""
    pages = spark.createDataFrame([(4, "T", "d/T", "ko", ["x"], "old")], "page_id long, title string, path string, locale string, tags array<string>, content string")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "doc_id long, markdown string")
    plan = spark.createDataFrame([(i, "update" if i == 3 else "create", "d/T" if i == 3 else f"d/{i}", 4 if i == 3 else None, f"t{i}") for i in range(10)], "doc_id long, action string, path string, page_id long, title string")
    made = ingest.changes(plan, docs, pages)
    text = made._jdf.queryExecution().executedPlan().toString()
    assert made.count() == 10 and text.count("SortMergeJoin") >= 2 and "BroadcastHashJoin [page_id" not in text and "BroadcastHashJoin [doc_id" not in text


def test_a_question_scores_few_chunks_of_a_block():
    """F1: long questions of common words score next to no chunk beyond their best ones, whether a product sums the common words or not."""
    import pyarrow as pa

    r = np.random.default_rng(3)
    often = 1 / np.arange(1, 301)
    words = lambda n: r.choice(300, n, p=often / often.sum())
    batch = pa.RecordBatch.from_pydict({"chunk_id": [f"c{i}" for i in range(6000)], "page_id": range(6000), "chunk_index": [0] * 6000, "tokens": [[f"w{t}" for t in words(n)] for n in r.integers(0, 60, 6000)]})
    df = np.bincount(np.concatenate([np.unique([int(t[1:]) for t in d.as_py()]).astype(int) for d in batch.column("tokens")]), minlength=300)
    asked = [(q, f"w{t}", int(n), float(np.log(6000 - df[t] + 0.5) - np.log(df[t] + 0.5))) for q in range(100) for t, n in zip(*np.unique(words(30), return_counts=True)) if df[t] < 3000]
    rows = pa.table([pa.array(c) for c in zip(*asked)], ["query_id", "token", "qtf", "idf"])
    block = next(keyword_index._blocks(iter([batch]), 8))
    found = []
    for shared in (True, False):
        asked = keyword_index.Asked(rows, 3)
        entries = keyword_index._block(block, 0, asked, 30.0, 1.5, 0.75)
        queries = asked.hopeful(entries.most)
        totals = entries.common(asked, queries) if shared else ((q, None) for q in queries)
        found.append({q: sorted(zip(*(x.tolist() for x in entries.best(*asked.queries[q], asked, q, total)))) for q, total in totals})
        assert entries.dense.any() == shared and len(found[-1]) == 100 and entries.scored < 100 * 6
    for q, (terms, weights) in enumerate(asked.queries):
        entries.weights[terms] = weights
        whole = np.round(entries.score(np.arange(6000)[np.diff(entries.first) > 0]), 9)
        entries.weights[terms] = 0
        best = np.flatnonzero(whole >= np.sort(whole)[-3])
        assert [s for _, s in found[0][q]] == [s for _, s in found[1][q]] and sorted(np.round([s for _, s in found[0][q]], 9)) == sorted(whole[best])


def test_embeddings_are_not_broadcast(spark, monkeypatch):
    """files of sparse embeddings are small, and what they hold is not; neither they nor their keys go through the driver."""
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(vectors, "written", kept)
    titles = [f"w{i % 50} w{i % 70} w{i}" for i in range(400)]
    heads = _hashed(spark, titles, "page_id").select(F.concat(F.lit("c"), "page_id").alias("chunk_id"), "page_id", F.lit(0).alias("chunk_index"), "embedding")
    found = vectors.nearest_within(heads, _hashed(spark, titles, "query_id"), 0.2, 3)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.count() >= 400 and "SortMergeJoin" in "".join(plans) and "Broadcast" not in "".join(plans)


def _counting(spark, df):
    """df, and a counter of how many of its rows have been worked out."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return df.mapInArrow(counted, df.schema), seen


def test_hits_are_found_once(spark):
    """what has been searched isn't searched again when its chunks are added."""
    chunks = spark.createDataFrame([("a", 1, "one"), ("b", 2, "two")], "chunk_id string, page_id long, document string").selectExpr("*", "'t' as title", "'p' as path")
    hits, seen = _counting(spark, spark.createDataFrame([(1, "a"), (1, "x")], "query_id long, chunk_id string"))
    assert {(r.chunk_id, r.document) for r in fusion.hydrated(hits, chunks).collect()} == {("a", "one"), ("x", "")} and seen.value == 2


def test_a_saved_index_reads_its_chunks_once(spark, tmp_path):
    """Tokens are written, and frequencies and sums counted from what is written."""
    rows = spark.createDataFrame([(f"c{i}", i, 0, f"word{i % 3} other") for i in range(9)], "chunk_id string, page_id long, chunk_index int, document string")
    chunks, seen = _counting(spark, rows)
    keyword_index.save(keyword_index.build(chunks), str(tmp_path / "index"))
    assert seen.value == 9
    more, seen = _counting(spark, rows.withColumn("chunk_id", F.concat("chunk_id", F.lit("n"))))
    keyword_index.save_patch(spark, str(tmp_path / "index"), more, rows.where("page_id < 3"))
    assert seen.value == 9
    index = keyword_index.load(spark, str(tmp_path / "index"))
    assert {(r.token, r.df) for r in index.terms.collect()} == {("word", 15), ("other", 15)} and index.corpus.first().n_chunks == 15


def test_blocks_that_cannot_help_are_skipped(spark, monkeypatch):
    """a query passes over blocks that can't reach its threshold, and blocks are made one by one."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"chunk_id": [f"c{i}" for i in range(1000)], "page_id": range(1000), "chunk_index": [0] * 1000, "tokens": [["common"] if i else ["rare", "common"] for i in range(1000)]})
    monkeypatch.setattr(keyword_index, "BLOCK", 100)
    blocks = list(keyword_index._blocks(iter([batch.slice(0, 750), batch.slice(750)])))
    assert [len(b.column("chunk_id")[0]) for b in blocks] == [100] * 10
    asked = keyword_index.Asked(pa.table({"query_id": [1, 1], "token": ["rare", "common"], "qtf": [1, 1], "idf": [3.0, 0.1]}), 1)
    looked = 0
    for b in blocks:
        entries = keyword_index._block(b, 0, asked, 1.0, 1.5, 0.75)
        for q in asked.hopeful(entries.most):
            looked += 1
            entries.best(*asked.queries[q], asked, q)
    assert looked == 1


def test_scores_are_summed_where_chunks_lie(spark):
    """no posting is shuffled; rows with the same id still count as one chunk."""
    rows = [("a", 1, 0, "one two two"), ("b", 2, 0, "two three"), ("c", 3, 0, "four"), ("d", 4, 0, "one"), ("e", 5, 0, "")]
    asked = spark.createDataFrame([(1, "one two one"), (2, "five"), (3, "four two")], "query_id long, query string")
    index = lambda some: keyword_index.build(spark.createDataFrame(some, "chunk_id string, page_id long, chunk_index int, document string"))
    made = keyword_index.scores(index(rows), asked)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r.query_id, r.chunk_id): r.score for r in made.collect()}
    assert set(got) == {(1, "a"), (1, "b"), (1, "d"), (3, "a"), (3, "b"), (3, "c")}
    found = {(r.query_id, r.chunk_id): r.score for r in keyword_index.search(index(rows), asked).collect()}
    assert found and all(abs(got[k] - v) < 1e-9 for k, v in found.items())
    twice = index([*rows, ("a", 1, 0, "two four")])
    parts = {(r.query_id, r.chunk_id): r.score for r in keyword_index.scores(twice, asked).collect()}
    assert set(parts) == set(got) and len(parts) == keyword_index.scores(twice, asked).count()
    alone = {(r.query_id, r.chunk_id, r.dl, r.token) for r in twice.postings.crossJoin(asked.select("query_id")).where("chunk_id = 'a'").collect()}
    assert len({d for _, _, d, _ in alone}) == 2


def test_vectors_are_compared_a_few_at_a_time(spark, monkeypatch):
    """however many vectors a task has, it compares them a block at a time, and rows, not lists of them, come to it."""
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"x": range(i)}) for i in (0, 5, 250, 45)]
    parts = list(vectors._rows(iter(batches), 100))
    assert max(map(len, parts)) == 100 and sum(map(len, parts)) == 300
    r = np.random.default_rng(8)
    stored = spark.createDataFrame([(f"c{i}", i, 0, r.normal(size=4).tolist()) for i in range(500)], "chunk_id string, page_id long, chunk_index int, embedding array<double>")
    asked = stored.where("page_id % 50 = 0").select(F.col("page_id").alias("query_id"), "embedding")
    rows = lambda df: sorted((x.query_id, x.chunk_id, round(x.distance, 9), x.vec_rank) for x in df.collect())
    few = rows(vectors.nearest(stored, asked, 5))
    tree = vectors.cell_tree(stored)
    assert "embedding" in tree.dealt.columns and "c_matrix" not in tree.dealt.columns
    assert rows(vectors.nearest_probed(stored, asked, 5, tree, leaves=10**6)) == few
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    assert rows(vectors.nearest(stored, asked, 5)) == few
