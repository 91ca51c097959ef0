"""Versions, buckets, segments, kept embeddings and streams into the store."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kilnwork.operators import chunks as chunking
from kilnwork.operators import keyword_index, vectors
from kilnwork.plans import jobs
from kilnwork.sources import store
from kilnwork.streaming.updates import into_store

PAGES = "page_id long, title string, path string, content string"


def pages_of(spark, contents):
    return spark.createDataFrame([(i, f"t{i}", f"p/{i}", c) for i, c in contents.items()], PAGES)


def data_files(path):
    return sorted(p for p in Path(path).rglob("part-*.parquet"))


def stored(spark, path, table="chunks"):
    return store.current(spark, path).tables[table].read(spark, path)


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "store")
    into_store(path, buckets=8)(pages_of(spark, {i: f"text {i} " * 80 for i in range(40)}), 0)
    return path


def test_a_lost_file_is_not_a_smaller_store(spark, folder):
    file = data_files(folder)[3]
    file.rename(file.parent / "away")
    for use in (lambda: store.load_tables(spark, folder, ["chunks"]), lambda: into_store(folder)(pages_of(spark, {1: "new"}), 1)):
        with pytest.raises(store.DamagedStore):
            use()
    (file.parent / "away").rename(file)
    assert store.load_tables(spark, folder, ["chunks"])["chunks"].select("page_id").distinct().count() == 40


def test_a_cut_file_and_a_lost_manifest(spark, folder):
    file = data_files(folder)[0]
    whole = file.read_bytes()
    file.write_bytes(whole[:-1])
    with pytest.raises(store.DamagedStore):
        store.current(spark, folder)
    file.write_bytes(whole)
    manifest = Path(folder, store.current(spark, folder).name, store.MANIFEST)
    told = manifest.read_text()
    for broken in ("with its old checksum", told[:-5], "{}"):
        manifest.write_text(broken)
        with pytest.raises(store.DamagedStore):
            store.current(spark, folder)
        (manifest.parent / f".{store.MANIFEST}.crc").unlink(missing_ok=True)
    manifest.unlink()
    with pytest.raises(store.DamagedStore):
        store.current(spark, folder)


def test_the_second_of_two_writers_fails(spark, folder):
    before = store.current(spark, folder)
    version = lambda: store.Version(store.new_name(), before.name, before.tables, before.notes)
    first, second = version(), version()
    store.commit(spark, folder, first)
    with pytest.raises(store.StaleStore):
        store.commit(spark, folder, second)
    assert store.current(spark, folder).name == first.name


def test_a_writer_lost_before_it_moved_the_pointer(spark, folder):
    before = Path(folder, store.POINTER).read_text()
    into_store(folder)(pages_of(spark, {1: "new"}), 1)
    now = store.current(spark, folder).name
    Path(folder, f".{store.POINTER}.crc").unlink(missing_ok=True)
    Path(folder, store.POINTER).write_text(before)
    assert store.current(spark, folder).name == now != before
    into_store(folder)(pages_of(spark, {2: "newer"}), 2)
    assert {r.document for r in stored(spark, folder).where("page_id in (1, 2)").collect()} == {"new", "newer"}


def test_one_page_rewrites_one_bucket(spark, folder):
    before = store.current(spark, folder)
    into_store(folder)(pages_of(spark, {7: "changed"}), 1)
    after = store.current(spark, folder)
    new = set(after.tables["chunks"].files) - set(before.tables["chunks"].files)
    assert len({f.split("/")[-2] for f in new}) == 1 and all(f.startswith(after.name) for f in new)
    assert len(set(before.tables["chunks"].files) - set(after.tables["chunks"].files)) == len(new) == 1


def test_a_pages_lookup_reads_its_bucket(spark, folder):
    got = store.chunks_of(spark, folder, spark.createDataFrame([(7,), (7,), (None,), (999,)], "page_id long"))
    wanted = {f.split("/")[-2] for f in store.current(spark, folder).tables["chunks"].files}
    assert {r.page_id for r in got.collect()} == {7} and len({f.split("/")[-2] for f in got.inputFiles()}) <= 2 < len(wanted)
    assert "PushedFilters: [In(page_id" in got._jdf.queryExecution().executedPlan().toString() or "EqualTo(page_id" in got._jdf.queryExecution().executedPlan().toString()


def test_random_batches_equal_a_rebuild(spark, tmp_path):
    path, r = str(tmp_path / "store"), random.Random(3)
    put, now = into_store(path, index=True, embed=vectors.hash_embedding, buckets=4), {}
    for number in range(5):
        batch = {r.randrange(12): " ".join(r.choices(["alpha", "beta", "gamma", "delta"], k=r.randint(0, 120))) for _ in range(r.randint(1, 4))}
        put(pages_of(spark, batch), number)
        now |= batch
    rebuilt = vectors.embedded(chunking.chunk_pages(pages_of(spark, now)), "chunk_id", "document")
    rows = lambda df: sorted(map(str, df.select("chunk_id", "page_id", "chunk_index", "title", "path", "document", "embedding").collect()))
    assert rows(stored(spark, path)) == rows(rebuilt)
    version = store.current(spark, path)
    index, whole = keyword_index.opened(spark, path, version), keyword_index.build(rebuilt)
    for part in ("tokens", "postings", "terms", "corpus"):
        told = [sorted(str([round(x, 9) if isinstance(x, float) else x for x in row]) for row in getattr(i, part).select(*getattr(whole, part).columns).collect()) for i in (index, whole)]
        assert told[0] == told[1], part
    assert 1 < len(keyword_index._segments(version)) <= keyword_index.SEGMENTS
    # Of older versions only what the last two name is left.
    before = {f for v in (version.name, version.before) for t in store._manifest(spark, path, v).tables.values() for f in t.files}
    assert {str(p.relative_to(path)) for p in data_files(path)} >= before and len(list(Path(path).glob("v-*/manifest.json"))) == 2


def test_a_patch_writes_only_what_changes_and_segments_are_merged(spark, tmp_path):
    path = str(tmp_path / "index")
    chunks = chunking.chunk_pages(pages_of(spark, {i: f"alpha beta word{i}" for i in range(30)}))
    keyword_index.save(keyword_index.build(chunks), path)
    first = store.current(spark, path)
    sizes = []
    for i in range(5):
        new = chunking.chunk_pages(pages_of(spark, {i: f"other text{i}"}))
        keyword_index.save_patch(spark, path, new, chunks.where(F.col("page_id") == i), most=4)
        version = store.current(spark, path)
        sizes.append(len(keyword_index._segments(version)))
        if i == 0:
            assert set(first.tables["tokens-0"].files) <= {f for t in version.tables.values() for f in t.files} and version.tables["tokens-1"].rows == 1
    assert sizes == [2, 3, 4, 1, 2]
    want = keyword_index.build(chunks.where("page_id >= 5").unionByName(chunking.chunk_pages(pages_of(spark, {i: f"other text{i}" for i in range(5)}))))
    rows = lambda i: sorted((t.token, t.df, round(t.idf, 9)) for t in i.terms.collect())
    assert rows(keyword_index.load(spark, path)) == rows(want)


def test_a_batch_that_fails_halfway_is_replayed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    put = into_store(path, stream="s", index=True)
    put(pages_of(spark, {1: "one one", 2: "two"}), 0)
    real = keyword_index.patch_segment

    def broken(*a, **b):
        real(*a, **b)
        raise RuntimeError("lost")

    monkeypatch.setattr(keyword_index, "patch_segment", broken)
    with pytest.raises(RuntimeError):
        put(pages_of(spark, {2: "two two three"}), 1)
    monkeypatch.setattr(keyword_index, "patch_segment", real)
    assert {r.document for r in stored(spark, path).collect()} == {"one one", "two"}
    for _ in range(2):  # the second time it is there already
        into_store(path, stream="s", index=True)(pages_of(spark, {2: "two two three"}), 1)
    corpus = keyword_index.load_to_patch(spark, path).corpus.first()
    assert (corpus.n_chunks, corpus.n_tokens) == (2, 5) and store.current(spark, path).notes["streams"] == {"s": 1}


def test_a_stream_of_files_goes_on_where_it_ended(spark, tmp_path):
    import json

    source, path = tmp_path / "pages", str(tmp_path / "store")
    source.mkdir()

    def run(name, contents):
        (source / name).write_text("".join(json.dumps({"page_id": i, "title": "t", "path": f"p/{i}", "content": c}) + "\n" for i, c in contents.items()))
        stream = spark.readStream.schema(PAGES).json(str(source)).writeStream.foreachBatch(into_store(path, stream="pages", index=True))
        stream.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()

    run("a.json", {1: "one", 2: "two two"})
    run("b.json", {2: "second", 3: ""})
    assert {r.page_id: r.document for r in stored(spark, path).collect()} == {1: "one", 2: "second"}
    assert store.current(spark, path).notes["streams"] == {"pages": 1} and keyword_index.load_to_patch(spark, path).corpus.first().n_chunks == 2
    into_store(path, stream="pages", index=True)(pages_of(spark, {}), 2)
    assert stored(spark, path).count() == 2


def test_only_new_texts_reach_the_model(spark):
    counted = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def model(text):
        counted.add(1)
        return [float(len(text))]

    chunks = chunking.chunk_pages(pages_of(spark, {1: "same", 2: "other", 3: "gone"})).withColumn("embedding", F.array(F.lit(0.5)))
    after, _, counts = jobs.replace_pages(chunks, None, pages_of(spark, {3: "same", 4: "new text", 5: "new text"}), model)
    got = {r.page_id: (r.document, r.embedding) for r in after.collect()}
    assert got == {1: ("same", [0.5]), 2: ("other", [0.5]), 3: ("same", [0.5]), 4: ("new text", [8.0]), 5: ("new text", [8.0])}
    assert counted.value == 1 and {r.page_id for r in counts.collect()} == {3, 4, 5}


def test_a_report_cleans_once_and_reads_each_input_once(spark):
    counted = spark.sparkContext.accumulator(0)

    def count(text):
        counted.add(1)
        return text

    seen = F.udf(count, "string").asNondeterministic()  # so that Spark doesn't work it out for a filter and again for the result
    pages = spark.createDataFrame([(1, "t", "p/1", ["pdf"]), (2, "t", "p/2", None), (7, "t", "p/7", [])], "page_id long, title string, path string, tags array<string>")
    bodies = pages_of(spark, {2: "a long enough text", 7: "x"}).select("page_id", seen("content").alias("content"))
    held = chunking.chunk_pages(pages_of(spark, {1: "kept", 9: "orphan", 2: "old"}))
    table, report = jobs.index_report(pages, held, jobs.full_index(pages, bodies, held))
    row = report.first()
    assert tuple(row) == (3, 2, 1, 1, 3, 2) and report.columns == ["n_pages", "n_reindexed", "n_pdf", "n_orphans", "n_before", "n_after"]
    assert {r.document for r in table.collect()} == {"kept", "a long enough text"} and counted.value == 2


def shuffled_rows(spark, run):
    """Rows that run() shuffles."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()

    def told():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = told()
    run()
    return sum(n for k, n in told().items() if k not in before)


@pytest.fixture
def large(spark, monkeypatch):
    """Stores count as large: nothing is dealt together for being small, and Spark doesn't broadcast of itself."""
    monkeypatch.setattr(store, "SMALL", 0, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_chunks_are_not_shuffled(spark, folder, large):
    """F16: of a large store only the new chunks and page ids move, both in a batch and when pages are read."""
    changed = {i: f"changed {i}" for i in range(0, 40, 8)}
    n = stored(spark, folder).count()
    moved = shuffled_rows(spark, lambda: into_store(folder)(pages_of(spark, changed), 1))
    assert moved <= 5 * len(changed) < n
    want = {i: f"text {i} " * 80 for i in range(40)} | changed
    rows = lambda df: sorted((r.chunk_id, r.page_id, r.chunk_index, r.title, r.path, r.document) for r in df.collect())
    assert rows(stored(spark, folder)) == rows(chunking.chunk_pages(pages_of(spark, want)))
    pages = spark.range(1, 3000).withColumnRenamed("id", "page_id")
    got = store.chunks_of(spark, folder, pages)
    assert rows(got) == rows(chunking.chunk_pages(pages_of(spark, want)).where("page_id > 0"))
    assert shuffled_rows(spark, got.collect) == 0


@pytest.mark.parametrize("broadcast", [0, 10])
def test_kept_and_new_chunks_in_files_of_their_own(spark, tmp_path, monkeypatch, large, broadcast):
    """Buckets whose kept rows aren't dealt hold what a rebuilt store does, with the plain join as well; small files are merged in time."""
    monkeypatch.setattr(store, "BROADCAST_PAGES", broadcast, raising=False)
    monkeypatch.setattr(store, "SMALL", 6000, raising=False)
    monkeypatch.setattr(store, "MERGED", 2, raising=False)
    path, now, most = str(tmp_path / "store"), {}, []
    put = into_store(path, buckets=4)
    for number in range(6):
        batch = {i: f"batch {number} " * (i % 90) for i in range(number, 60, 1 + number)}  # page 0 has no text
        twice = pages_of(spark, batch).unionByName(pages_of(spark, {i: "a lesser text" for i in list(batch)[:4] if batch[i]}))
        put(twice, number)
        now |= batch
        files = [f.split("/")[-2] for f in store.current(spark, path).tables["chunks"].files]
        most.append(max(map(files.count, files)))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(stored(spark, path)) == rows(chunking.chunk_pages(pages_of(spark, now)))
    assert store.current(spark, path).tables["chunks"].rows == stored(spark, path).count()
    assert 1 < max(most) <= 4 and 1 in most[2:]


def test_rows_without_a_page_id_are_one_page(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(None, "t", "p", "a"), (None, "t", "p", "b"), (1, "t", "p", "x"), (1, "t", "p", "y"), (2, "t", "p", "z")]
    into_store(path)(spark.createDataFrame(rows, PAGES), 0)
    assert sorted((r.page_id or 0, r.document) for r in stored(spark, path).collect()) == [(0, "b"), (1, "y"), (2, "z")]
