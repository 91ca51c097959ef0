"""Stores in a folder that Spark reaches: chunk tables, and keyword indexes in versions.

A version is a manifest: for each of its tables the files, with their sizes, the
number of rows and the schema. Files are never changed, and a version may name files
that earlier ones wrote, so what stays needn't be written again. A version becomes
the current one when a link from the one before it, which nobody else may have made,
appears; readers see the old or the new one, and of two writers that began at the
same version the second fails.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import SMALL, file_system, written

POINTER, MANIFEST = "current.txt", "manifest.json"
#: Buckets of a chunk table by page.
BUCKETS = 64
#: Files a bucket from which small ones are merged.
MERGED = 8
#: Page ids that are broadcast to the chunks.
BROADCAST_PAGES = 1_000_000


class DamagedStore(RuntimeError):
    """There is a store, but its current version can't be read."""


class StaleStore(RuntimeError):
    """Another writer has made a new version meanwhile."""


def append_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("append").parquet(path)


def scan_chunks(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """All stored chunks, only these columns (all if none are named)."""
    stored = spark.read.parquet(path)
    return stored.select(*columns) if columns else stored


@dataclass
class Table:
    """files: their paths below the store's, with their sizes."""

    schema: str
    rows: int
    files: dict[str, int]

    def read(self, spark: SparkSession, path: str, files: Iterable[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.schema))
        names = [f"{path}/{f}" for f in (self.files if files is None else files)]
        # Folders' names (bucket=3) aren't columns.
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*names) if names else spark.createDataFrame([], schema)


@dataclass
class Version:
    name: str
    before: str | None
    tables: dict[str, Table]
    notes: dict = field(default_factory=dict)


def _read_text(fs, jvm, at) -> str | None:
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    except Py4JJavaError as e:  # a checksum that doesn't fit, say
        raise DamagedStore(f"{at} can't be read") from e
    finally:
        stream.close()


def _write_text(fs, at, text: str) -> None:
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def _rename(spark: SparkSession, fs, draft, target, overwrite: bool) -> None:
    jvm = spark.sparkContext._jvm
    options = jvm.org.apache.hadoop.fs.Options.Rename
    array = spark.sparkContext._gateway.new_array(options, 1)
    array[0] = options.OVERWRITE if overwrite else options.NONE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, array)


def _link(before: str | None) -> str:
    return f"after-{before or 'nothing'}.txt"


def current_name(spark: SparkSession, path: str) -> str | None:
    """The newest version: the pointer's, or one that links lead to from there, if a writer was lost before it moved the pointer."""
    jvm, folder, fs = file_system(spark, path)
    name = _read_text(fs, jvm, jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"))
    if name == "":
        raise DamagedStore(f"{path}/{POINTER} is empty")
    while (after := _read_text(fs, jvm, jvm.org.apache.hadoop.fs.Path(f"{path}/{_link(name)}"))) is not None:
        name = after
    return name


def _manifest(spark: SparkSession, path: str, name: str) -> Version:
    jvm, at, fs = file_system(spark, f"{path}/{name}/{MANIFEST}")
    text = _read_text(fs, jvm, at)
    if text is None:
        raise DamagedStore(f"{path}/{name} has no manifest")
    try:
        told = json.loads(text)
        return Version(name, told["before"], {n: Table(**t) for n, t in told["tables"].items()}, told["notes"])
    except (ValueError, KeyError, TypeError) as e:
        raise DamagedStore(f"the manifest of {path}/{name} can't be read") from e


def _sizes(spark: SparkSession, path: str, folders: Iterable[str]) -> dict[str, int]:
    """Files of these folders below path, with their sizes."""
    out = {}
    for folder in sorted(folders):
        _, at, fs = file_system(spark, f"{path}/{folder}")
        if fs.exists(at):
            out |= {f"{folder}/{s.getPath().getName()}": s.getLen() for s in fs.listStatus(at) if s.isFile()}
    return out


def current(spark: SparkSession, path: str) -> Version | None:
    """The current version, its files checked by name and size; None only if nothing was ever stored here. One that isn't whole raises DamagedStore, so that nobody takes it for an empty or a smaller one."""
    name = current_name(spark, path)
    if name is None:
        return None
    version = _manifest(spark, path, name)
    files = {f: n for t in version.tables.values() for f, n in t.files.items()}
    there = _sizes(spark, path, {f.rpartition("/")[0] for f in files})
    if wrong := [f for f, n in files.items() if there.get(f) != n]:
        raise DamagedStore(f"{len(wrong)} files of {path}/{name} are missing or of another size, {wrong[0]} among them")
    return version


def write_table(df: DataFrame, path: str, version: str, name: str, by: Column | None = None, order: tuple[str, ...] = (), deal: bool = True) -> Table:
    """Write a table for a version to come. With `by` (an int), rows of equal values of it lie in folders and files of their own, in `order`; without `deal` each task writes the rows that it has, into files of its own."""
    spark = df.sparkSession
    if by is None:
        df.write.parquet(f"{path}/{version}/{name}")
        folders = [f"{version}/{name}"]
    else:
        dealt = df.withColumn("bucket", by)
        dealt = (dealt.repartition("bucket") if deal else dealt).sortWithinPartitions("bucket", *order)
        dealt.write.partitionBy("bucket").parquet(f"{path}/{version}/{name}")
        _, at, fs = file_system(spark, f"{path}/{version}/{name}")
        folders = [f"{version}/{name}/{s.getPath().getName()}" for s in fs.listStatus(at) if s.isDirectory()]
    files = {f: n for f, n in _sizes(spark, path, folders).items() if f.endswith(".parquet")}
    table = Table(df.schema.json(), 0, files)
    table.rows = table.read(spark, path).count()  # from the files' footers
    return table


def new_name() -> str:
    return f"v-{time.time_ns():020d}-{uuid.uuid4().hex}"


def commit(spark: SparkSession, path: str, version: Version, keep: int | None = None) -> None:
    """Make a version the current one, if the one before it still is; else StaleStore."""
    jvm, _, fs = file_system(spark, path)
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    told = {"before": version.before, "tables": {n: vars(t) for n, t in version.tables.items()}, "notes": version.notes}
    _write_text(fs, at(f"{version.name}/{MANIFEST}"), json.dumps(told))
    draft = at(f"{version.name}/link.txt")
    _write_text(fs, draft, version.name)
    try:
        _rename(spark, fs, draft, at(_link(version.before)), False)
    except Exception as e:
        if fs.exists(at(_link(version.before))):
            raise StaleStore(f"{path} has moved on from {version.before}") from e
        raise
    _write_text(fs, at(f"{version.name}/pointer.txt"), version.name)
    _rename(spark, fs, at(f"{version.name}/pointer.txt"), at(POINTER), True)
    if keep is not None:
        _drop_old(spark, path, version, max(1, keep))


def _drop_old(spark: SparkSession, path: str, version: Version, keep: int) -> None:
    """Delete the versions before the latest `keep`, but for files that these still name."""
    _, folder, fs = file_system(spark, path)
    kept, before = [version], version.before
    while before and len(kept) < keep:
        try:
            kept.append(_manifest(spark, path, before))
        except DamagedStore:
            break
        before = kept[-1].before
    names = {v.name for v in kept}
    needed = {f for v in kept for t in v.tables.values() for f in t.files}
    for old in fs.listStatus(folder):
        name = old.getPath().getName()
        if name.startswith("after-") and name not in {_link(v.before) for v in kept}:
            fs.delete(old.getPath(), False)
        if not name.startswith("v-") or name in names or name > version.name:
            continue
        own = {f for f in needed if f.startswith(f"{name}/")}
        if not own:
            fs.delete(old.getPath(), True)
            continue
        folders = {f.rpartition("/")[0] for f in own}
        for table in fs.listStatus(old.getPath()):
            below = f"{name}/{table.getPath().getName()}"
            if not any(f == below or f.startswith(f"{below}/") for f in folders):
                fs.delete(table.getPath(), True)
            elif below not in folders:  # buckets
                for bucket in fs.listStatus(table.getPath()):
                    if f"{below}/{bucket.getPath().getName()}" not in folders:
                        fs.delete(bucket.getPath(), True)


def save_tables(tables: dict[str, DataFrame], path: str, keep: int | None = None, notes: dict | None = None) -> str:
    """Write tables as a new version under path. Returns the version's name. With `keep`, only so many of the latest versions stay; a reader of an older one has to load again. A damaged store may be saved anew; another writer's version meanwhile is a StaleStore."""
    spark = next(iter(tables.values())).sparkSession
    before, name = current_name(spark, path), new_name()
    made = {n: write_table(df, path, name, n) for n, df in tables.items()}
    commit(spark, path, Version(name, before, made, notes or {}), keep)
    return name


def load_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame] | None:
    """The current version's tables; None only if nothing was ever stored here, DamagedStore if it isn't whole."""
    try:
        version = current(spark, path)
        return None if version is None else {n: version.tables[n].read(spark, path) for n in names}
    except (PySparkException, KeyError) as e:
        raise DamagedStore(f"the current version under {path} can't be read") from e


def bucket(page_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(page_id), F.lit(buckets)).cast("int")


def _bucket_of(file: str) -> int:
    return int(file.split("/")[-2].removeprefix("bucket="))


def by_pages(chunks: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Chunks joined (left_semi, left_anti) with distinct page ids, which are counted: up to BROADCAST_PAGES are broadcast, so that the chunks stay where they lie; more are joined as Spark sees fit."""
    return chunks.join(F.broadcast(ids) if ids.count() <= BROADCAST_PAGES else ids, "page_id", how)


def chunks_of(spark: SparkSession, path: str, pages: DataFrame, table: str = "chunks") -> DataFrame:
    """The stored chunks of these pages (page_id): only their buckets' files are read, and rows lie there by page, so that row groups of other pages are skipped where few pages are asked for. Writes the page ids to the shared folder and collects the buckets' numbers, and up to 1,000 page ids."""
    version = current(spark, path)
    if version is None:
        raise DamagedStore(f"nothing is stored under {path}")
    wanted = written(pages.where("page_id is not null").select("page_id").distinct(), "wanted")
    of = {r[0] for r in wanted.select(bucket(F.col("page_id"), version.notes["buckets"])).distinct().collect()}
    stored = version.tables[table].read(spark, path, [f for f in version.tables[table].files if _bucket_of(f) in of])
    few = [r[0] for r in wanted.limit(1001).collect()]
    if len(few) <= 1000:
        return stored.where(F.col("page_id").isin(few))
    return by_pages(stored, wanted, "left_semi")


def replace_buckets(spark: SparkSession, path: str, version: Version | None, name: str, table: str, of: set[int], kept: DataFrame, new: DataFrame, buckets: int) -> Table:
    """A table whose buckets `of` are the rows `kept` of what lies there and the rows `new`, and whose other buckets are the files that the version has.

    Kept rows are written by the tasks that read them, into files beside the new rows', so
    that they aren't shuffled. If the buckets hold little, or many small files, kept and
    new rows are dealt together, and each bucket is one file again.
    """
    at, order = bucket(F.col("page_id"), buckets), ("page_id", "chunk_index")
    if version is None or table not in version.tables:
        return write_table(new, path, name, table, at, order)
    old = version.tables[table]
    sizes = [n for f, n in old.files.items() if _bucket_of(f) in of]
    if sum(sizes) <= SMALL or (len(sizes) >= MERGED * len(of) and sum(sizes) <= SMALL * len(sizes)):
        made = write_table(kept.unionByName(new), path, name, table, at, order)
    else:
        made = write_table(kept.unionByName(new.repartition(at)), path, name, table, at, order, deal=False)
    others = {f: n for f, n in old.files.items() if _bucket_of(f) not in of}
    out = Table(made.schema, 0, {**others, **made.files})
    out.rows = out.read(spark, path).count()
    return out
