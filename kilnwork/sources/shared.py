"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"
#: Bytes up to which a table may lie in fewer row groups than there are cores, and is worth dealing over them.
SMALL = 64 << 20
_made: dict[str, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one in local mode (tests), an error on a cluster, whose executors wouldn't see it."""
    folder = spark.conf.get(FOLDER, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {FOLDER} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="kilnwork-")
        spark.conf.set(FOLDER, folder)
    return folder.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(JVM, Hadoop path, its file system)."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder. All that one application makes lies in one folder, which is deleted when Python ends."""
    root = f"{shared_folder(spark)}/kilnwork-{spark.sparkContext.applicationId}"
    if root not in _made:
        _, at, fs = file_system(spark, root)
        _made[root] = fs
        atexit.register(_removed, fs, at)
    return f"{root}/{uuid.uuid4().hex}/{name}"


def _removed(fs, at) -> None:
    try:
        fs.delete(at, True)
    except Exception:  # the JVM is gone already; the folder is the user's to clear then
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Run df, write it as a table in the shared folder and return the table: lost executors don't lose it, and its lineage is short."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt over all cores: tasks can't share a row group, and a small table may have a single one. Filters and columns still reach the scan. A table that isn't small is left as it is."""
    bytes_ = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if bytes_ <= SMALL else df


def merged(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """left joined with right, both sorted and never broadcast. The size of a written table is guessed by its compressed files: one of sparse embeddings has fifty times as much in memory, and a broadcast goes through the driver's."""
    return left.join(right.hint("merge"), on, how)
