"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, as in tests, a temporary one is set for the session, if all of it runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sparkweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Tables written in this process and not deleted yet, in order; see clear().
_paths: list[str] = []


def mark() -> int:
    """A place in the order of intermediate tables; written_since() names those that are written after it."""
    return len(_paths)


def written_since(place: int) -> list[str]:
    return _paths[place:]


def clear(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes intermediate tables of this process, all or those that are named, once the results that were made from them have been written or read."""
    jvm = spark.sparkContext._jvm
    for name in list(_paths if paths is None else paths):
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if name in _paths:
            _paths.remove(name)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    _paths.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _paths[-1]


#: Rows of a narrow table for each file.
ROWS_PER_FILE = 250_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back, so that a lost executor costs no more than the stage at hand. Where the number of ``rows`` is known,
    it decides the number of files, so that small tables of many rounds don't come in as many files as there are partitions."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    with tidy_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_size(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, by which operators size their shards."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def collect_garbage(spark: SparkSession) -> None:
    """Has the executors' JVMs collect their garbage: heap that earlier work has grown goes back to the system, and so do buffers outside the heap, which
    nothing else lets go of while the heap has room. One short task for each core, dealt to all executors."""
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("collected")).write.format("noop").mode("overwrite").save()


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, a write lets go of its own shuffle files as it ends, which no other plan can read; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Rows reach Python in Arrow batches of at most ``most`` bytes, or of fewer if the session says so."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
        spark.conf.set(key, str(most))


def discard(df: DataFrame) -> None:
    """Deletes a table made by written() once a later one has been written from it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folder = shared_folder(spark)
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        if jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath() == path.getParent().toUri().getPath():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
