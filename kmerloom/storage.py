"""Tables that are cut off from their lineage, and ranks over a whole table."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's setting that removes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables written by this process and not yet deleted.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        found = sc.getCheckpointDir()
        if not found:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = tempfile.mkdtemp(prefix="kmerloom-")
            sc.setCheckpointDir(found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession, keep: bool = False) -> str:
    """Path of a folder in the shared folder, to be written; it goes with the ``scratch`` block, or, with ``keep``, when the JVM ends."""
    path = f"{shared_dir(spark)}/kmerloom/{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    if not keep:
        _written.append(path)
    return path


def materialize(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that it ran. The
    files go with the ``scratch`` block they were written in, or, with ``keep``, when the JVM ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, keep)
    with _cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """What the block's queries have shuffled goes when they are done, not when the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def drain(df: DataFrame) -> None:
    """Work out all rows of ``df``, for what is observed on them; nothing is written."""
    with _cleaned(df.sparkSession):
        df.write.format("noop").mode("overwrite").save()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``materialize`` wrote inside the block, when the block's results have been used or written."""
    kept = len(_written)
    try:
        yield
    finally:
        for path in _written[kept:]:
            fs, at = _hadoop(spark, path)
            fs.delete(at, True)
        del _written[kept:]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores: a table whose files split into fewer parts than there are cores is dealt out by ``keys``.

    A table of more files stays as its scan deals it, so that no text is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(4 * cores, *(F.col(k) for k in keys))


def stamp(spark: SparkSession, path: str) -> tuple[str, int, int]:
    """A path with the size of what lies there and the time of its last change."""
    fs, at = _hadoop(spark, path)
    content = fs.getContentSummary(at)
    return path, content.getLength(), fs.getFileStatus(at).getModificationTime()


_kept: WeakKeyDictionary[SparkSession, dict[tuple, DataFrame]] = WeakKeyDictionary()
#: Seconds that each table of ``once`` took, with those it is derived from if they were not there.
build_seconds: dict[str, float] = {}


def once(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``build()`` derives from the files at ``source``, materialised once for a session and state of these files."""
    tables = _kept.setdefault(spark, {})
    key = (*stamp(spark, source), name)
    if key not in tables:
        began = time.time()
        with scratch(spark):  # what was written on the way goes with it
            tables[key] = materialize(build(), keep=True)
        build_seconds[name] = time.time() - began
    return tables[key]


def forget(spark: SparkSession) -> None:
    """Derive the tables of ``once`` anew when they are asked for next."""
    _kept.pop(spark, None)


def global_rank(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with ``name``: the 0-based place of each row by ``order``, which must tell rows apart.

    Rows are range-partitioned and numbered inside their partition; the count of each
    partition, one row, is all that meets in one place.
    """
    placed = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    placed = materialize(placed)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("bigint").alias("_shift"))
    own = Window.partitionBy("_part").orderBy(*order)
    return (
        placed.withColumn("_rn", F.row_number().over(own).cast("bigint") - 1)
        .join(F.broadcast(shift), "_part")
        .withColumn(name, F.col("_rn") + F.col("_shift"))
        .drop("_part", "_rn", "_shift")
    )
