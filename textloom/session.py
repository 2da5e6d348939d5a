"""What every operator shares: tables, cut lineage, and the spread of a scan.

Intermediate tables are written below the folder that the session names in
``spark.checkpoint.dir``. All executors share that folder, so a lost executor costs
at most its running tasks. Only where the setting is missing, and only in local
mode, a folder of our own is used.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Let the Python workers import this package wherever the session was started from."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables; see the module's docstring."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, _OWN[sc.applicationId], ignore_errors=True)
    return f"file://{_OWN[sc.applicationId]}"


def stored(df: DataFrame, name: str = "t", by: str | None = None, to: str | None = None) -> str:
    """Write ``df`` as a Parquet table in the shared folder, in a folder for each value of ``by``, or add it to the table in ``to``; the table's path."""
    spark = df.sparkSession
    path = to or f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("append" if to else "error")
    (writer.partitionBy(by) if by else writer).parquet(path)
    if not to:
        if not _WRITTEN:
            atexit.register(release)
        _WRITTEN.append((spark, path))
    return path


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return the table read back.

    This cuts the lineage, keeps column pruning and gives the optimiser true sizes.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


def tables() -> set[str]:
    """The paths of the intermediate tables that are there."""
    return {path for _, path in _WRITTEN}


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table, or a part of one, that nothing reads any more."""
    _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def release() -> None:
    """Delete the intermediate tables; frames that still read them become invalid."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            discard(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended before
            if path.startswith("file://"):
                shutil.rmtree(path[7:], ignore_errors=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of an action go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def partitions(df: DataFrame) -> int:
    """The number of partitions the frame's scan has, without running it."""
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Repartition a scan that has fewer splits than there are cores.

    Files of one row group give one task each. At scale a scan has more splits than
    cores and the frame comes back as it is, without a shuffle.
    """
    least = least or df.sparkSession.sparkContext.defaultParallelism
    return df if partitions(df) >= least else df.repartition(least)


@contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started within belong to ``tag`` and end early if another thread calls :func:`cancel`; their results are lost whole."""
    sc = spark.sparkContext
    sc.addJobTag(tag)
    try:
        yield
    finally:
        sc.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Cancel the running jobs of a tag."""
    spark.sparkContext.cancelJobsWithTag(tag)


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    """A frame without rows."""
    return spark.createDataFrame([], schema)
