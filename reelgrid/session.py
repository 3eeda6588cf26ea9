"""Session helpers: the package on the workers' path, and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)
#: Size of the batches that go to Python: bounds a worker's memory whatever the length of the texts (a longer text is a batch of its own).
BATCH_BYTES = "2m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Shuffle files of a finished query go at once, not when the driver happens to collect garbage: a job of many written steps holds those of one step.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Put this package on the Python workers' path, bound Arrow batches by bytes where the session sets no bound of its own, and have shuffle files removed with their query. On a cluster the package is installed or sent with --py-files.

    The bound stays set: plans are lazy, and workers read it when they run.
    """
    if spark.conf.get(_BATCH, None) in (None, "-1") or not spark.conf.get(_BATCH).lower().endswith(("k", "m")):
        spark.conf.set(_BATCH, BATCH_BYTES)
    spark.conf.set(_TIDY, "true")
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *parts])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one on a single machine, which is then set; on a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='reelgrid-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal narrow rows that each become much work to as many tasks as a shuffle has, a number that adaptive execution keeps: a small file is one task's, few bytes are few tasks'."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the tables: it is shuffled, never broadcast. Spark guesses sizes from files and column types, and guesses too little behind Python's rows, filters and well compressed tables."""
    return df.hint("merge")


_OPEN: list[list[str]] = []


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors. With `keep`, `scratch` leaves it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/reelgrid/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if _OPEN and not keep:
        _OPEN[-1].append(path)
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end; for code whose own result has been written outside by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)
