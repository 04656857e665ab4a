"""The shared working folder, and tables that are written there to cut a lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``; only where that is unset and the master is local (as in tests)
    a temporary folder is made and set for the session: on a cluster each machine would see its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="eventide-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Paths that this driver has given out and not yet deleted, in order.
_paths: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark)}/eventide/{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what is stored within the block when it ends, so results must have been written or collected by then.

    For one thread at a time: what another thread stores meanwhile goes too.
    """
    before = len(_paths)
    try:
        yield
    finally:
        for path in _paths[before:]:
            _delete(spark, path)
        del _paths[before:]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again.

    Cuts the lineage: a lost executor costs a reread, not a recomputation.  ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote for tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            _delete(spark, folder)
