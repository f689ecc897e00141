"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}
_scopes: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, deleted when the driver's Python ends.

    Where no such folder is set, a local session (tests, one machine) makes a temporary one; on a cluster, whose
    machines don't share their own folders, that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
            root = "file://" + tempfile.mkdtemp(prefix="shared-")
            spark.sparkContext.setCheckpointDir(root)
        folder = f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"
        _folders[app] = folder
        atexit.register(_drop, spark, folder)
    return _folders[app]


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, when what was made of them must have been collected or saved elsewhere.

    A long session should run each query in one, so that its intermediate tables don't fill the shared folder.
    """
    folder = f"{shared_folder(spark)}/scope-{uuid.uuid4().hex}"
    _scopes.append(folder)
    try:
        yield
    finally:
        _scopes.remove(folder)
        _drop(spark, folder)


def _drop(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM is gone already
        return


def new_path(spark: SparkSession, name: str) -> str:
    folder = shared_folder(spark)
    return f"{_scopes[-1] if _scopes else folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet to the shared folder and read from there.

    This cuts the lineage: what reads the result survives the loss of any
    executor, and nothing upstream is worked out twice.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def alone(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, written as by written(); the tables that it writes on the way are deleted.

    Shuffle files stay until the driver's JVM collects what refers to them, so it is asked to: they would add up over a query's tables.
    """
    path = new_path(spark, name)
    with scope(spark):
        df = make()
        schema = df.schema
        df.write.parquet(path)
        del df
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)
