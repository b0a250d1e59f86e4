"""Session helpers: local sessions for tests, and cutting lineage."""

import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("citeline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_local_folder = None


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one ``spark.checkpoint.dir`` names.

    A cluster must name one, as no folder of a single machine can hold what all
    executors write; only a local master gets a temporary folder.
    """
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="run-citeline-", dir="/tmp")
    return _local_folder


_scopes = threading.local()


def shared_path(spark: SparkSession, kind: str = "citeline") -> str:
    """A new path in the shared folder, which the innermost ``scratch`` removes."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    for paths in getattr(_scopes, "open", [])[-1:]:
        paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made within are removed at its end, also after a failure.

    What reads them must have been written or collected by then: a DataFrame that
    leaves the scope unread finds its tables gone. Scopes nest, each removes its own
    tables; each thread has its own, as micro-batches run in threads of their own.
    """
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append([])
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back. It stays until
    the ``scratch`` around it ends, or for good where there is none.

    Used where one result feeds several branches and is dear to compute twice
    (model calls, long shuffles). The table outlives any executor, cuts the
    lineage, and keeps column pruning for the branches that read it.

    Also used on the summarised side of a join back to the rows it summarises.
    Spark then knows its size before it plans (and broadcasts it when small);
    when it is not, both sides are shuffled for this join alone, which is what
    lets the adaptive planner split a key that holds a large share of the rows.
    """
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once.

    Needed only where it is not installed on them. The archive is made on the
    driver, which serves it to the executors.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    name = os.path.join(tempfile.mkdtemp(prefix="run-citeline-"), package.name)
    context.addPyFile(shutil.make_archive(name, "zip", package.parent, package.name))
    _shipped.add(context.applicationId)
