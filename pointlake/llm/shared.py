"""Where operators of this subpackage keep tables that cut lineage, and small column helpers."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is missing and all runs on one machine, as in tests, a temporary folder is made and set.
    """
    if spark.conf.get(_ARROW_ROWS) == "10000":  # Spark's default; whole texts make such batches large
        spark.conf.set(_ARROW_ROWS, "2000")
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="pointlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before this process does
        pass


_LIVE: dict[str, SparkSession] = {}
_SCOPE: ContextVar[set[str] | None] = ContextVar("scratch", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is removed by ``release``, or when the driver process ends."""
    path = f"{shared_dir(spark)}/pointlake/{name}-{uuid.uuid4().hex}"
    _LIVE[path] = spark
    if (made := _SCOPE.get()) is not None:
        made.add(path)
    return path


@contextmanager
def scope() -> Iterator[set[str]]:
    """The paths that ``scratch`` gives inside of the ``with``, in this thread; an outer scope gets them as well."""
    made: set[str] = set()
    outer = _SCOPE.get()
    token = _SCOPE.set(made)
    try:
        yield made
    finally:
        _SCOPE.reset(token)
        if outer is not None:
            outer |= made


def live() -> set[str]:
    """The paths that ``scratch`` gave and that weren't removed."""
    return set(_LIVE)


def read_by(df: DataFrame) -> set[str]:
    """The scratch tables that ``df`` reads whenever it is computed."""
    folders = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
    return {path for path in _LIVE if path.rpartition("/")[2] in folders}


def free(df: DataFrame) -> None:
    """Remove the scratch tables of a result that won't be computed again, nor anything made from it."""
    release(read_by(df))


def release(paths: Iterable[str]) -> None:
    """Remove scratch tables of which nothing is read any more."""
    for path in list(paths):
        if path in _LIVE:
            _remove(_LIVE.pop(path), path)


atexit.register(lambda: release(_LIVE))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken, k = {c.lower() for c in df.columns}, 0
    while f"{name}_{k}" in taken:
        k += 1
    return f"{name}_{k}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later failures restart from the files."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    gc.collect()  # shuffle files of what is done are freed once nothing refers to them
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove a table that ``cut`` gave, once all that was made from it is cut as well."""
    files = table.inputFiles()
    if files:
        folder = files[0].rpartition("/")[0]
        _remove(table.sparkSession, folder)
        for path in [p for p in _LIVE if p.rpartition("/")[2] == folder.rpartition("/")[2]]:
            del _LIVE[path]


def local_path(uri: str) -> str | None:
    """The plain path of a ``file:`` URI or path; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def open_write(uri: str, attempt: str):
    """(file object, commit function). Written under a name of its own first, so that a task may run twice."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(f"{path}.{attempt}", "wb"), lambda: os.replace(f"{path}.{attempt}", path)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    return store.open_output_stream(f"{inner}.{attempt}"), lambda: store.move(f"{inner}.{attempt}", inner)


def open_read(uri: str):
    """A seekable binary file object for a path in the shared folder."""
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    return store.open_input_file(inner)
