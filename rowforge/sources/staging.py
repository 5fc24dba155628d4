"""Tables written once to the folder that the cluster shares, to cut lineage and to survive lost executors.

The folder is `spark.checkpoint.dir` of the session.  Only where that is unset and the session runs in
one process (`local[...]`, as in tests) is a temporary folder made; on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="rowforge-")
        atexit.register(shutil.rmtree, own, True)
        _local[app] = f"file://{own}"
    return _local[app]


_scopes = threading.local()


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Tables staged inside are deleted when it ends, but for those staged with keep=True: they go with the scope around it.

    An operator puts its work into a scope and keeps what its result still reads; whoever uses operators may put that
    into one as well, and everything is gone once its results are written.  Without one, what a result reads stays."""
    if not hasattr(_scopes, "held"):
        _scopes.held = []
    own: list[DataFrame] = []
    _scopes.held.append(own)
    try:
        yield
    finally:
        _scopes.held.pop()
        release(*own)
        if own:
            forget(own[0].sparkSession)


def stage(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write `df` as Parquet under the shared folder and return a reader of what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rowforge/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    held = getattr(_scopes, "held", [])
    if len(held) > keep:
        held[-1 - keep].append(out)
    return out


def release(*frames: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget(spark: SparkSession) -> None:
    """Spark drops shuffle files and broadcasts of plans once the plans are collected, which a driver with little to do puts
    off for long: done once an operator's work, or a large step of it, is over."""
    gc.collect()  # Python's handles of JVM objects first
    spark.sparkContext._jvm.System.gc()
