"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a temporary folder;
    on a cluster that is an error, since executors don't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm.isDefined():
            found = jvm.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            found = tempfile.mkdtemp(prefix="tessera-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: While a table is written: shuffle files are freed when the job ends, and batches for Python are bounded by bytes.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m", "spark.sql.execution.arrow.maxRecordsPerBatch": "4000"}
_made: dict[str, DataFrame] = {}
#: The tables made for the call of :func:`settled` that runs in this thread.
_mine: ContextVar[dict[str, DataFrame] | None] = ContextVar("_mine", default=None)


def _note(df: DataFrame) -> None:
    if (mine := _mine.get()) is not None:
        mine[df._tessera_path] = df


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages start from files, not from lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WHILE_WRITING}
    for k, v in WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    _made[path] = out
    _note(out)
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` once nothing reads it any more."""
    spark, path = df.sparkSession, df._tessera_path
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
    _made.pop(path, None)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns as a table; all other tables that were made for it are deleted, those of other threads are not."""
    mine: dict[str, DataFrame] = {}
    scope, out = _mine.set(mine), None
    try:
        out = cut(make(), name)
    finally:
        _mine.reset(scope)
        for path, df in mine.items():
            if df is not out and path in _made:
                drop_cut(df)
    _note(out)
    return out


def drop_all() -> None:
    """Delete every table of this session that is still there, once no result that reads them is needed any more."""
    for df in list(_made.values()):
        drop_cut(df)
