"""Intermediate tables in the folder all executors share.

A result that several later steps read is written once as Parquet below
``spark.checkpoint.dir`` and read again.  This cuts lineage (a lost executor
costs a re-read, not a recomputation), and gives Catalyst true file sizes, so
that it broadcasts a join side only when that side is small.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local folder where unset and all runs in one process (tests).

    Raises RuntimeError on a cluster without that setting: executors would each
    write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` below the shared folder and return a DataFrame that reads it."""
    return materialize_all([df], tag, compression)


def materialize_all(parts: Iterable[DataFrame], tag: str, compression: str = "zstd") -> DataFrame:
    """Write DataFrames of one schema, one after another, and return a DataFrame that reads all of them."""
    path = None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        if path is None:
            path = f"{shared_dir(spark)}/ledgerloom/{tag}-{uuid.uuid4().hex}"
            _written.append((spark, path))
        df.write.mode("append").option("compression", compression).parquet(path)
    return spark.read.schema(schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


def release(mark: int = 0) -> None:
    """Delete the intermediate tables written since ``mark`` tables were there; DataFrames that read them end."""
    while len(_written) > mark:
        _drop(*_written.pop())


def written() -> int:
    """How many intermediate tables there are; pass it to release()."""
    return len(_written)


atexit.register(release)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder is temporary
        pass
