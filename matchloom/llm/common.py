"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A null id sorts after every real one.
NO_ID = (1 << 63) - 1

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; read by Spark alone, so any file system that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one where it is unset and all is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='matchloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _drop_written() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass


def step(build: Callable[[], DataFrame], name: str, before: DataFrame | None = None) -> DataFrame:
    """What build gives, as a written table; deletes what was written on the way, and before, the step before this one."""
    since = len(_written)
    out = materialise(build(), name)
    keep = _written.pop()
    own = {f.rpartition("/")[0] for f in before.inputFiles()} if before is not None else set()
    for k in range(len(_written) - 1, -1, -1):
        spark, path = _written[k]
        if k >= since or any(f.endswith(path.rpartition("/")[2]) for f in own):
            drop_path(spark, path)
            del _written[k]
    _written.append(keep)
    return out


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet below the shared folder and read it again.

    Files go when they are dropped (step) or else when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/matchloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Gives back what a worker's allocators hold but don't use; called at the end of a task, as workers live on."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores in front until no column (names don't differ by case) is called so."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name
