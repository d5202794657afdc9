"""Readers and writers: unquoted TSV, parquet by country, JSON settings, word lists, vectors, models and stages."""

from __future__ import annotations

import atexit
import gc
import json
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated, never quoted, with a header; every column is text, an empty field is empty text."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    df = spark.read.option("sep", "\t").option("quote", "").option("header", True).option("emptyValue", "").schema(schema).csv(path)
    return df.fillna("")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("quote", "").option("emptyValue", "").option("nullValue", "").option("header", True).csv(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """id, name, addr, country of a raw source."""
    raw = read_tsv(spark, path, ["entity_id", "business_name", "business_address", "country"])
    return raw.toDF("id", "name", "addr", "country")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """s1, r of a truth file; entities without a match have no row."""
    raw = read_tsv(spark, path, ["source1_entity_id", "matched_entity_ids"])
    return explode_lists(raw.toDF("s1", "matched"))


def explode_lists(lists: DataFrame) -> DataFrame:
    return lists.select("s1", F.explode(F.split("matched", ",")).alias("r")).select(F.trim("s1").alias("s1"), F.trim("r").alias("r")).where("r <> ''")


def write_by_country(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("country").parquet(path)


def write_package(folders: dict[str, str], path: str) -> None:
    """A zip at a path of the driver with one file a folder (name in the zip -> folder that the driver sees), parts in order."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, folder in folders.items():
            with z.open(name, "w") as out:
                for k, part in enumerate(sorted(Path(folder.removeprefix("file://")).glob("part-*"))):
                    with part.open("rb") as f:
                        if k:
                            f.readline()  # every part has a header
                        shutil.copyfileobj(f, out)


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_json(spark: SparkSession, settings: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def write_words(words: DataFrame, path: str) -> None:
    words.select("word").orderBy("word").write.mode("overwrite").text(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "word")


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("id", F.col("vector").cast("array<float>").alias("vector")).write.mode("overwrite").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if a whole one is there, else what build gives, written there first."""
    done, fs = _file(spark, f"{path.rstrip('/')}/_SUCCESS")
    if not fs.exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, which driver and executors share; a local one where it is unset and all is local."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='matchloom-')}")
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/matchloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: df written to the shared folder and read again, so that later plans stay small."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


def forget(since: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes what materialise() has written from number since on, but keep; its tables can't be read any more."""
    own = {f.rpartition("/")[0].rpartition("/")[2] for f in keep.inputFiles()} if keep is not None else set()
    for k in range(len(_written) - 1, since - 1, -1):
        spark, path = _written[k]
        if path.rpartition("/")[2] not in own:
            p, fs = _file(spark, path)
            fs.delete(p, True)
            del _written[k]


def release(spark: SparkSession) -> None:
    """Shuffle files of plans that nobody holds any more go when the driver collects its garbage; this asks for it."""
    gc.collect()
    spark._jvm.System.gc()


def written() -> int:
    """How many tables of materialise() there are."""
    return len(_written)


@atexit.register
def _forget_all() -> None:
    try:
        forget()
    except Exception:  # noqa: BLE001  the session may be gone already
        pass
