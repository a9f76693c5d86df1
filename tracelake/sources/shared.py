"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """``spark.checkpoint.dir`` names no folder, and the session is no local one."""


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session that names none gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors reach")
        named = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Shuffle files go when their job ends, not when the driver happens to collect its garbage.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": True}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, str(value).lower() if isinstance(value, bool) else str(value))
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def size_setting(spark: SparkSession, key: str) -> int:
    """A setting such as ``128m`` in bytes."""
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as it is now, written to a new path, and that path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def packed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written`` with little disk: texts are packed harder, and the job's shuffle files go with it."""
    with settings(df.sparkSession, TIDY | {"spark.sql.parquet.compression.codec": "zstd"}):
        return written(df, name)


def files_of(spark: SparkSession, path: str):
    """(file system, path) of a path, as Hadoop has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = files_of(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, by name; nothing where there is none."""
    fs, at = files_of(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, at = files_of(spark, old)
    fs.rename(at, files_of(spark, new)[1])


def write_file(spark: SparkSession, path: str, text: str | bytes) -> str:
    """A small file, on whichever file system the path names."""
    fs, at = files_of(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode() if isinstance(text, str) else text))
    out.close()
    return path
