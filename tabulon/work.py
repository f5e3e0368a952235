"""Work tables in the folder that driver and executors share; they go when the driver ends."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULT = "/tmp/tabulon-work"
#: Work tables that are there: folder name to path.
_MADE: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one if the master is local; else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return (named or _LOCAL_DEFAULT).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder for work tables; it goes when the driver ends, or by `drop_written` or `clean` before."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(clean, spark)
    _MADE[path.rpartition("/")[2]] = path
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_written(*dfs: DataFrame) -> None:
    """Delete tables made by `written` that no plan reads any more; files from elsewhere are never touched."""
    for df in dfs:
        for folder in {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()} & _MADE.keys():
            remove(df.sparkSession, _MADE.pop(folder))


def clean(spark: SparkSession) -> None:
    """Delete all work tables of this driver. Frames that operators returned can't be read after it."""
    for path in list(_MADE.values()):
        with contextlib.suppress(Exception):  # at the driver's end the JVM may be gone already
            remove(spark, path)
    _MADE.clear()


def small(df: DataFrame, most: int) -> DataFrame:
    """`df` marked for broadcast if it holds at most `most` rows (they are counted), for a merge join otherwise."""
    return df.hint("broadcast") if df.limit(most + 1).count() <= most else df.hint("merge")
