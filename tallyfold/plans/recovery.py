"""Cutting lineage so that a lost executor costs a re-read, never a recomputation.

Intermediate results go to a folder that the driver and all executors share: the one that the
session names in ``spark.checkpoint.dir``. A local folder is made only where that is unset and Spark runs in one process (tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Of what is written: keys are hex digits, of which this leaves about half.
COMPRESSION = "zstd"


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables; a new local one only if the session names none."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{SETTING} has to name a folder that the driver and all executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="tallyfold-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Where this process has written tables, by session.
_made: dict[str, list[str]] = {}


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; a new table each time."""
    spark = df.sparkSession
    path = fresh_folder(spark, tag)
    df.write.option("compression", COMPRESSION).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A folder of a new name for tables that are kept up; :func:`clean_up` deletes it too."""
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def reunited(tables: list[DataFrame]) -> DataFrame:
    """The rows of tables of one schema that :func:`written` returned, as one scan however many they are."""
    files = [f for t in tables for f in t.inputFiles()]
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*files) if files else tables[0]


def _there(spark: SparkSession, path: str):
    """A path for Hadoop's file systems, and the file system."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def numbered(spark: SparkSession, folder: str, name: str, done: bool = True) -> list[int]:
    """The numbers n of the subfolders ``name=n``, in order; of those alone that a writer has finished, unless done is false."""
    top, fs = _there(spark, folder)
    if not fs.exists(top):
        return []
    paths = [x.getPath() for x in fs.listStatus(top) if x.getPath().getName().startswith(f"{name}=")]
    paths = [p for p in paths if not done or fs.exists(_there(spark, f"{p.toString()}/_SUCCESS")[0])]
    return sorted(int(p.getName().removeprefix(f"{name}=")) for p in paths)


def removed(spark: SparkSession, path: str) -> None:
    there, fs = _there(spark, path)
    fs.delete(there, True)


def clean_up(spark: SparkSession) -> int:
    """Deletes the tables written by this application so far and returns their number. For when all results that rest on them have been stored."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        removed(spark, path)
    return len(paths)
