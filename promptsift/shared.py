"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a local session may do without that setting; it then gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="promptsift-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """df with its rows in the shared folder and its lineage cut; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in a new folder of the shared folder; takes less disk than a checkpoint."""
    folder = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def unlinked(df: DataFrame) -> None:
    """Removes the folder of a ``written`` table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        files, path = path_of(spark, folder)
        files.delete(path, True)


def dealt(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """rows with equal keys in one partition, in order, for a function of sorted partitions.

    Rows that a join has already shuffled by the key itself Spark wouldn't shuffle again, and adaptive
    execution may then read that shuffle in pieces, as such a function asks for no distribution.
    Dealing by the key's hash keeps a shuffle of its own.
    """
    return rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order)


def path_of(spark: SparkSession, folder: str):
    """Hadoop's file system and path of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where they wouldn't find it by themselves."""
    root = Path(__file__).resolve().parent.parent
    known = {Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    sc = spark.sparkContext
    if root in known or getattr(sc, "_promptsift_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="promptsift-")) / "promptsift.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "promptsift").rglob("*.py")):
            out.write(file, file.relative_to(root))
    sc.addPyFile(str(archive))
    sc._promptsift_shipped = True
