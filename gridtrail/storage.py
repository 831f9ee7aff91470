"""Written tables in the folder that all executors share; they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local folder only where that is unset and the master is local."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        held = context._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that the session reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


#: For local folders: Hadoop's file system without its layer of checksums, and no marker of success, which nothing here reads.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


class Scratch:
    """Written tables of one run. ``keep`` writes and rereads a table, ``drop`` deletes one that no later plan reads.

    In a local folder Hadoop starts a ``chmod`` for each folder that it makes, each file and its .crc; until that process
    runs its program it shares all of the memory of the driver or executor, and a limit on memory may count it twice.
    So a table's folders are made here and its files written plainly: the driver starts none, a task one for its folder
    and one for its file. What is left is deleted when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.kept: set[str] = set()
        atexit.register(self.drop, "")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        if name in self.kept:
            self.drop(name)
        self.kept.add(name)
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(place).toUri()
        if place.getScheme() == "file":
            os.makedirs(f"{place.getPath()}/_temporary/0/_temporary", exist_ok=True)
        df.write.mode("append").options(**_PLAIN).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            try:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            except Exception:  # the session may have ended, and its folder with it
                return
