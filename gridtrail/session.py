"""Sessions: settings for tests and benches, and sending this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and benches."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("gridtrail")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # the package itself came as an archive, by --py-files
        return
    target = os.path.join(tempfile.mkdtemp(prefix="gridtrail-"), "gridtrail.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(target)
    _SENT.add(context.applicationId)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys over the session's shuffle partitions, whatever their size: for grouped work that is heavy per row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, where the files that it reads make fewer; for work that is heavy per row.

    Only inputs of less than a partition a core are dealt anew, so what is shuffled is small; others, and
    those that read no files, stay as they are. Looks at files' sizes, at most one call for each core.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= cores:
        return df
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    conf, parts = spark._jsc.hadoopConfiguration(), 0
    for name in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        parts += -(-path.getFileSystem(conf).getFileStatus(path).getLen() // most)
    return df if parts >= cores else df.repartition(cores)
