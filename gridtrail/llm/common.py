"""What the operators of this subpackage share: tables by path, bounded Arrow batches, columns by exact name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators.graph import components, looked_up
from ..session import ship, spread
from ..storage import Scratch

__all__ = ["Scratch", "column", "components", "looked_up", "small_batches", "spread", "table"]

#: Bytes of one Arrow batch on its way to Python; long texts then come a few at a time.
BATCH_BYTES = 4 << 20
#: Rows of one Arrow batch where the byte limit isn't known to the Spark version.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, by Spark's own reader (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless it bounds them more tightly already; send the package to workers."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    except Exception:  # an older Spark without this setting keeps the row limit
        return
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def column(df: DataFrame, name: str) -> Column:
    """df's column of exactly this name, though others may differ only by dots or ticks."""
    return df["`" + name.replace("`", "``") + "`"]
