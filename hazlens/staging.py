"""Tables written in the middle of an operator, where it must read the very same rows twice.

What a range exchange deals out depends on bounds that it samples, so two uses of one
plan may be dealt differently; and a lost executor then costs a re-read, never a
recomputation.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from hazlens.session import shared_folder

_staged: list[tuple[SparkSession, str]] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that all executors share, and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _sweep() -> None:
    for spark, path in _staged:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone; its folder is the cluster's to clean then
            return
