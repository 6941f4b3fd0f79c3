"""Cuts the lineage of iterative operators with written tables in the shared folder.

Written tables are small in files, as columns repeat, and many times larger as rows. Spark goes by the files and would send such a
table through the driver to broadcast it, so that joins with them are told to shuffle both sides."""

from __future__ import annotations

import functools
import tempfile
import uuid
import weakref
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@functools.cache
def _local_base() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tessera-")


def base_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where that is unset and driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (base or _local_base()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written to a new folder under spark.checkpoint.dir and read back."""
    spark = df.sparkSession
    path = f"{base_folder(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path).hint("merge")
    _WRITTEN[out] = path
    return out


def together(parts: Sequence[DataFrame]) -> DataFrame:
    """Tables that cut() has written, with equal columns, as one scan."""
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*(_WRITTEN[p] for p in parts)).hint("merge")


def discard(df: DataFrame) -> None:
    """Delete a table that cut() has written and that no later plan reads."""
    spark, path = df.sparkSession, _WRITTEN.pop(df)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
