"""Shared plumbing of the training-data operators: inputs, hand-over tables in the shared folder, digests."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_base() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tessera-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor can reach; a local one only where the setting is absent."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = _local_base()
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Queries run in here drop their shuffle files once they end; for tables that are written to the shared folder."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a hand-over table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fold(id_column: str, parts: int) -> Column:
    """The id's part of `parts`: crc32 of its decimal text."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % parts


def piece_model(path: str | None = None) -> bytes:
    """The bytes of a SentencePiece model (half a megabyte), by default of the installed public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()
