"""An index of analysed files that is kept up to date in place: changed files are replaced, and those that depend on them go (K5,
D10, T34, A21).

The index is a Parquet table in buckets by path. An update rewrites the buckets of changed and removed files and no others. An
update that fails may leave some of its buckets as they were; run again, it brings them up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import closure
from tessera.operators.lineage import cut, discard

BUCKET = "bucket"


class Index:
    """Files by path: path, digest and any results, as in schema (DDL). buckets: how many; the same for the life of the index."""

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 256) -> None:
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")

    def _rows(self, files: DataFrame) -> DataFrame:
        """One row for each path, the one with the least digest, with its bucket; rows with a null path are left out."""
        columns = self.spark.createDataFrame([], self.schema).columns
        rows = files.filter("path IS NOT NULL").select(*columns)
        first = rows.groupBy(F.col("path").alias("key")).agg(F.min_by(F.struct(*columns), F.struct("digest", F.xxhash64(*columns))).alias("row"))
        return first.select("row.*").withColumn(BUCKET, self._bucket())

    def create(self, files: DataFrame) -> None:
        """Write files as a new index."""
        self._rows(files).repartition(BUCKET).write.partitionBy(BUCKET).parquet(self.path)

    def read(self) -> DataFrame:
        """The files of the index."""
        return self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(self.path)

    def changes(self, files: DataFrame) -> DataFrame:
        """path and state of all files there are now against the index: new, changed or removed; the others give no row."""
        now = files.filter("path IS NOT NULL").groupBy("path").agg(F.min("digest").alias("digest"))
        old = self.read().select(F.col("path").alias("old_path"), F.col("digest").alias("old_digest"))
        both = now.join(old, F.col("path") == F.col("old_path"), "full")
        state = F.when(F.col("old_path").isNull(), "new").when(F.col("path").isNull(), "removed").when(~F.col("digest").eqNullSafe(F.col("old_digest")), "changed")
        return both.select(F.coalesce("path", "old_path").alias("path"), state.alias("state")).filter("state IS NOT NULL")

    def upsert(self, files: DataFrame) -> DataFrame:
        """Bring the index up to all files there are now; what changed, as changes() has it."""
        found = cut(self.changes(files))
        live = found.filter("state <> 'removed'").select(F.col("path").alias("p"))
        self._replace(found, cut(self._rows(files.join(live, F.col("path") == F.col("p"), "left_semi"))))
        return found

    def invalidate(self, paths: DataFrame, depends: DataFrame) -> DataFrame:
        """Take out some files (path) and all that depend on them over any number of edges (from_id depends on to_id); the paths that
        the index had."""
        reached = closure(depends, paths.select(F.col("path").alias("id")), "in").select(F.col("id").alias("p"))
        found = cut(self.read().join(reached, F.col("path") == F.col("p"), "left_semi").select("path"))
        self._replace(found, None)
        return found

    def stale(self, files: DataFrame) -> DataFrame:
        """Files, stale ones and the hit rate of the index."""
        old = self.read().agg(F.count(F.lit(1)).alias("files"))
        gone = self.changes(files).filter("state <> 'new'").agg(F.count(F.lit(1)).alias("stale"))
        return old.join(F.broadcast(gone)).withColumn("hit_rate", 1 - F.col("stale") / F.greatest("files", F.lit(1)))  # one row each

    def _replace(self, gone: DataFrame, rows: DataFrame | None) -> None:
        """Take the paths in gone out and put rows in. The driver gets bucket numbers, of which there are at most `buckets`."""
        touched = [r[0] for r in gone.select(self._bucket().alias(BUCKET)).distinct().collect()]
        if not touched:
            return
        kept = self.read().filter(F.col(BUCKET).isin(touched)).join(gone.select(F.col("path").alias("p")), F.col("path") == F.col("p"), "left_anti")
        staged = cut(kept if rows is None else kept.unionByName(rows))  # read in full before its folders are written
        filled = {r[0] for r in staged.select(BUCKET).distinct().collect()}
        staged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        files = hadoop.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for bucket in set(touched) - filled:
            files.delete(hadoop.Path(self.path, f"{BUCKET}={bucket}"), True)
        discard(staged)
