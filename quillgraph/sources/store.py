"""Versioned tables: rows keyed within a version, last write wins, every write a commit that can be repeated.

Rows of a version are dealt to buckets by the hash of their key. A commit rewrites the buckets that it
has rows for, as partitions of its own, and only then lists them in the manifest; until it does, readers
see what was there. A commit that is repeated, after a failure or by mistake, changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MANIFEST = "version string, bucket int, number long, commit string"


class VersionedTable:
    """A folder of Parquet: data/commit=/version=/bucket= and manifest/commit=. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: Sequence[str], buckets: int = 16) -> None:
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, list(key), buckets

    def _there(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def _manifest(self) -> DataFrame:
        if not self._there("manifest"):
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest")

    def _live(self) -> DataFrame:
        """(version, bucket, commit): of each bucket the last commit that wrote it; a row per bucket, however large the table."""
        last = Window.partitionBy("version", "bucket").orderBy(F.desc("number"))
        return self._manifest().withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("version", "bucket", "commit")

    def _stored(self, live: DataFrame) -> DataFrame:
        if not self._there("data"):
            return self.spark.createDataFrame([], f"{self.schema}, commit string, version string, bucket int")
        data = self.spark.read.schema(f"{self.schema}, commit string, version string, bucket int").parquet(f"{self.folder}/data")
        return data.join(F.broadcast(live), ["commit", "version", "bucket"], "left_semi")

    def rows(self, version: str | None = None) -> DataFrame:
        """The rows as of the last commit, of one version or all, with their version."""
        live = self._live() if version is None else self._live().filter(F.col("version") == version)
        return self._stored(live).drop("commit", "bucket")

    def upsert(self, fresh: DataFrame, version: str, commit: str, order: str | None = None) -> bool:
        """Put rows into a version: a row replaces the one of its key; of fresh rows of a key the last by `order` counts (without it, any one).

        False, and nothing written, if a commit of this name is there already. Only buckets that fresh rows fall into are read and written.
        """
        if self._manifest().filter(F.col("commit") == commit).limit(1).count():
            return False
        names = self.spark.createDataFrame([], self.schema).columns
        packed = F.struct(*names)
        once = fresh.groupBy(*self.key).agg((F.max_by(packed, order) if order else F.first(packed)).alias("r")).select("r.*")
        dealt = once.withColumn("bucket", F.pmod(F.hash(*self.key), F.lit(self.buckets)))
        hit = dealt.select("bucket").distinct()
        before = self._stored(self._live().filter(F.col("version") == version).join(F.broadcast(hit), "bucket", "left_semi")).select(*names, "bucket")
        kept = before.join(once.select(*self.key), self.key, "left_anti")
        rows = kept.unionByName(dealt.select(*names, "bucket")).withColumn("commit", F.lit(commit)).withColumn("version", F.lit(version))
        # What an attempt that failed left in these partitions is overwritten; other commits' stay.
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("commit", "version", "bucket").parquet(f"{self.folder}/data")
        number = self._manifest().agg(F.coalesce(F.max("number"), F.lit(0))).first()[0] + 1
        listed = self._written(commit, version).select(F.lit(version).alias("version"), "bucket", F.lit(number).cast("long").alias("number"), F.lit(commit).alias("commit"))
        listed.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        return True

    def _written(self, commit: str, version: str) -> DataFrame:
        """The buckets that a commit's partitions hold."""
        data = self.spark.read.schema(f"{self.schema}, commit string, version string, bucket int").parquet(f"{self.folder}/data")
        return data.filter((F.col("commit") == commit) & (F.col("version") == version)).select("bucket").distinct()
