"""Stored tables that take keyed batches without being rewritten whole."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def replace_keys(keys: list[str]) -> Merge:
    """Rows of the batch take the place of all stored rows with the same key; several rows a key are one unit."""
    def merge(stored: DataFrame, batch: DataFrame) -> DataFrame:
        return stored.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch)
    return merge


@dataclass
class KeyedTable:
    """A Parquet table in `folder`, dealt into a fixed number of buckets by a hash of `keys`.

    Rows lie in `data/version=v/bucket=b`. A batch reads the buckets that its keys fall into, writes them
    anew under the next version, and commits by one row per written bucket in `log`. A reader takes of
    each bucket the last version that the log names, so it sees all of a batch or nothing of it, and files
    of a batch that failed are never read. The log and the choice of versions are bounded by the number of
    buckets a batch touches. One writer at a time.
    """
    spark: SparkSession
    folder: str
    schema: str
    keys: list[str]
    buckets: int = 256

    def __post_init__(self) -> None:
        empty = self.spark.createDataFrame([], "version bigint, bucket int")
        empty.write.mode("ignore").parquet(f"{self.folder}/log/start")

    def _log(self) -> DataFrame:
        return self.spark.read.schema("version bigint, bucket int").parquet(f"{self.folder}/log/*")

    def _live(self) -> DataFrame:
        return self._log().groupBy("bucket").agg(F.max("version").alias("version"))

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def version(self) -> int:
        """The last committed version; 0 is the empty table."""
        return self._log().agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]

    def _stored(self, live: DataFrame) -> DataFrame:
        if self.version() == 0:
            return self.spark.createDataFrame([], f"{self.schema}, version bigint, bucket int")
        data = self.spark.read.schema(f"{self.schema}, version bigint, bucket int").parquet(f"{self.folder}/data")
        # at most one row per bucket, a fixed number: small enough to prune the folders by
        return data.join(F.broadcast(live), ["version", "bucket"], "left_semi")

    def read(self) -> DataFrame:
        """The table as of the last committed batch."""
        return self._stored(self._live()).drop("version", "bucket")

    def upsert(self, batch: DataFrame, merge: Merge | None = None) -> tuple[int, int]:
        """Merges a batch; returns the new version and the number of buckets written anew.

        `merge(stored, batch)` gets the stored rows of the batch's buckets and returns what they hold
        afterwards, by default the batch in place of rows of equal key. It must be a function of the key:
        rows of a key that is not in the batch stay as they are. Keys are matched by equality, null keys never.
        """
        dealt = self._bucketed(batch)
        touched = dealt.select("bucket").distinct()
        stored = self._stored(self._live().join(F.broadcast(touched), "bucket", "left_semi")).drop("version", "bucket")
        rows = (merge or replace_keys(self.keys))(stored, batch)
        version = self.version() + 1
        path = f"{self.folder}/data/version={version}"
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        self._bucketed(rows.select(*columns)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        entries = touched.select(F.lit(version).cast("long").alias("version"), "bucket").coalesce(1)
        entries.write.mode("overwrite").parquet(f"{self.folder}/log/{version}")
        return version, self._log().filter(F.col("version") == version).count()
