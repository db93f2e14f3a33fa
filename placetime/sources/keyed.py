"""Stored tables that take in new keys without moving what they hold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placetime.operators.catalog import largest_per_key

#: Spark's own limit unless the session raises it.
MOST_BUCKETS = 100_000


@dataclass(frozen=True)
class KeyedTable:
    """A catalog table whose files are bucketed by key.

    Rows arrive by their key's bucket, so stored rows are compared where they lie: only what comes in is
    shuffled, and of what is stored only the keys are read. The number of buckets is fixed when the table
    is made; take the bytes it will hold over some 256 MB. A key's bucket is its hash, so many rows
    of one key would crowd a bucket, but a stored key has one row.
    """

    spark: SparkSession
    name: str
    keys: tuple[str, ...]
    buckets: int = 64

    def __post_init__(self) -> None:
        if not self.keys or not 0 < self.buckets < MOST_BUCKETS:
            raise ValueError("give at least one key and a number of buckets")

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def rows(self) -> DataFrame:
        # Another session, such as a stream's, may have added files.
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def unseen(self, staging: DataFrame) -> DataFrame:
        """Staging rows whose key is not stored yet, the largest row per key, laid out by bucket.

        A key with a null part is like no other and always new, as in any join.
        """
        # Merged before the shuffle, so that many copies of one row stay cheap.
        placed = largest_per_key(staging, self.keys).repartition(self.buckets, *[F.col(f"`{k}`") for k in self.keys])
        if not self.exists():
            return placed
        return placed.join(self.rows().select(*self.keys), list(self.keys), "left_anti").select(*staging.columns)

    def add(self, staging: DataFrame, path: str | None = None) -> None:
        """Stores what is unseen; makes the table, at `path` if given, when there is none.

        A run that is repeated finds its keys stored and adds nothing.
        """
        fresh = self.unseen(staging)
        if self.exists():
            fresh = fresh.select(*self.rows().columns)
        writer = fresh.write.mode("append").format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
        if path is not None and not self.exists():
            writer = writer.option("path", path)
        writer.saveAsTable(self.name)
