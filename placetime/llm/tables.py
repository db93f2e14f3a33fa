"""Intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from placetime.session import scratch_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Tables:
    """Written tables of one operator's run: computed once, kept if executors are lost.

    `settle` writes a frame below the folder that `spark.checkpoint.dir` names and reads it again, so Spark
    knows its size in bytes when it decides between a broadcast and a shuffle;
    `drop` removes one that nothing reads any more. Tables that a returned frame still reads stay
    in that folder, whose own retention removes them.
    """

    def __init__(self, spark, name: str):
        self.spark, self.name = spark, name
        self.paths: dict[int, str] = {}

    def settle(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, self.name)
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")  # shuffle files go once the table is there
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        read = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(read)] = path
        read._settled_by = self  # keeps the id from being given again
        return read

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for frame in frames:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(frame)))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
