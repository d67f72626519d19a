"""Tables that several jobs of one operator read, in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthbook.operators.written import folder


class Scratch:
    """One operator call's folder.  ``keep`` writes a DataFrame and rereads it, which cuts its lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = folder(spark, name)
        self.names: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, name: str, frame: DataFrame) -> DataFrame:
        self.names.add(name)
        frame.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that no later job reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.names.discard(name)

    def only(self, *names: str) -> None:
        """Delete all tables but those that the operator's result is read from."""
        for name in self.names - set(names):
            self.drop(name)
