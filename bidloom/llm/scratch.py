"""Working tables that cut lineage.

A working table is written as Parquet under the folder named by ``spark.checkpoint.dir``,
which every executor shares, so a lost executor costs a re-run of tasks and never a table.
Where the setting is absent a folder of this process is used, on a local master only: on a cluster
the executors could not see each other's files, so that raises.

A table is removed when its operator forgets it or drops its scratch; what a returned DataFrame
still reads is removed when the driver ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import opened, removed, shared_folder, ship


class Scratch:
    """The working tables of one operator call; ``drop`` removes them once its result is written."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.paths: list[str] = []

    def path(self, name: str) -> str:
        path = f"{shared_folder(self.spark)}/bidloom-{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        return opened(self.spark, path)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read from there."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def forget(self, *tables: DataFrame | None) -> None:
        """Remove working tables that no later step reads."""
        for t in tables:
            if t is not None and t._scratch_path in self.paths:
                self.paths.remove(t._scratch_path)
                removed(self.spark, t._scratch_path)

    def drop(self) -> None:
        for p in self.paths:
            removed(self.spark, p)
        self.paths.clear()
