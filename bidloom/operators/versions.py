"""Tables that change by whole versions: data first, the manifest last, readers see committed versions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import exists, removed


class Versions:
    """The manifest of a table at ``path``: ``manifest/version=N`` lists what version N brought.

    Version N is written under a folder of its own, and counts once its manifest is there. A run that breaks
    before leaves files that no manifest names; the next run has the same number and overwrites them. One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def folder(self, kind: str, version: int) -> str:
        return f"{self.path}/{kind}/version={version}"

    def manifest(self) -> DataFrame | None:
        """Rows of all committed versions with their ``version``; None before the first."""
        done = [v for v in self.numbers("manifest") if exists(self.spark, f"{self.folder('manifest', v)}/_SUCCESS")]
        if not done:
            return None
        return self.spark.read.option("basePath", f"{self.path}/manifest").parquet(*(self.folder("manifest", v) for v in done))

    def numbers(self, kind: str) -> list[int]:
        """The versions that have a folder of this kind, ascending."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    def last(self) -> int:
        """The last committed version, 0 before the first."""
        return max((v for v in self.numbers("manifest") if exists(self.spark, f"{self.folder('manifest', v)}/_SUCCESS")), default=0)

    def commit(self, version: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self.folder("manifest", version))

    def read(self, kind: str, schema=None) -> DataFrame | None:
        """What all committed versions hold of one kind, with their ``version``; None where there is nothing."""
        last = self.last()
        there = [v for v in self.numbers(kind) if v <= last]
        if not there:
            return None
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*(self.folder(kind, v) for v in there))

    def vacuum(self, kind: str, keep: set[int]) -> None:
        """Remove folders of versions that are not among ``keep``."""
        for v in self.numbers(kind):
            if v not in keep:
                removed(self.spark, self.folder(kind, v))
