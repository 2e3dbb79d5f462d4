"""Session helpers."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own: list[str] = []
_open: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for working tables: that of ``spark.checkpoint.dir``, which every executor shares.

    Where the setting is absent a folder of this process is used, on a local master only: on a
    cluster the executors could not see each other's files, so that raises.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master") or ""):
        raise RuntimeError("working tables need a folder that all executors share: set spark.checkpoint.dir")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="bidloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def opened(spark: SparkSession, path: str) -> str:
    """``path``, to be removed when the driver ends unless it is removed before."""
    _open[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for what is read several times; it goes when the driver ends."""
    spark = df.sparkSession
    path = opened(spark, f"{shared_folder(spark)}/bidloom-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder of working files."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    conf = jvm.org.apache.hadoop.conf.Configuration() if spark.sparkContext._jsc is None else spark._jsc.hadoopConfiguration()
    at.getFileSystem(conf).delete(at, True)
    _open.pop(path, None)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_open.items()):
        with contextlib.suppress(Exception):  # the JVM may be gone already
            removed(spark, path)


def build_session(app: str = "bidloom", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, adaptive execution."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of an Arrow batch. Batches are cut by rows by default, and ten thousand long texts are no batch.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application, and bound Arrow batches unless the application does."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    if not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, str(BATCH_BYTES))
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="bidloom-code-")
    target = os.path.join(folder, "bidloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for at, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
