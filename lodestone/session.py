"""Session set-up."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), "lodestone.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("lodestone", os.path.relpath(full, root)))
        context.addPyFile(target)
        # Batches to Python workers are bounded in bytes and rows: some texts are long.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
        _shipped.add(context.applicationId)
    return spark


#: Bytes that a task reads of a file or of what was shuffled. Columns of short strings and numbers take up to thirty times as much when they are
#: sorted or summed.
TASK_BYTES = 16 << 20


def divide(spark: SparkSession, folder: str) -> SparkSession:
    """Divides the work on a folder's tables into tasks of TASK_BYTES at most, so that their memory doesn't grow with the tables.

    Spark joins small shuffled parts, but never divides one: there are to be enough of them at first, four for each task of input. Smaller
    settings of the session stay.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * size // TASK_BYTES)))
    for name in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"):
        if _bytes(spark, name) > TASK_BYTES:
            spark.conf.set(name, str(TASK_BYTES))
    return spark


def _bytes(spark: SparkSession, name: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))


def local_session(name: str = "lodestone", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for one machine, with the settings the operators are tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key that hardly repeats to tasks for every core, for work that is much beside the bytes that are read: a small
    file of many rows would be one task's."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset, on one machine, one of our own,
    which goes when the process ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return "file://" + _own_dirs[app]


class Stages:
    """Intermediate tables written as Parquet to the shared folder.

    Writing cuts the lineage, survives lost executors and gives the planner true sizes.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
        _roots.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))


_roots: list[str] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_stages(spark: SparkSession) -> None:
    """Deletes all staged tables of this process. Results are read from them, so they must have been written elsewhere before."""
    while _roots:
        _delete(spark, _roots.pop())
