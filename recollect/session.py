"""Session helpers and tables that cut a plan's lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("recollect")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="recollect-"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster the warehouse is the fallback, never a machine's temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = (
            tempfile.mkdtemp(prefix="recollect-")
            if spark.sparkContext.master.startswith("local")
            else spark.conf.get("spark.sql.warehouse.dir") + "/_recollect"
        )
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_made: ContextVar[list | None] = ContextVar("made", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Drops, at its end, every ``Cut`` made within, also by operators called; for work whose results are written by then."""
    made: list[Cut] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for cut in made:
            cut.drop()
        release(spark)


class Cut:
    """A DataFrame written as Parquet in the shared folder and read again.

    Like ``checkpoint()`` it survives lost executors; unlike it, the files are
    columnar and ``drop()`` removes them as soon as nothing reads them.
    """

    def __init__(self, df: DataFrame, name: str = "cut", by: tuple[str, ...] = ()):
        """``by`` names columns to partition the files by."""
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/recollect/{name}-{uuid.uuid4().hex}"
        df.write.partitionBy(*by).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        if (made := _made.get()) is not None:
            made.append(self)

    def count(self) -> int:
        return self.df.count()

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of plans nobody holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clean(spark: SparkSession) -> None:
    """Remove all tables that ``Cut`` left in the shared folder; results that still read them end with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/recollect")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
