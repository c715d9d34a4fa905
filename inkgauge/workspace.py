"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "inkgauge"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: ``spark.checkpoint.dir``.

    Where it is unset in local mode (tests), a temporary folder is set; elsewhere that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="inkgauge-"))
    return sc.getCheckpointDir().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = getattr(spark, "_jvm", None)  # a Spark Connect session has none: what is there stays
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Workspace:
    """Tables written once and read often, in the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{_FOLDER}/{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, like: DataFrame, *names: str) -> DataFrame:
        """The rows of several saved tables with the columns of ``like``, by one scan: no plan grows with their number."""
        return self.spark.read.schema(like.schema).parquet(*[f"{self.root}/{name}" for name in names])

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


def clear(spark: SparkSession) -> None:
    """Delete all tables saved so far by any query; to be called when no result that reads them is needed any more."""
    _delete(spark, f"{shared_dir(spark)}/{_FOLDER}")
