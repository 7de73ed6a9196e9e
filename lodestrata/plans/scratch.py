"""Tables that a computation writes on its way: below ``spark.checkpoint.dir``, which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (single-machine tests) a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestrata-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found if ":" in found.split("/")[0] else f"file://{found}"


class Tables:
    """A folder of Parquet tables for one run; a table survives the loss of any executor and cuts the lineage.

    Results are read from it, so it stays until the application ends: its file system deletes it then.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/lodestrata-{label}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns it read back."""
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
