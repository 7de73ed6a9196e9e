"""What every training-data operator needs from the session: code on the executors and shared scratch tables.

Intermediate results are written as Parquet below ``spark.checkpoint.dir`` (the folder that the driver and all
executors share), never kept with ``localCheckpoint`` and never put on a machine-local disk of a cluster.  A table
that was written survives the loss of any executor.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers that do not share the driver's import path (once a context)."""
    context = spark.sparkContext
    if getattr(context, "_lodestrata_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(package)
    archive = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for file in files:
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    out.write(full, os.path.join(name, os.path.relpath(full, package)))
    context.addPyFile(archive)
    context._lodestrata_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (single-machine tests) a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestrata-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found if ":" in found.split("/")[0] else f"file://{found}"


class Scratch:
    """A folder of Parquet tables for one run of an operator.

    Operators drop tables that nothing needs any more; results are read from the others, so these stay until the
    application ends (its file system deletes the folder then).
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/lodestrata-{label}-{uuid.uuid4().hex}"
        path, system = self._at("")
        system.mkdirs(path)
        system.deleteOnExit(path)

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns it read back: the lineage above is cut, and it is computed once."""
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        """Deletes tables; a name may end with ``*``."""
        for name in names:
            path, system = self._at(name)
            for found in system.globStatus(path) or []:
                system.delete(found.getPath(), True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that would clash with an operator's own (case-insensitively, as Spark resolves them)."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])
