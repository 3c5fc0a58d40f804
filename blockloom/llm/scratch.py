"""Tables written between the steps of an operator, in the folder that ``spark.checkpoint.dir`` names.

A written table cuts lineage, is read back with column pruning, and survives the loss of any
executor because the folder is shared.  A folder of our own is made only where the setting is
unset and the master is local (tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="blockloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """Tables of one operator call.  ``drop`` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{operator}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        # the table is all that later steps read: its shuffle files go with the execution
        held = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            self.spark.conf.set(_CLEANUP, held)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
