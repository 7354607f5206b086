"""The folder that driver and executors share, and tables kept there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    A session that names none gets a temporary folder if driver and executors are one process, as in
    tests; on a cluster that would be some machine's own disk, so it is an error there.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="chronofold-"))
    return sc._jsc.sc().getCheckpointDir().get()


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path in any store that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Kept:
    """Tables written once below the shared folder; ``drop`` deletes those that are superseded."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.held = spark, f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}", []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.held)}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((kept, path))
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for kept, path in self.held:
            if any(kept is t for t in tables):
                fs, at = file_system(self.spark, path)
                fs.delete(at, True)
