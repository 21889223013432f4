"""Written intermediate tables for iterative operators.

An iterative operator must cut its lineage, or its plan doubles every round.  Tables are written as Parquet below the
folder named by ``spark.checkpoint.dir`` (shared by all executors, so a lost executor costs nothing but its own tasks)
and read back, which also gives Catalyst real sizes for its join choice.  Only where that setting is absent and the master
is local, as in tests, a temporary folder takes its place.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session.  Where there is none, a temporary one is set in local mode; on a cluster, whose
    executors don't see the driver's disk, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="terrafold-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables of one run of an iterative operator."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/terrafold-{uuid.uuid4().hex}"
        self.made = 0
        atexit.register(self.drop)

    def save(self, df: DataFrame, by: str | None = None, **counts: Column) -> tuple[DataFrame, dict]:
        """Write df and read it back.  ``counts``: aggregates taken in the same pass; ``n`` (rows) is always there.
        ``by``: the last column, which gives each of its values a folder of its own."""
        self.made += 1
        path, seen = f"{self.root}/{self.made}", Observation()
        w = df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counts.items()]).write
        (w.partitionBy(by) if by else w).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._terrafold_path = path
        return back, {k: v or 0 for k, v in seen.get.items()}

    def discard(self, df: DataFrame) -> None:
        """Delete the files of a table that a later round has replaced."""
        if path := getattr(df, "_terrafold_path", None):
            self._delete(path)

    def drop(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended; its owner cleans the shared folder
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
