"""Intermediate tables of one run, in the shared checkpoint folder.

A table several later steps read is written once, so an executor loss never
replays the work before it, its real size is known to the optimizer, and the
fuzzy UDF runs once per pair.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode without any."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="colweave-"))
    return context.getCheckpointDir()


class Workspace:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_root(spark).rstrip('/')}/colweave/{uuid.uuid4().hex}"
        self.names: list[str] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, name: str, **more: Column) -> tuple[DataFrame, dict]:
        """Write a table; also its number of rows ``n`` and ``more`` aggregates, seen while it is written."""
        seen = Observation()
        told = self.table(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in more.items()]), name)
        return told, seen.get

    def last(self, df: DataFrame, name: str) -> DataFrame:
        """Write the run's last table and delete all others of the run."""
        told = self.table(df, name)
        self.drop_but(name)
        return told

    def drop_but(self, *kept: str) -> None:
        """Delete all tables of the run but some."""
        gone = [n for n in self.names if n not in kept]
        if gone:
            self.drop(*gone)
        self.names = [n for n in self.names if n in kept]

    def drop(self, *names: str) -> None:
        """Delete intermediate tables no later step needs (all of the run's when none is named)."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for target in [f"{self.root}/{n}" for n in names] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(target)
            path.getFileSystem(conf).delete(path, True)


#: Input bytes per task of a CPU-bound stage.
TASK_BYTES = 4 << 20


def input_bytes(df: DataFrame) -> int:
    """Size of the tables a frame reads, as the optimizer knows it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


#: What the optimizer says of a leaf whose size it does not know is at least this.
UNKNOWN_BYTES = 1 << 60


def task_count(*frames: DataFrame) -> int:
    """Partitions for CPU-bound stages, whose cost AQE cannot see in their bytes.

    By input size and at least one per core; ``spark.sql.shuffle.partitions`` for inputs of unknown size.
    """
    spark = frames[0].sparkSession
    size = sum(map(input_bytes, frames))
    if size >= UNKNOWN_BYTES:
        wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    else:
        wanted = size // TASK_BYTES + 1
    return max(wanted, spark.sparkContext.defaultParallelism)
