"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir`` or the context's checkpoint folder; one of our own only on a local master (tests)."""
    context = spark.sparkContext
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    return _LOCAL[app]


#: Spark's own setting: shuffle files go when their query ends, not when the driver happens to collect garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Writes intermediate tables as Parquet under one folder and rereads them.

    The shuffles of a ``save`` go when it ends. A reread table depends on files alone, so a lost executor costs only the
    tasks that ran there. ``drop`` removes tables no later step needs; those a
    returned DataFrame still reads stay until the application's folder goes.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{label}"
        schema = df.schema
        before = self.spark.conf.get(CLEAN_UP, "false")
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(CLEAN_UP, before)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
