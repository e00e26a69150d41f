"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = (
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled",
    "spark.sql.shuffleDependency.fileCleanup.enabled",
)
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, a temporary folder, but only in local mode: executors of a cluster would not share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        folder = _local.setdefault(app, tempfile.mkdtemp(prefix="strataloom-"))
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    The table outlives lost executors, later plans start from it, and the shuffle
    files of the job that wrote it are removed as soon as that job has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strataloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _CLEANUP}
    for k in _CLEANUP:
        spark.conf.set(k, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._strataloom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that no later plan reads."""
    for t in tables:
        path = getattr(t, "_strataloom_path", None)
        if path:
            jvm = t.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0
