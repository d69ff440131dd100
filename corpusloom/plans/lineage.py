"""Cuts the lineage of iterative plans with a reliable checkpoint in the shared folder the cluster names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

#: Spark's setting by which a query's shuffle files go when it ends, and not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    folder(df)
    return df.checkpoint()


def folder(df: DataFrame) -> str:
    """The shared folder of checkpoints, set if it isn't."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:  # nobody names one: a local session
            import tempfile

            shared = tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(shared)
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in that folder and read again; the shuffle files of the query that wrote it go."""
    spark = df.sparkSession
    path = f"{folder(df).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the tables that df, from `stored`, reads. Nothing may read it any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
