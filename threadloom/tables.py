"""Tables that cut a plan's lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in `spark.checkpoint.dir`.

    Only where that is unset and all runs in one process, as in tests, a temporary
    folder takes its place; on a cluster it is an error, as executors would write to
    disks that others do not see.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = shared_dir.own = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="threadloom-")
    return where.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet to the shared folder and read them back.

    What is read back has a known size, so that Spark's own broadcast threshold
    applies to a measured figure and not to an estimate.  The files outlive any
    executor; the cluster clears the folder.
    """
    path = f"{shared_dir(df.sparkSession)}/threadloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
