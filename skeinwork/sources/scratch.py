"""Tables that a run writes and reads back: they cut the lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

UNSET = "unset"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Only where that is unset and everything runs on one machine (tests) a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", UNSET)
    if found != UNSET:
        return found.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skeinwork-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The folder belongs to the run; whoever owns ``spark.checkpoint.dir`` clears it after the run.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skeinwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
