"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of applications on one machine that name none.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder only where that is unset and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _own.get(app) or _own.setdefault(app, f"file://{tempfile.mkdtemp(prefix='strata-')}")
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut, and it is computed once."""
    path = f"{shared_dir(df.sparkSession)}/strata-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
