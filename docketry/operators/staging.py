"""Intermediate results of loops and of rows that are read twice."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. A session on one machine gets a temporary folder where it names none;
    on a cluster that would be another one on each machine, so it raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="docketry-"))
    return _local[0]


def settle(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder, with its lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
