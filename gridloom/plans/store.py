"""Tables between the rounds of iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the one that the cluster shares. Only where the session names none and driver and
    executors are one process, one is made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark._round_tables = getattr(spark, "_round_tables", None) or tempfile.mkdtemp(prefix="rounds-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, name: str) -> DataFrame:
    """Writes a round's table to the shared folder and reads it again, so lineage stays short and a lost executor loses
    nothing."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
