"""Session helpers: table loading and fault-tolerant lineage cuts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one only in local mode where none is set (tests).

    On a cluster a folder of one machine would be lost with it, so there it has to be named.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = named or tempfile.mkdtemp(prefix="paperloom-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: its lineage ends there and survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
