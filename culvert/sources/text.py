"""Shared steps of text readers: whole files and their numbered lines, one row each."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local
    master sets one of this machine; on a cluster that is an error, as executors could not read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="culvert-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(network_id, file, text): every file of a path; the id is a code of the file's path.

    A file is small and is read whole; files are spread over tasks by Spark's reader.
    """
    found = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return found.select(F.xxhash64("file").alias("network_id"), "file", F.col("value").alias("text"))


def lines(found: DataFrame) -> DataFrame:
    """(network_id, file, line_no from 1, line) of files()."""
    split = F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("k", "line")
    return found.select("network_id", "file", split).select("network_id", "file", (F.col("k") + 1).alias("line_no"), "line")


def number(text: Column) -> Column:
    """The number a text stands for; NULL if it is none."""
    return F.trim(text).try_cast("double")


def named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(k) for k, c in columns.items()]
