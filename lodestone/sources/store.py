"""Stored tables in versions: a version is seen once it is whole, and a write that fails leaves the last one."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def table_files(df: DataFrame) -> str:
    """A digest of the files behind a table read from files: names, sizes and times. No column of the table is read."""
    seen = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    got = seen.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*seen.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{got['n']}:{got['h']}"


def new_version(folder: str) -> str:
    """A folder for the tables of a version that is about to be written."""
    return f"{folder}/versions/{uuid.uuid4().hex}"


def publish(spark: SparkSession, folder: str, path: str, signature: str = "", **facts: str) -> int:
    """Makes the version at ``path``, whose tables are all written, the one that readers see; returns its number. The
    list of versions only grows, by a file that Spark puts there in one step."""
    last = latest(spark, folder)
    number = 0 if last is None else last["number"] + 1
    row = spark.createDataFrame([(number, path, signature, facts)], "number bigint, path string, signature string, facts map<string,string>")
    row.coalesce(1).write.mode("append").parquet(f"{folder}/list")
    return number


def latest(spark: SparkSession, folder: str, signature: str | None = None) -> Row | None:
    """number, path, signature and facts of the last version, or of the last one with that signature; None without."""
    try:
        rows = spark.read.schema("number bigint, path string, signature string, facts map<string,string>").parquet(f"{folder}/list")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    rows = rows if signature is None else rows.where(F.col("signature") == signature)
    return rows.orderBy(F.col("number").desc(), F.col("path")).first()
