"""What the operators of this subpackage share: reading tables, cutting lineage, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared folder for files that outlive executors; only a session on this machine alone may lack it."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the reliable checkpoint folder, so that lost executors never lose it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def may_hold(df: DataFrame, wanted: DataFrame, keys: list[str], out: str, bits: int = 1 << 26) -> DataFrame:
    """``df`` with ``out``: false where no row of ``wanted`` has the same ``keys`` (nulls are equal), true where one
    may have. ``wanted`` becomes a bitmap of ``bits`` bits, 8 MB however many rows it has, which is what is broadcast;
    where it fills up, more rows are marked than need be, never fewer."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(bits))
    words = wanted.select(F.expr("1L").alias("one"), bit.alias("bit")).select(F.expr("bit div 64").alias("word"), F.expr("shiftleft(one, cast(bit % 64 as int))").alias("b"))
    words = words.groupBy("word").agg(F.bit_or("b").alias("b"))
    held = F.map_from_entries(F.collect_list(F.struct(F.expr("cast(word % 128 as int)"), "b")))
    slots = words.groupBy(F.expr("word div 128").alias("__slot")).agg(held.alias("m"))
    slots = slots.select("__slot", F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.coalesce(F.try_element_at("m", i), F.expr("0L"))).alias("__bits"))
    marked = df.withColumn("__bit", bit).withColumn("__slot", F.expr("__bit div 8192")).join(F.broadcast(slots), "__slot", "left")
    word = F.get("__bits", F.expr("cast(__bit div 64 % 128 as int)"))
    return marked.withColumn(out, F.coalesce(F.getbit(word, F.expr("cast(__bit % 64 as int)")) == 1, F.lit(False))).drop("__slot", "__bit", "__bits")


def text_keys(text: Column) -> list[Column]:
    """h1 and h2, two hashes that stand for a text (null: empty), so that a row is known again however often Spark
    computes it."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the row offsets into them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, bounds


def slices(bounds: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, part: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the earlier rows of the same ``keys``; ``part`` is a column that cuts each
    key's rows, in their order, into parts of bounded length, so that no key's rows meet in one task."""
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*keys, part).agg(F.sum(value).alias("__sum")).withColumn("__base", F.coalesce(F.sum("__sum").over(across), F.lit(0)))
    joined = df.join(base.drop("__sum"), [*keys, part])
    return joined.withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__base")
