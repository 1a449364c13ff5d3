"""Verdicts of rankers: reading, cleaning, routing and batching them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known_only(hits: DataFrame, known: DataFrame) -> DataFrame:
    """Hits (path, ...) whose path is known; paths that a model made up are dropped."""
    return hits.join(known.select("path"), "path", "left_semi")


def _number(value: Column, most: float) -> Column:
    """A number out of text, also as the one element of a list, between 0 and ``most``; 0 for anything else."""
    bare = F.regexp_replace(value.cast("string"), r"^\s*\[\s*([^,\]]*?)\s*\]\s*$", "$1")
    got = bare.try_cast("double")
    return F.when(F.isnan(got) | got.isNull(), 0.0).otherwise(F.least(F.lit(most), F.greatest(F.lit(0.0), got)))


def coerce_verdicts(verdicts: DataFrame) -> DataFrame:
    """score (a whole number, half up, 0 to 3) and confidence (0 to 1) of verdicts that hold them as text."""
    score = F.floor(_number(F.col("score"), 3.0) + 0.5).cast("double")
    return verdicts.withColumns({"score": score, "confidence": _number(F.col("confidence"), 1.0)})


def route_verdicts(verdicts: DataFrame) -> DataFrame:
    """include: score >= 2.5 with confidence >= 0.85; flag: score >= 1.5; others are dropped."""
    bucket = F.when((F.col("score") >= 2.5) & (F.col("confidence") >= 0.85), "include").when(F.col("score") >= 1.5, "flag")
    return verdicts.withColumn("bucket", bucket).where("bucket is not null")


def read_symbol_hits(replies: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, path, score) from JSON (text) that is a list of hits or has one under results: hits without a path are
    dropped, a score that is no number counts 1, and backslashes become slashes."""
    row = "array<struct<path:string,score:double>>"
    hits = F.when(F.trim("text").startswith("["), F.from_json("text", row)).otherwise(F.from_json("text", f"results {row}")["results"])
    rows = replies.select(key, F.explode(hits).alias("h")).where("h.path is not null and h.path <> ''")
    return rows.select(key, F.regexp_replace("h.path", r"\\", "/").alias("path"), F.when(F.isnan("h.score") | F.col("h.score").isNull(), 1.0).otherwise(F.col("h.score")).alias("score"))


def batch_usage(batches: DataFrame, by: str = "query_id") -> DataFrame:
    """(key, calls, tokens) of batched rows (key, batch, tokens): summed per batch before they meet."""
    rows = batches.groupBy(by, "batch").agg(F.sum("tokens").alias("tokens"))
    return rows.groupBy(by).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
