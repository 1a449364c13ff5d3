"""Engine tables derived from the driver's tables; each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, where its files give fewer (a small table in one file).
    Larger tables keep their own partitions and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: doc_id, path, content."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".md"))).alias("path"), F.col("text").alias("content"))


FILES = "files AS (SELECT doc_id, source || '/' || lang || '/doc-' || doc_id || '.md' AS path, text AS content FROM documents)"


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries: query_id, terms (all distinct tokens of the text)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.tokenize(F.col("text")).alias("terms"))


def sql_tokens(x: str) -> str:
    """The tokens of a SQL expression as a list in first-seen order."""
    parts = f"""list_concat(
      list_filter(list_transform(regexp_split_to_array({x}, '[^a-zA-Z0-9]+'), lambda w: lower(w)), lambda w: length(w) BETWEEN 2 AND 40),
      list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: length(w) BETWEEN 2 AND 40))"""
    fused = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(p) for p in v)}]" for k, v in T.FUSED.items())
    full = f"(SELECT list_concat(p, flatten(list_transform(p, lambda w: CASE w {fused} ELSE []::VARCHAR[] END))) FROM (SELECT {parts} AS p))"
    return f"(SELECT list(w ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT {full} AS l)) GROUP BY w))"


def sql_stem(w: str) -> str:
    soft = lambda b: f"right({b}, 2) IN ('at', 'bl', 'iz')"
    twice = lambda b: f"length({b}) >= 3 AND right({b}, 1) = left(right({b}, 2), 1)"
    cut = lambda n: f"left({w}, length({w}) - {n})"
    return f"""CASE WHEN length({w}) <= 3 THEN {w}
      WHEN {w} LIKE '%sses' THEN {cut(2)} WHEN {w} LIKE '%ies' THEN {cut(3)} || 'y' WHEN {w} LIKE '%ss' THEN {w}
      WHEN {w} LIKE '%s' AND {w} NOT LIKE '%us' AND {w} NOT LIKE '%is' THEN {cut(1)}
      WHEN {w} LIKE '%eed' AND length({w}) > 4 THEN {cut(1)}
      WHEN {w} LIKE '%ed' AND length({w}) > 4 THEN CASE WHEN {soft(cut(2))} THEN {cut(2)} || 'e' ELSE {cut(2)} END
      WHEN {w} LIKE '%ing' AND length({w}) > 5 THEN CASE WHEN {soft(cut(3))} THEN {cut(3)} || 'e' WHEN {twice(cut(3))} THEN {cut(4)} ELSE {cut(3)} END
      WHEN {w} LIKE '%er' AND length({w}) > 4 THEN CASE WHEN {twice(cut(2))} THEN {cut(3)} ELSE {cut(2)} END
      ELSE {w} END"""
