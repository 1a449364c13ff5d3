"""A corpus from raw documents to packed sequences: classify, filter, deduplicate, mix, pack."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, ngram_join, packing, quality_classifier, quality_rules
from lodestone.llm.shared import checkpoint_folder, table, text_keys


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers reject go. Null texts and metadata are judged like others, repeated
    rows alike; an empty table stays empty; other columns pass through."""
    return quality_classifier.keep_good(docs, quality_classifier.learn(docs, table(spark, sf_dir, "labels")))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go, null and empty texts among them; repeated rows fare alike; an empty
    table stays empty; other columns pass through."""
    return quality_rules.filter_documents(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, also of those without words and of repeated rows; an empty
    table stays empty; other columns pass through."""
    return ngram_join.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number (never, once or twice). The rows are in no
    order: packing deals them out anew, and ``mixing.mixed_spans`` gives the order of the mix where it matters.

    Rows that repeat an id and its text are told apart by nothing else and come as copies of one of them. Null and
    empty texts give nothing; an empty table gives no rows; columns may have any name, but maps can't be hashed: there
    must be no such column.
    """
    keys = dict(zip(("__h1", "__h2"), text_keys(F.col("text")), strict=True))
    known = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__id"), *[c.alias(k) for k, c in keys.items()])
    mixed = mixing.mix_documents(docs.select("doc_id", "text", "source", *[c.alias(k) for k, c in keys.items()]), keep=("__h1", "__h2"))
    mixed = mixed.select(F.col("doc_id").alias("__id"), "__h1", "__h2", F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("bigint").alias("__n")).where("__n > 0")
    times = mixed.groupBy("__id", "__h1", "__h2").agg(F.sum("__n").alias("__n"))
    # one row of each, then its copies
    rows = known.groupBy("__id", "__h1", "__h2").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
    same = F.col("d.__id").eqNullSafe(F.col("t.__id")) & (F.col("d.__h1") == F.col("t.__h1")) & (F.col("d.__h2") == F.col("t.__h2"))
    both = rows.alias("d").join(times.alias("t"), same).select("__row", F.explode(F.expr("sequence(1L, __n)")).alias("__copy"))
    return both.select("__row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents' pieces with their places in sequences of 2048 tokens. Null texts are empty and hold an end
    id; copies are packed as often as they occur; an empty table gives no rows; other columns are not read."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("quality_rules", keep_clean),
    ("ngram_jaccard", keep_distinct),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]
#: SQL can't express the trained classifier or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
