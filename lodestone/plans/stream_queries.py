"""Registered queries of streams and hooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import hooks as H
from lodestone.functions import text as T
from lodestone.operators import vectors as V
from lodestone.plans.corpus_queries import headed
from lodestone.plans.registry import register
from lodestone.plans.session_queries import TURNS, _turns
from lodestone.plans.tables import table
from lodestone.sources.files import scratch_folder
from lodestone.streaming import jobs as J


#: Events in two steps, every tenth in the second; how far the stream's clock, an hour late, comes in each.
STEPS = """steps AS (SELECT *, event_id % 10 = 0 AS second FROM events),
clock AS (SELECT max(ts) FILTER (NOT second) - INTERVAL 1 HOUR AS w1, max(ts) - INTERVAL 1 HOUR AS w2 FROM steps)"""
QUOTA = "sum(round(value * 100)::BIGINT)::BIGINT AS used, count(*)::BIGINT AS calls, sum(round(value * 100)::BIGINT) > 20000 OR count(*) > 80 AS over"


def _steps(spark: SparkSession, sf_dir: str, *columns: Column) -> list[DataFrame]:
    """Events that come in two steps; nearly all of the second are late."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return [events.where(c).select(*columns) for c in ("event_id % 10 <> 0", "event_id % 10 = 0")]


def _requests(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return _steps(spark, sf_dir, (F.col("user_id") % 50).alias("client"), F.col("ts"), F.round(F.col("value") * 100).cast("bigint").alias("tokens"))


@register(
    "str01_stream_quota",
    f"""WITH {STEPS}, w AS (SELECT user_id % 50 AS client, make_timestamp(epoch_us(ts) // 3600000000 * 3600000000) AS start, value, second FROM steps)
SELECT client, start, {QUOTA} FROM w, clock WHERE (NOT second OR start + INTERVAL 1 HOUR > w1) AND start + INTERVAL 1 HOUR <= w2 GROUP BY client, start""",
)
def str01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of 50 clients in windows of an hour: those that are final, without requests that came late."""
    return J.replay_in_steps(_requests(spark, sf_dir), lambda s: J.stream_quota(s, 20_000, width="1 hour", late="1 hour"), name="quota")


@register(
    "str01_sliding_quota",
    f"""WITH {STEPS}, w AS (SELECT user_id % 50 AS client, make_timestamp((epoch_us(ts) // 900000000 - unnest([0, 1, 2, 3])) * 900000000) AS start, value, second FROM steps)
SELECT client, start, {QUOTA} FROM w, clock WHERE NOT second OR start + INTERVAL 1 HOUR > w1 GROUP BY client, start""",
)
def str01_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in windows that begin every quarter of an hour, each as it was last given out."""
    return J.replay_in_steps(_requests(spark, sf_dir), lambda s: J.stream_quota(s, 20_000, width="1 hour", slide="15 minutes", late="1 hour"), "update", ["client", "start"], name="sliding")


@register("str04_stream_progress", "SELECT user_id AS job, event_type AS stage, count(*)::BIGINT AS done, arg_max(props, (ts, props)) AS latest FROM events GROUP BY ALL")
def str04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's stages as they were last given out; the second step changes some."""
    parts = _steps(spark, sf_dir, F.col("user_id").alias("job"), F.col("event_type").alias("stage"), F.col("ts"), F.col("props").alias("message"))
    return J.replay_in_steps(parts, J.stream_progress, "update", ["job", "stage"], name="progress")


def _spells(rows: str) -> str:
    return f"""(SELECT job, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*)::BIGINT AS events, list(ts) AS held
  FROM (SELECT *, sum(new) OVER (PARTITION BY job ORDER BY ts) AS spell FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY job ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM {rows})) GROUP BY job, spell)"""


@register(
    "str04_idle_spells",
    f"""WITH {STEPS}, e AS (SELECT user_id % 20 AS job, ts, second FROM steps), one AS {_spells("(SELECT * FROM e WHERE NOT second)")},
live AS (SELECT job, unnest(held) AS ts FROM one, clock WHERE stop > w1 UNION ALL SELECT job, ts FROM e, clock WHERE second AND ts + INTERVAL 6 HOUR > w1), two AS {_spells("live")}
SELECT job, start, stop, events FROM one, clock WHERE stop <= w1 UNION ALL SELECT job, start, stop, events FROM two, clock WHERE stop <= w2""",
)
def str04_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spells of work of 20 jobs, ended by six idle hours."""
    parts = _steps(spark, sf_dir, (F.col("user_id") % 20).alias("job"), F.col("ts"))
    return J.replay_in_steps(parts, lambda s: J.stream_spells(s, "6 hours", "1 hour"), name="spells")


@register(
    "str02_stream_sessions",
    f"""WITH {TURNS}, f AS (SELECT *, CASE WHEN asks AND row_number() OVER (PARTITION BY session_id, asks, turn % 10 ORDER BY turn) = 1 THEN 1 ELSE 0 END AS new FROM turns),
n AS (SELECT *, row_number() OVER w AS k, sum(new) OVER w AS supplied, sum((outcome = 'regressed')::INTEGER) OVER w AS regressions FROM f WINDOW w AS (PARTITION BY session_id ORDER BY turn))
SELECT session_id, turn, k::BIGINT AS turns, CASE WHEN outcome = 'applied' THEN 'green' WHEN outcome = 'no-op' OR k >= 12 THEN 'blocked' ELSE 'awaiting-response' END AS status, true AS accepted, supplied::BIGINT AS supplied, regressions::BIGINT AS regressions FROM n""",
)
def str02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that ask for context name a path by the last digit of their number."""
    folder = scratch_folder(spark, "turns")
    needs = F.when(F.col("needs") > 0, F.array(F.concat(F.lit("src/"), F.col("turn") % 10))).otherwise(F.array().cast("array<string>"))
    _turns(spark, sf_dir).select("session_id", "turn", "outcome", needs.alias("needs")).write.parquet(folder)
    return J.replay(J.stream_sessions(J.read_stream(spark, folder)), "append", "sessions")


@register("str03_stream_index", "SELECT doc_id AS chunk_id, md5(text) AS digest, count(*) OVER (PARTITION BY text)::BIGINT AS alike, (SELECT count(DISTINCT text) FROM documents)::BIGINT AS embedded FROM documents")
def str03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as chunks, each with a row, and how many share its vector; equal texts are embedded once, which
    is counted where it is done."""
    folder, asked = scratch_folder(spark, "stream-index"), []
    docs = J.read_stream(spark, f"{sf_dir.rstrip('/')}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")

    def embed(chunks: DataFrame) -> DataFrame:
        asked.append(chunks.count())
        return H.embed_chunks(chunks)

    J.stream_index(docs, lambda b: b, embed, folder)
    rows = J.read_stream_index(spark, folder)
    per = rows.groupBy("key", "embedding").agg(F.count("*").alias("alike"))
    return rows.join(per, ["key", "embedding"]).select("chunk_id", F.md5("text").alias("digest"), "alike", F.lit(sum(asked)).cast("bigint").alias("embedded"))


@register("udf01_embedder")
def udf01(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return H.embed_chunks(chunks).select("chunk_id", F.size("embedding").alias("width"), F.round(V.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"))


@register("udf02_token_counter", "SELECT source, sum(ceil(length(text) / 3.2::DOUBLE))::BIGINT AS tokens, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def udf02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two counters through the same hook: the default and plain length."""
    count = lambda counter: F.sum(counter(F.col("text"))).cast("bigint")
    return table(spark, sf_dir, "documents").groupBy("source").agg(count(T.estimate_tokens).alias("tokens"), count(F.length).alias("chars"))


@register("udf03_scorer")
def udf03(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_brand").alias("query_id"), F.expr("p_partkey div 5000").alias("batch"), F.col("p_partkey").alias("path"), F.col("p_retailprice").alias("raw"))
    return H.score_candidates(rows)


@register("udf04_extractor")
def udf04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.extract_texts(table(spark, sf_dir, "pages"))


@register("udf05_document_predicate", "SELECT label AS document, count(*)::BIGINT AS chunks FROM embeddings WHERE label IN (1, 3, 5) GROUP BY label")
def udf05(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = F.col("document").isin(1, 3, 5)
    chunks = table(spark, sf_dir, "embeddings").select(F.col("label").alias("document"))
    return chunks.where(keep).groupBy("document").agg(F.count("*").alias("chunks"))


@register("udf06_chunk_text")
def udf06(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("chunk_table", H.ChunkTable)
    return spark.sql("SELECT doc_id, chunk_index, heading_path, tokens, md5(text) AS digest FROM chunk_table(TABLE(SELECT doc_id, text FROM {docs}), 300, 50)", docs=headed(spark, sf_dir))
