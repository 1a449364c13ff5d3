"""Registered queries of sessions, events and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import corpus as C
from lodestone.operators import ranking as R
from lodestone.operators import sessions as S
from lodestone.plans.corpus_queries import VERDICTS, _verdicts
from lodestone.plans.registry import register
from lodestone.plans.tables import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a day as stages of a verification; an error is a failed stage."""
    return _events(spark, sf_dir).select("user_id", F.to_date("ts").alias("day"), "event_id", F.col("event_type").alias("stage"), (F.col("event_type") != "error").alias("success"))


STAGES = "stages AS (SELECT user_id, ts::DATE AS day, event_id, event_type AS stage, event_type <> 'error' AS success, ts FROM events)"


@register("win15_stop_at_first_failure", f"WITH {STAGES} SELECT event_id, success FROM (SELECT *, max((NOT success)::INTEGER) OVER (PARTITION BY user_id, day ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bad FROM stages) WHERE coalesce(bad, 0) = 0")
def win15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stop_at_first_failure(_stages(spark, sf_dir), ["user_id", "day"], ["event_id"]).select("event_id", "success")


@register(
    "agg07_check_regression",
    f"""WITH {STAGES}, f AS (SELECT user_id, day >= DATE '2024-01-16' AS late, success, CASE WHEN success THEN 0 ELSE event_id % 3 END AS n FROM stages),
s AS (SELECT user_id, coalesce(sum(n) FILTER (NOT late), 0)::BIGINT AS baseline_count, coalesce(sum(n) FILTER (late), 0)::BIGINT AS current_count, coalesce(bool_and(success) FILTER (NOT late), true) AS a, coalesce(bool_and(success) FILTER (late), true) AS b, count(*) FILTER (late AND NOT success AND n = 0)::BIGINT AS unparsed_failures FROM f GROUP BY user_id)
SELECT user_id, baseline_count, current_count, (a AND NOT b) OR current_count > baseline_count AS regressed, unparsed_failures FROM s""",
)
def agg07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stages(spark, sf_dir).withColumn("failures", F.when(F.col("success"), 0).otherwise(F.col("event_id") % 3))
    return S.check_regression(rows.where("day < '2024-01-16'"), rows.where("day >= '2024-01-16'"), "user_id")


@register("agg08_summarize_verification", f"WITH {STAGES} SELECT user_id, coalesce(string_agg(stage || ' failed (' || (event_id % 3) || '): event ' || event_id, '; ' ORDER BY event_id) FILTER (NOT success), 'All verification stages passed.') AS summary FROM stages GROUP BY user_id")
def agg08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stages(spark, sf_dir).select("user_id", F.col("event_id").alias("stage_no"), "stage", "success", (F.col("event_id") % 3).alias("failures"), F.concat(F.lit("event "), "event_id").alias("first_failure"))
    return S.summarize_verification(rows, "user_id")


@register("win16_mru_list", "WITH o AS (SELECT user_id, event_type || '/' || (floor(value)::INTEGER % 20) AS path, max(ts) AS ts FROM events GROUP BY ALL) SELECT user_id, path, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, path)::INTEGER AS place FROM o QUALIFY place <= 10")
def win16(spark: SparkSession, sf_dir: str) -> DataFrame:
    opens = _events(spark, sf_dir).select("user_id", F.concat("event_type", F.lit("/"), F.floor("value").cast("int") % 20).alias("path"), "ts")
    return S.mru_list(opens).select("user_id", "path", "place")


@register(
    "win12_quota_audit",
    """WITH r AS (SELECT user_id % 50 AS client, event_id AS id, epoch_us(ts) AS us, (value * 100)::BIGINT AS tokens FROM events),
w AS (SELECT a.client, a.id, a.tokens, coalesce(sum(b.tokens), 0)::BIGINT AS used, count(b.id)::BIGINT AS calls FROM r a LEFT JOIN r b ON b.client = a.client AND b.us BETWEEN a.us - 3599999999 AND a.us AND (b.us < a.us OR b.id < a.id) GROUP BY a.client, a.id, a.tokens)
SELECT *, (calls > 0 AND used + tokens > 20000) OR calls + 1 > 80 AS over FROM w""",
)
def win12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of 50 clients, over an hour, since events are sparse."""
    requests = _events(spark, sf_dir).select((F.col("user_id") % 50).alias("client"), F.col("event_id").alias("id"), "ts", F.round(F.col("value") * 100).cast("bigint").alias("tokens"))
    return S.quota_audit(requests, tokens=20_000, seconds=3600)


@register("win13_fixed_batches", f"WITH {VERDICTS} SELECT query_id, path, ((row_number() OVER (PARTITION BY query_id ORDER BY path) - 1) // 20)::BIGINT AS batch FROM verdicts")
def win13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fixed_batches(_verdicts(spark, sf_dir), 20, "query_id", "path").select("query_id", "path", F.col("batch").cast("bigint").alias("batch"))


@register("agg14_batch_usage", f"WITH {VERDICTS}, b AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY path) - 1) // 20 AS batch FROM verdicts) SELECT query_id, count(DISTINCT batch)::BIGINT AS calls, sum(path)::BIGINT AS tokens FROM b GROUP BY query_id")
def agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.batch_usage(S.fixed_batches(_verdicts(spark, sf_dir), 20, "query_id", "path").withColumn("tokens", F.col("path")))


@register("jon17_zero_fill_verdicts", f"WITH {VERDICTS.replace('FROM part)', 'FROM part WHERE p_partkey % 7 <> 0)')} SELECT p_brand AS query_id, p_partkey AS path, coalesce(score, 0) AS score, round(coalesce(confidence, 0), 6) AS confidence FROM part LEFT JOIN verdicts ON path = p_partkey")
def jon17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as candidates, of which every seventh has no verdict."""
    first = _verdicts(spark, sf_dir).where("path % 7 <> 0").withColumn("ord", F.lit(0))
    later = first.withColumn("ord", F.lit(1)).withColumn("score", F.lit(9.0))
    candidates = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("path"))
    return S.zero_fill_verdicts(candidates, later.unionByName(first)).withColumn("confidence", F.round("confidence", 6))


OUTCOME = "CASE WHEN turn % 5 = 4 THEN 'needed-context' WHEN role = 'system' THEN 'no-op' WHEN turn % 7 = 6 THEN 'rejected' WHEN role = 'user' AND turn % 3 = 2 THEN 'regressed' WHEN role = 'assistant' AND turn % 2 = 1 THEN 'applied' ELSE 'failed' END"
TURNS = f"turns AS (SELECT conv_id AS session_id, turn, role, text, {OUTCOME} AS outcome, turn % 5 = 4 AS asks FROM conversations)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation rows as turns whose outcome follows from role and place."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", "text")
    flags = rows.select(
        "*",
        F.when(F.col("turn") % 5 == 4, 1).otherwise(0).alias("needs"),
        F.when(F.col("role") == "system", 0).otherwise(1).alias("files"),
        (F.col("turn") % 7 == 6).alias("blocked"),
        ((F.col("role") == "user") & (F.col("turn") % 3 == 2)).alias("regressed"),
        ((F.col("role") == "assistant") & (F.col("turn") % 2 == 1)).alias("green"),
        F.lit(1).alias("commands"),
    )
    return S.turn_outcome(flags)


@register("win18_turn_outcome", f"WITH {TURNS}, l AS (SELECT session_id, arg_max(outcome, turn) AS last, count(*)::BIGINT AS turns FROM turns GROUP BY session_id) SELECT session_id, turns, CASE WHEN last = 'applied' THEN 'green' WHEN last = 'no-op' OR turns >= 12 THEN 'blocked' ELSE 'awaiting-response' END AS status FROM l")
def win18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.session_status(_turns(spark, sf_dir))


@register("agg09_loop_metrics", f"WITH {TURNS} SELECT session_id, min(turn) FILTER (outcome = 'applied') AS turns_to_green, count(*) FILTER (outcome = 'regressed')::BIGINT AS regressions, count(*) FILTER (outcome = 'rejected')::BIGINT AS repairs, count(DISTINCT length(text) % 10) FILTER (outcome <> 'failed')::BIGINT AS files_touched FROM turns GROUP BY ROLLUP (session_id)")
def agg09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.loop_metrics(_turns(spark, sf_dir).withColumn("path", F.length("text") % 10))


@register("agg12_last_verification", f"WITH {TURNS} SELECT session_id, max(turn) AS turn, arg_max(outcome, turn) AS verification FROM turns WHERE role = 'assistant' GROUP BY session_id")
def agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.last_verification(_turns(spark, sf_dir).withColumn("verification", F.when(F.col("role") == "assistant", F.col("outcome"))))


@register("win14_compact_turns", f"WITH {TURNS}, b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS back FROM turns), e AS (SELECT session_id, turn, CASE outcome WHEN 'regressed' THEN 'regressed: rolled back' WHEN 'failed' THEN 'failed' WHEN 'needed-context' THEN 'requested 1 file(s)' WHEN 'rejected' THEN 'changes rejected, nothing applied' END AS line FROM b WHERE back > 2) SELECT session_id, turn, 'history: Turn ' || turn || ': ' || line AS entry FROM e WHERE line IS NOT NULL UNION ALL SELECT session_id, turn, 'kept as ' || row_number() OVER (PARTITION BY session_id ORDER BY turn) FROM b WHERE back <= 2")
def win14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With two turns kept, since conversations are short."""
    kept, ledger = S.compact_turns(_turns(spark, sf_dir).withColumn("detail", F.lit(None).cast("string")), keep=2)
    return ledger.unionByName(kept.select("session_id", "turn", F.concat(F.lit("kept as "), "index").alias("entry")))


@register("src11_read_sessions", "WITH s AS (SELECT 's-' || conv_id AS id, 'p' || (conv_id % 7) AS project, CASE WHEN conv_id % 3 = 0 THEN 'active' ELSE 'green' END AS status, conv_id * 1000 AS updated_at, count(*)::BIGINT AS turns FROM conversations WHERE conv_id % 10 <> 9 GROUP BY conv_id) SELECT *, row_number() OVER (PARTITION BY project ORDER BY updated_at DESC)::BIGINT AS place, status = 'active' AND updated_at = max(CASE WHEN status = 'active' THEN updated_at END) OVER (PARTITION BY project) AS active FROM s")
def src11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as session files; every tenth is cut off."""
    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"))
    text = F.to_json(F.struct(F.concat(F.lit("s-"), "conv_id").alias("id"), F.concat(F.lit("p"), F.col("conv_id") % 7).alias("project"), F.when(F.col("conv_id") % 3 == 0, "active").otherwise("green").alias("status"), (F.col("conv_id") * 1000).alias("updated_at"), "turns"))
    read = S.read_sessions(per.select(F.when(F.col("conv_id") % 10 == 9, F.left(text, F.lit(20))).otherwise(text).alias("value")))
    return S.session_summaries(read)


SNAPSHOTS = """b AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'backup' WHEN o_orderkey % 3 = 1 THEN 'untracked' ELSE 'index' END AS origin, o_orderstatus AS hash FROM orders WHERE o_orderkey % 5 <> 0),
n AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 5 = 0 THEN 'untracked' ELSE 'index' END AS origin, CASE WHEN o_custkey % 4 = 0 THEN 'changed' ELSE o_orderstatus END AS hash FROM orders WHERE o_custkey % 6 <> 0)"""


@register("set02_rollback_plan", f"WITH {SNAPSHOTS} SELECT path, 'delete' AS action FROM n WHERE origin = 'untracked' AND path NOT IN (SELECT path FROM b WHERE origin <> 'backup') UNION ALL SELECT path, CASE WHEN n.path IS NULL THEN 'restore' ELSE 'skip_modified' END FROM (SELECT b.path, b.hash AS h FROM b WHERE origin = 'backup') x LEFT JOIN n USING (path) WHERE n.path IS NULL OR n.hash <> h")
def set02(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    before = orders.where("o_orderkey % 5 <> 0").select(k.alias("path"), F.when(k % 3 == 0, "backup").when(k % 3 == 1, "untracked").otherwise("index").alias("origin"), F.col("o_orderstatus").alias("hash"))
    now = orders.where("o_custkey % 6 <> 0").select(k.alias("path"), F.when(k % 5 == 0, "untracked").otherwise("index").alias("origin"), F.when(F.col("o_custkey") % 4 == 0, "changed").otherwise(F.col("o_orderstatus")).alias("hash"))
    return S.rollback_plan(before, now)


@register("set05_skipped_documents", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def set05(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return C.skipped_documents(table(spark, sf_dir, "documents").select("doc_id"), done)


@register("set06_changed_paths", f"WITH {TURNS}, a AS (SELECT DISTINCT session_id, length(text) % 10 AS path FROM turns WHERE outcome = 'applied'), e AS (SELECT DISTINCT session_id, length(text) % 10 AS path FROM turns WHERE role = 'user') SELECT a.session_id, count(*)::BIGINT AS changed, count(e.path)::BIGINT AS expected FROM a LEFT JOIN e ON a.session_id = e.session_id AND a.path = e.path GROUP BY a.session_id")
def set06(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir).withColumn("path", F.length("text") % 10)
    changed = S.changed_paths(turns)
    both = changed.intersect(turns.where("role = 'user'").select("session_id", "path")).withColumn("hit", F.lit(1))
    return changed.join(both, ["session_id", "path"], "left").groupBy("session_id").agg(F.count("*").alias("changed"), F.count("hit").alias("expected"))


@register("win09_pack_batches")
def win09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as items of a shard."""
    docs = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("-"), F.col("doc_id") % 1024).alias("shard"), F.col("doc_id").alias("ord"), T.estimate_tokens(F.col("text")).alias("tokens"))
    return S.pack_batches(docs)


def _budget_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = T.estimate_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit("-"), F.expr("doc_id div 1000")).alias("query_id"), (F.col("doc_id") % 3).alias("priority"), F.concat(F.lit("doc-"), "doc_id").alias("path"), F.col("doc_id").alias("ord"), tokens.alias("tokens"), F.when(F.col("doc_id") % 2 == 0, F.ceil(tokens / 10)).alias("outline_tokens"))


@register("win10_fit_to_budget")
def win10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fit_to_budget(_budget_files(spark, sf_dir), 8000)


@register("win11_fill_prompt")
def win11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fill_prompt(_budget_files(spark, sf_dir), 8000)


@register("jon15_stale_changes", "SELECT doc_id FROM documents WHERE doc_id % 4 = 0")
def jon15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes recorded with a prompt against contents of which every fourth has changed since."""
    docs = table(spark, sf_dir, "documents")
    recorded = docs.select("doc_id", T.content_hash(F.col("text")).alias("recorded"))
    now = docs.select("doc_id", T.content_hash(F.concat("text", F.when(F.col("doc_id") % 4 == 0, "!").otherwise(""))).alias("now"))
    return recorded.join(now, "doc_id").where("recorded <> now").select("doc_id")


@register("jon18_context_candidates", f"WITH {TURNS}, f AS (SELECT session_id, turn AS path FROM turns WHERE turn <> 2), r AS (SELECT session_id, 2 AS path FROM turns GROUP BY session_id), a AS (SELECT session_id, turn AS path FROM turns WHERE role = 'assistant'), k AS (SELECT session_id, turn AS path, row_number() OVER (PARTITION BY session_id ORDER BY length(text), turn) - 1 AS rank, count(*) OVER (PARTITION BY session_id) AS n FROM turns), u AS (SELECT session_id, path FROM f UNION SELECT session_id, path FROM r) SELECT u.session_id, u.path, round(CASE WHEN u.path = 2 THEN 0 WHEN a.path IS NOT NULL THEN 1 ELSE 2 + rank / n END, 6) AS priority, f.path IS NULL AS missing FROM u LEFT JOIN a USING (session_id, path) LEFT JOIN k USING (session_id, path) LEFT JOIN f USING (session_id, path)")
def jon18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as files: turn 2 is requested but missing, assistants' turns were changed, all are recalled by length."""
    turns = _turns(spark, sf_dir).select("session_id", F.col("turn").alias("path"), "role", F.length("text").alias("n"))
    recall = turns.select("session_id", "path", (F.row_number().over(Window.partitionBy("session_id").orderBy("n", "path")) - 1).alias("rank"), F.count("*").over(Window.partitionBy("session_id")).alias("of"))
    requested = turns.select("session_id").distinct().withColumn("path", F.lit(2).cast("bigint"))
    rows = S.context_candidates(turns.where("path <> 2"), requested, turns.where("role = 'assistant'"), recall)
    return rows.withColumn("priority", F.round("priority", 6))
