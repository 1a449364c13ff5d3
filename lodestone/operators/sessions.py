"""Sessions and turns: outcomes, verification, regressions, compaction, metrics and request quotas."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.corpus import ordered_paths
from lodestone.sources.files import checkpointed


def stop_at_first_failure(stages: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Stages up to the first failed one; later ones were not run."""
    earlier = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return stages.withColumn("__bad", F.max(~F.col("success")).over(earlier)).where("__bad is null or not __bad").drop("__bad")


def check_regression(baseline: DataFrame, current: DataFrame, by: str) -> DataFrame:
    """(key, baseline_count, current_count, regressed, unparsed_failures) from rows (key, success, failures: count).
    An empty side is green; a failed stage without parsed failures counts 0 and is shown apart."""
    side = lambda df, n: df.groupBy(by).agg(F.sum("failures").alias(f"{n}_count"), F.min("success").alias(f"{n}_green"), F.sum(F.when(~F.col("success") & (F.col("failures") == 0), 1).otherwise(0)).alias(f"{n}_unparsed"))
    both = side(baseline, "baseline").join(side(current, "current"), by, "full_outer")
    a, b = F.coalesce("baseline_count", F.lit(0)).cast("bigint"), F.coalesce("current_count", F.lit(0)).cast("bigint")
    green = lambda n: F.coalesce(F.col(f"{n}_green"), F.lit(True))
    return both.select(by, a.alias("baseline_count"), b.alias("current_count"), ((green("baseline") & ~green("current")) | (b > a)).alias("regressed"), F.coalesce("current_unparsed", F.lit(0)).cast("bigint").alias("unparsed_failures"))


def summarize_verification(stages: DataFrame, by: str) -> DataFrame:
    """(key, summary): one clause for each failed stage (key, stage_no, stage, success, failures, first_failure)."""
    clause = F.concat("stage", F.lit(" failed ("), "failures", F.lit("): "), F.coalesce("first_failure", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.when(~F.col("success"), F.struct("stage_no", clause.alias("clause")))))
    joined = F.array_join(F.transform(ordered, lambda x: x["clause"]), "; ")
    return stages.groupBy(by).agg(joined.alias("s")).select(by, F.when(F.col("s") == "", "All verification stages passed.").otherwise(F.col("s")).alias("summary"))


def turn_outcome(turns: DataFrame) -> DataFrame:
    """outcome of rows with needs, files (counts), blocked, regressed, green (flags) and commands (count)."""
    outcome = (
        F.when(F.col("needs") > 0, "needed-context")
        .when(F.col("files") == 0, "no-op")
        .when(F.col("blocked"), "rejected")
        .when(F.col("commands") == 0, "applied")
        .when(F.col("regressed"), "regressed")
        .when(F.col("green"), "applied")
        .otherwise("failed")
    )
    return turns.withColumn("outcome", outcome)


def session_status(turns: DataFrame, by: str = "session_id", most_turns: int = 12) -> DataFrame:
    """(session, turns, status) from each session's last turn: green, blocked (nothing to do, or too many turns) or
    awaiting-response. Turns are counted over the whole session."""
    last = turns.groupBy(by).agg(F.max_by("outcome", "turn").alias("last"), F.count("*").alias("turns"))
    status = F.when(F.col("last") == "applied", "green").when((F.col("last") == "no-op") | (F.col("turns") >= most_turns), "blocked").otherwise("awaiting-response")
    return last.select(by, "turns", status.alias("status"))


def loop_metrics(turns: DataFrame, by: str = "session_id") -> DataFrame:
    """(session, turns_to_green, regressions, repairs, files_touched) and a row of totals with a null session."""
    return turns.rollup(by).agg(
        F.min(F.when(F.col("outcome") == "applied", F.col("turn"))).alias("turns_to_green"),
        F.count(F.when(F.col("outcome") == "regressed", 1)).alias("regressions"),
        F.count(F.when(F.col("outcome") == "rejected", 1)).alias("repairs"),
        F.countDistinct(F.when(F.col("outcome") != "failed", F.col("path"))).alias("files_touched"),
    )


def compact_turns(turns: DataFrame, keep: int = 6, by: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """The last ``keep`` turns renumbered from 1, and a ledger line for each older turn that has something to say."""
    newest = Window.partitionBy(by).orderBy(F.col("turn").desc())
    rows = turns.withColumn("__back", F.row_number().over(newest))
    kept = rows.where(F.col("__back") <= keep).withColumn("index", F.row_number().over(Window.partitionBy(by).orderBy("turn"))).drop("__back")
    line = (
        F.when(F.col("outcome") == "regressed", F.concat(F.lit("regressed: "), F.coalesce("detail", F.lit("rolled back"))))
        .when(F.col("outcome") == "failed", F.concat(F.lit("failed"), F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit(" — "), "detail")).otherwise("")))
        .when(F.col("outcome") == "needed-context", F.concat(F.lit("requested "), F.coalesce("needs", F.lit(0)), F.lit(" file(s)")))
        .when(F.col("outcome") == "rejected", "changes rejected, nothing applied")
    )
    old = rows.where(F.col("__back") > keep).withColumn("line", line).where("line is not null")
    ledger = old.select(by, "turn", F.concat(F.lit("history: Turn "), "turn", F.lit(": "), "line").alias("entry"))
    return kept, ledger


def mru_list(opens: DataFrame, most: int = 10, by: str = "user_id") -> DataFrame:
    """The paths that each user opened last, the latest first; empty paths are ignored."""
    last = opens.where("path <> ''").groupBy(by, "path").agg(F.max("ts").alias("ts"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.col("ts").desc(), "path"))).where(F.col("place") <= most)


def quota_audit(requests: DataFrame, tokens: int = 25_000, calls: int = 80, seconds: int = 60, by: str = "client", windows: int = 16) -> DataFrame:
    """Requests (client, id, ts, tokens) with what the sliding window before each holds, and whether it was over:
    tokens beyond the limit (unless the window is empty) or one call too many.

    A client's requests are cut into ranges of ``windows`` windows, and each range also gets those of the window before
    it, so that a client with many requests is the work of many tasks.
    """
    width = seconds * 1_000_000
    rows = requests.select(by, "id", "tokens", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = rows.withColumn("__own", F.floor(F.col("us") / (width * windows)).cast("bigint"))
    late = (F.col("__own") + 1) * (width * windows) - F.col("us") < width
    rows = rows.withColumn("__range", F.explode(F.when(late, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))))
    frame = Window.partitionBy(by, "__range").orderBy("us").rangeBetween(-(width - 1), 0)
    # of requests at the same instant, those with a lesser id came before
    ties = Window.partitionBy(by, "__range", "us").orderBy("id").rowsBetween(0, Window.unboundedFollowing)
    used = F.sum("tokens").over(frame) - F.sum("tokens").over(ties)
    count = F.count("*").over(frame) - F.count("*").over(ties)
    rows = rows.withColumn("used", used).withColumn("calls", count).where(F.col("__range") == F.col("__own"))
    over = ((F.col("calls") > 0) & (F.col("used") + F.col("tokens") > tokens)) | (F.col("calls") + 1 > calls)
    return rows.select(by, "id", "tokens", F.col("used").cast("bigint").alias("used"), F.col("calls").cast("bigint").alias("calls"), over.alias("over"))


def fixed_batches(rows: DataFrame, n: int, by: str, order: str) -> DataFrame:
    """Adds batch: the rows of each key in their order, ``n`` to a batch."""
    return ordered_paths(rows, by, order).withColumn("batch", F.floor((F.col("place") - 1) / n)).drop("place")


def zero_fill_verdicts(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every candidate (query_id, path) with its first verdict by ord, or zeros."""
    first = verdicts.groupBy("query_id", "path").agg(F.min_by(F.struct("score", "confidence"), "ord").alias("v"))
    return candidates.join(first, ["query_id", "path"], "left").select("query_id", "path", F.coalesce("v.score", F.lit(0.0)).alias("score"), F.coalesce("v.confidence", F.lit(0.0)).alias("confidence"))


def fold_in_order(rows: DataFrame, by: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], tuple], out: str) -> DataFrame:
    """``rows`` with the columns of ``out`` (DDL), which ``step(state, row)`` gives for each row of a key in its order;
    ``start()`` makes a key's first state. A key's rows stream through one task in Arrow batches: only the state is
    held, however many rows there are."""
    names = [c.split()[0] for c in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            got = []
            for row in batch.itertuples(index=False):
                own = getattr(row, by)
                if state is None or not (own == key or pd.isna(own) and pd.isna(key)):
                    key, state = own, start()
                got.append(step(state, row))
            yield batch.assign(**{n: [g[k] for g in got] for k, n in enumerate(names)})

    kinds = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes)
    return rows.repartition(by).sortWithinPartitions(by, *order).mapInPandas(run, f"{kinds}, {out}")


def next_batches(tokens: np.ndarray, n: int, most_tokens: int, most_items: int) -> np.ndarray:
    """For each of the first ``n`` items, where the next batch begins if one begins there: behind as many items as fit,
    one at least."""
    total = np.concatenate(([0], np.cumsum(tokens)))
    at = np.arange(n)
    full = np.searchsorted(total, total[at] + most_tokens, "right") - 1
    return np.maximum(np.minimum(full, at + most_items), at + 1)


def pack_batches(items: DataFrame, most_tokens: int = 15_000, most_items: int = 50, by: str = "shard", block: int = 4096) -> DataFrame:
    """(shard, ord, tokens, batch): items in order, a new batch when the next item would not fit or the batch is
    full; one too large stands alone. Tokens are not negative; a null counts nothing.

    A shard's items are numbered by ranges and cut into blocks, each with the first ``most_items`` of the next one. From
    any item the place where the next batch begins follows from running sums, so a block says for each of the places
    where a batch may begin in it first, ``most_items`` of them, how many batches begin in it and where the next
    block's first one does. Only these small rows are followed from block to block; then all blocks number their
    batches at once. So no shard's items pass through one task.
    """
    if block < most_items:
        raise ValueError("a block holds the items of a batch at least")
    rows = items.select(by, F.col("ord").cast("bigint").alias("ord"), F.coalesce(F.col("tokens").cast("bigint"), F.lit(0)).alias("tokens"))
    placed = ordered_paths(rows.withColumn("__o", F.struct("ord", "tokens")), by, "__o").drop("__o")
    placed = checkpointed(placed.withColumn("place", F.col("place") - 1).withColumn("block", F.expr(f"place div {block}")))
    # the first items of a block are also the last that the block before looks at
    ahead = (F.col("place") % block < most_items) & (F.col("block") > 0)
    seen = placed.withColumn("__b", F.explode(F.when(ahead, F.array("block", F.col("block") - 1)).otherwise(F.array("block"))))
    seen = seen.select(by, F.col("__b").alias("block"), "ord", "tokens", "place")
    kind = dict(placed.dtypes)[by]

    def ends(group: pd.DataFrame) -> pd.DataFrame:
        key, number = group[by].iloc[0], int(group["block"].iloc[0])
        group = group.sort_values("place")
        n = int(((group["place"] // block) == number).sum())
        after = next_batches(group["tokens"].to_numpy(), n, most_tokens, most_items)
        # pointers are doubled until they leave the block
        to, count = np.minimum(np.concatenate((after, np.arange(n, n + most_items + 1))), n + most_items), np.concatenate((np.ones(n, np.int64), np.zeros(most_items + 1, np.int64)))
        while (to[:n] < n).any():
            to, count = to[to], count + count[to]
        first = min(n, most_items)
        return pd.DataFrame({by: [key], "block": [number], "to": [(to[:first] - n).tolist()], "count": [count[:first].tolist()]})

    tables = checkpointed(seen.groupBy(by, "block").applyInPandas(ends, f"{by} {kind}, block bigint, to array<bigint>, count array<bigint>"))

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        """Where the first batch of each block begins, and its number; a row of ``most_items`` numbers a block."""
        group, at, number, out = group.sort_values("block"), 0, 0, []
        for key, b, to, count in zip(group[by], group["block"], group["to"], group["count"], strict=True):
            out.append((key, b, at, number))
            if at < len(to):  # else the last batch reaches beyond the block
                at, number = int(to[at]), number + int(count[at])
            else:
                at -= len(to)
        return pd.DataFrame(out, columns=[by, "block", "first", "batch"])

    starts = checkpointed(tables.groupBy(by).applyInPandas(follow, f"{by} {kind}, block bigint, first bigint, batch bigint"))

    def number(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values("place").reset_index(drop=True)
        n = int((own["place"] // block == own["block"]).sum())
        after, at, begins = next_batches(own["tokens"].to_numpy(), n, most_tokens, most_items), int(own["first"].iloc[0]), np.zeros(n, np.int64)
        while at < n:
            begins[at] = 1
            at = int(after[at])
        batch = int(own["batch"].iloc[0]) - 1 + np.cumsum(begins)
        return own.iloc[:n][[by, "ord", "tokens"]].assign(batch=batch)

    both = seen.alias("i").join(starts.alias("s"), F.col(f"i.{by}").eqNullSafe(F.col(f"s.{by}")) & (F.col("i.block") == F.col("s.block"))).select("i.*", "first", "batch")
    return both.groupBy(by, "block").applyInPandas(number, f"{by} {kind}, ord bigint, tokens bigint, batch bigint")


def fit_to_budget(files: DataFrame, budget: int, by: str = "query_id", per_file: float = 0.45, outline: float = 0.15) -> DataFrame:
    """(query_id, path, tokens, fate) of files (query_id, priority, path, tokens, outline_tokens): included while
    they fit, else their outline under its own limit, else omitted; a file that doesn't fit doesn't stop later ones."""
    most, most_outline = max(1, int(budget * per_file)), int(budget * outline)

    def step(s: dict, row: Any) -> tuple:
        if row.tokens <= most and s["used"] + row.tokens <= budget:
            s["used"] += row.tokens
            return ("included",)
        if row.outline_tokens >= 0 and s["outlined"] + row.outline_tokens <= most_outline:
            s["outlined"] += row.outline_tokens
            return ("outline",)
        return ("omitted",)

    none = F.lit(-1)  # stands for no outline
    rows = files.select(by, "priority", F.col("path").cast("string").alias("path"), F.col("tokens").cast("bigint").alias("tokens"), F.coalesce("outline_tokens", none).cast("bigint").alias("outline_tokens"))
    return fold_in_order(rows, by, ["priority", "path", "tokens"], lambda: {"used": 0, "outlined": 0}, step, "fate string").select(by, "path", "tokens", "fate")


def fill_prompt(files: DataFrame, budget: int | None, by: str = "query_id") -> DataFrame:
    """(query_id, ord, tokens, included): files in the given order, skipping what doesn't fit but trying later ones;
    no budget takes all."""
    rows = files.select(by, F.col("ord").cast("bigint").alias("ord"), F.col("tokens").cast("bigint").alias("tokens"))
    if budget is None:
        return rows.withColumn("included", F.lit(True))

    def step(s: dict, row: Any) -> tuple:
        fits = s["used"] + row.tokens <= budget
        s["used"] += row.tokens if fits else 0
        return (bool(fits),)

    return fold_in_order(rows, by, ["ord", "tokens"], lambda: {"used": 0}, step, "included boolean")


def rollback_plan(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, action) from snapshots (path, origin: untracked/index/backup, hash): delete what is untracked now and
    was neither untracked nor in the index, restore what was backed up and is gone, leave alone what was modified.
    A path that needs nothing has no row."""
    untracked = now.where("origin = 'untracked'").select("path")
    delete = untracked.join(before.where("origin in ('untracked', 'index')").select("path"), "path", "left_anti").distinct()
    backup = before.where("origin = 'backup'").select("path", "hash").join(now.groupBy("path").agg(F.first("hash").alias("now")), "path", "left")
    action = F.when(F.col("now").isNull(), "restore").when(F.col("now") != F.col("hash"), "skip_modified")
    return delete.select("path", F.lit("delete").alias("action")).unionByName(backup.select("path", action.alias("action")).where("action is not null"))


def read_sessions(raw: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """(id, project, status, updated_at, turns) of JSON texts (value); large, corrupt or misshapen ones are skipped."""
    shape = "id string, project string, status string, updated_at bigint, turns array<struct<turn:bigint,role:string>>"
    rows = raw.where(F.octet_length("value") <= most_bytes).select(F.from_json("value", shape).alias("s"))
    good = F.col("s.id").rlike("^[A-Za-z0-9_-]{1,80}$") & F.col("s.turns").isNotNull() & F.col("s.status").isNotNull()
    return rows.where(good).select("s.id", "s.project", "s.status", "s.updated_at", F.size("s.turns").cast("bigint").alias("turns"))


def session_summaries(sessions: DataFrame) -> DataFrame:
    """``sessions`` (as read_sessions gives them) with place, the newest of each project first, and active: whether it
    is the newest of its project that is still in play."""
    open_ = F.when(F.col("status").isin("active", "awaiting-response"), F.struct("updated_at", "id"))
    newest = sessions.groupBy("project").agg(F.max(open_)["id"].alias("__open"))
    placed = ordered_paths(sessions.withColumn("__order", F.struct(-F.col("updated_at"), "id")), "project", "__order").drop("__order")
    known = placed.alias("s").join(newest.alias("n"), F.col("s.project").eqNullSafe(F.col("n.project")))
    return known.select("s.*", F.coalesce(F.col("id") == F.col("__open"), F.lit(False)).alias("active"))


def context_candidates(files: DataFrame, requested: DataFrame, applied: DataFrame, recall: DataFrame, by: str = "session_id") -> DataFrame:
    """(session, path, priority, missing) of files (session, path): 0 if requested, 1 if changed last turn, 2 and up by
    recall (path, rank, of); others are left out, and what is requested but not there is missing."""
    key = [by, "path"]
    rows = files.select(*key, F.lit(True).alias("there")).join(requested.select(*key, F.lit(True).alias("asked")), key, "full_outer")
    rows = rows.join(applied.select(*key, F.lit(True).alias("changed")), key, "left").join(recall.select(*key, "rank", "of"), key, "left")
    priority = F.when(F.col("asked"), 0.0).when(F.col("changed"), 1.0).when(F.col("rank").isNotNull(), 2 + F.col("rank") / F.col("of"))
    return rows.select(*key, priority.alias("priority"), F.col("there").isNull().alias("missing")).where("priority is not null")


def changed_paths(turns: DataFrame, by: str = "session_id") -> DataFrame:
    """The distinct paths that a session's turns (session, path, outcome) have applied."""
    return turns.where("outcome = 'applied'").select(by, "path").distinct()


def last_verification(turns: DataFrame, by: str = "session_id") -> DataFrame:
    return turns.where("verification is not null").groupBy(by).agg(F.max("turn").alias("turn"), F.max_by("verification", "turn").alias("verification"))


def estimate(text: Column) -> Column:
    return T.estimate_tokens(text)
