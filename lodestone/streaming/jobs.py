"""Structured Streaming jobs; each also replays a finished table with availableNow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from lodestone.sources.files import checkpointed, scratch_folder


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table, one file or a folder of them, as a stream with the schema that its files have."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # as a pattern, the path may also be a file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern)


def replay(stream: DataFrame, mode: str = "append", name: str = "replay") -> DataFrame:
    """All that is there now through the stream, its output read back from the shared folder. In complete and
    update mode each batch is written apart and the last one counts for complete."""
    spark = stream.sparkSession
    out, state = scratch_folder(spark, name), scratch_folder(spark, f"{name}-state")
    _run(stream, out, state, mode)
    return spark.read.schema(stream.schema).parquet(out)


def _run(stream: DataFrame, out: str, state: str, mode: str, numbered: bool = False) -> None:
    """Runs the stream to the end of what is there. Other modes than append write each batch apart; ``numbered`` adds
    its number as __batch, and a batch that is run again replaces its own rows."""
    writer = stream.writeStream.option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return

    def write(batch: DataFrame, number: int) -> None:
        if numbered:
            rows = batch.withColumn("__batch", F.lit(number))
            rows.write.partitionBy("__batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(out)
        else:
            batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    writer.foreachBatch(write).start().awaitTermination()


def replay_in_steps(parts: list[DataFrame], job: Callable[[DataFrame], DataFrame], mode: str = "append", keys: list[str] | None = None, name: str = "steps") -> DataFrame:
    """What ``job`` makes of a stream into which ``parts`` arrive one after the other: each is written to the source's
    folder and the stream then resumed to its end, so that watermarks and state of earlier parts hold for later ones.

    In append mode the result is all that was given out, each row once it was final. In update mode it is the last row
    that was given out for each value of ``keys``.
    """
    spark, schema = parts[0].sparkSession, parts[0].schema
    source, out, state = (scratch_folder(spark, f"{name}{s}") for s in ("", "-out", "-state"))
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = job(spark.readStream.schema(schema).parquet(source))
        _run(stream, out, state, mode, numbered=mode == "update")
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    rows = spark.read.parquet(out)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "__batch").alias("r"))
    return last.select("r.*")


def stream_quota(requests: DataFrame, tokens: int = 25_000, calls: int = 80, width: str = "60 seconds", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(client, start, used, calls, over) per window of a stream (client, ts, tokens), tumbling or sliding by ``slide``.

    In append mode a window is given out once the newest request is ``late`` past its end, and requests that come for
    it later are dropped; in update mode it is given out at each change. A window's state goes when it is final.
    """
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    per = requests.withWatermark("ts", late).groupBy("client", window.alias("w")).agg(F.sum("tokens").alias("used"), F.count("*").alias("calls"))
    return per.select("client", F.col("w.start").alias("start"), "used", "calls", ((F.col("used") > tokens) | (F.col("calls") > calls)).alias("over"))


def stream_progress(events: DataFrame) -> DataFrame:
    """(job, stage, done, latest) of a stream (job, stage, ts, message); for update mode, where only what has changed is
    given out, or complete mode."""
    return events.groupBy("job", "stage").agg(F.count("*").alias("done"), F.max_by("message", F.struct("ts", "message")).alias("latest"))


def stream_spells(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(job, start, stop, events) of a job's spells of work in a stream (job, ts): events that follow each other within
    ``gap``; stop is the gap's end behind the last one. For append mode: a spell is given out when the newest event is
    ``late`` past its stop, and later events of that time are dropped."""
    per = events.withWatermark("ts", late).groupBy("job", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return per.select("job", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "events")


SESSION = "session_id bigint, turn bigint, turns bigint, status string, accepted boolean, supplied bigint, regressions bigint"


class SessionFold(StatefulProcessor):
    """A session's state: what its last turn left (one value), and the paths that it was given (a map, looked up path
    by path). A timer forgets a session that stays idle."""

    def __init__(self, most_turns: int, idle_ms: int | None):
        self.most_turns, self.idle_ms = most_turns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "last bigint, turns bigint, status string, supplied bigint, regressions bigint")
        self.given = handle.getMapState("given", "path string", "turn bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last, count, status, supplied, regressions = self.session.get() if self.session.exists() else (None, 0, "awaiting-response", 0, 0)
        turns = pd.concat(list(rows)).sort_values(["turn", "outcome"])
        out = []
        for turn, outcome, needs in zip(turns["turn"].tolist(), turns["outcome"].tolist(), turns["needs"].tolist(), strict=True):
            accepted = last is None or turn > last
            if accepted:
                last, count = turn, count + 1
                status = "green" if outcome == "applied" else "blocked" if outcome == "no-op" or count >= self.most_turns else "awaiting-response"
                for path in dict.fromkeys(needs if needs is not None else []):
                    if not self.given.containsKey((path,)):
                        self.given.updateValue((path,), (turn,))
                        supplied += 1
                regressions += int(outcome == "regressed")
            out.append((key[0], turn, count, status, accepted, supplied, regressions))
        self.session.update((last, count, status, supplied, regressions))
        if self.idle_ms:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            newest = int(turns["ts"].max().timestamp() * 1000)
            self.handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SESSION.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, count, _, supplied, regressions = self.session.get()
        self.session.clear()
        self.given.clear()
        yield pd.DataFrame([(key[0], last, count, "expired", False, supplied, regressions)], columns=[c.split()[0] for c in SESSION.split(", ")])

    def close(self) -> None:
        pass


def stream_sessions(turns: DataFrame, most_turns: int = 12, idle: str | None = None, late: str = "0 seconds") -> DataFrame:
    """(session_id, turn, turns, status, accepted, supplied, regressions): a session's state after each of its turns
    (session_id, turn, outcome, needs: paths asked for). A turn not newer than the last one is rejected and changes
    nothing; turns are counted over the whole session, as are the different paths supplied and the regressions.

    With ``idle`` (an interval such as 2 hours), turns have a time ``ts``, and a session without a turn for so long is
    forgotten, which a row with status expired says; the clock is that of the turns, less ``late``. State is kept in
    RocksDB, which this sets for the Spark session.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    columns = ["session_id", "turn", "outcome", "needs"]
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    rows = turns.withWatermark("ts", late).select(*columns, "ts") if idle else turns.select(*columns)
    return rows.groupBy("session_id").transformWithStateInPandas(SessionFold(most_turns, idle_ms), SESSION, "Append", "EventTime" if idle else "None")


#: Hexadecimal digits of a text's digest that name its folder in a stream's index: 256 folders.
PREFIX = 2


def stream_index(documents: DataFrame, chunk: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], folder: str) -> None:
    """Documents from a stream to an index in ``folder``: every chunk (chunk_id, text) gets a row with its vector, but
    only texts that neither the index nor an earlier chunk has are embedded. A chunk that is there already adds
    nothing, nor does a batch that is run again; a chunk whose text has changed gets a new row, the one that
    read_stream_index shows. The index lies in folders by the first digits of a text's digest, and a batch reads those
    of its own texts only."""
    spark = documents.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        chunks = chunk(batch).withColumn("key", F.sha2("text", 256)).withColumn("prefix", F.concat(F.lit("k"), F.left("key", F.lit(PREFIX))))
        chunks = checkpointed(chunks.dropDuplicates(["chunk_id", "key"]))
        prefixes = [r["prefix"] for r in chunks.select("prefix").distinct().collect()]  # few by their length
        known = known_rows(spark, folder, prefixes, number)
        if known is not None:
            chunks = chunks.join(known.select("chunk_id", "key"), ["chunk_id", "key"], "left_anti")
            vectors = chunks.select("key").distinct().join(known.select("key", "embedding"), "key").groupBy("key").agg(F.first("embedding").alias("embedding"))
            fresh = chunks.join(known.select("key").distinct(), "key", "left_anti")
        else:
            vectors, fresh = None, chunks
        one = fresh.groupBy("key").agg(F.min_by(F.struct("chunk_id", "text"), "chunk_id").alias("c")).select("key", "c.*")
        made = one.select("key", "chunk_id").join(embed(one.select("chunk_id", "text")), "chunk_id").select("key", "embedding")
        every = made if vectors is None else made.unionByName(vectors)
        rows = chunks.join(every, "key").withColumn("batch", F.lit(number))
        # a folder's rows come together, or each task would write a file to each of them; large folders are split
        rows.hint("rebalance", "prefix").write.partitionBy("prefix", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/index")

    documents.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def known_rows(spark: SparkSession, folder: str, prefixes: list[str], number: int) -> DataFrame | None:
    """Rows of a stream's index that other batches than ``number`` wrote, out of the folders of these prefixes alone;
    None without an index."""
    try:
        rows = spark.read.parquet(f"{folder}/index")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.where(F.col("prefix").isin(prefixes) & (F.col("batch") != number))


def read_stream_index(spark: SparkSession, folder: str) -> DataFrame:
    """The latest row of each chunk that stream_index has written."""
    rows = spark.read.parquet(f"{folder}/index")
    return rows.groupBy("chunk_id").agg(F.max_by(F.struct("text", "key", "embedding"), "batch").alias("r")).select("chunk_id", "r.*")
