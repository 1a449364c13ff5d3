"""Streams whose rows come in several steps: late rows, idle sessions, what a second batch reads."""

import datetime

from pyspark.sql import functions as F

from lodestone.functions import hooks
from lodestone.plans import queries as _registered  # noqa: F401
from lodestone.plans.session_queries import _turns
from lodestone.streaming import jobs

SF = "/root/testdata/sf0.001"


def at(minute):
    return datetime.datetime(2024, 1, 1, 12) + datetime.timedelta(minutes=minute)


def requests(spark, *rows):
    return spark.createDataFrame([("a", at(m), n) for m, n in rows], "client string, ts timestamp, tokens long")


def test_late_requests_are_dropped(spark):
    parts = [requests(spark, (0.5, 10), (1.5, 20), (130, 5)), requests(spark, (0.6, 1000), (129.5, 7), (300, 1))]
    job = lambda s: jobs.stream_quota(s, late="1 minute")
    got = {(r.start, r.used, r.calls) for r in jobs.replay_in_steps(parts, job).collect()}
    # the late one of a closed window is absent, the one within a minute is there, the last window isn't final
    assert got == {(at(0), 10, 1), (at(1), 20, 1), (at(129), 7, 1), (at(130), 5, 1)}
    update = {(r.start, r.used) for r in jobs.replay_in_steps(parts, job, "update", ["client", "start"]).collect()}
    assert update == {(at(0), 10), (at(1), 20), (at(129), 7), (at(130), 5), (at(300), 1)}


def test_sliding_windows_count_a_request_in_each(spark):
    got = jobs.replay_in_steps([requests(spark, (0.5, 10))], lambda s: jobs.stream_quota(s, tokens=9, slide="10 seconds"), "update", ["client", "start"]).collect()
    assert len(got) == 6 and all(r.over and r.used == 10 for r in got)


def test_progress_gives_out_what_changed(spark):
    rows = lambda *r: spark.createDataFrame([(1, s, at(m), t) for s, m, t in r], "job int, stage string, ts timestamp, message string")
    parts = [rows(("read", 0, "one"), ("embed", 1, "two")), rows(("read", 2, "three"))]
    got = {(r.stage, r.done, r.latest) for r in jobs.replay_in_steps(parts, jobs.stream_progress, "update", ["job", "stage"]).collect()}
    assert got == {("read", 2, "three"), ("embed", 1, "two")}


def test_spells_end_at_idle_gaps(spark):
    rows = lambda *m: spark.createDataFrame([(1, at(x)) for x in m], "job int, ts timestamp")
    got = jobs.replay_in_steps([rows(0, 20, 45, 200), rows(10, 210, 500)], lambda s: jobs.stream_spells(s, "30 minutes", "5 minutes"))
    assert {(r.start, r.stop, r.events) for r in got.collect()} == {(at(0), at(75), 3), (at(200), at(240), 2)}


def turns(spark, *rows):
    made = [(s, t, o, n, at(m)) for s, t, o, n, m in rows]
    return spark.createDataFrame(made, "session_id long, turn long, outcome string, needs array<string>, ts timestamp")


def test_idle_sessions_are_forgotten(spark):
    parts = [
        turns(spark, (1, 1, "needed-context", ["a", "b"], 0), (2, 1, "failed", [], 100)),
        turns(spark, (1, 2, "needed-context", ["b", "c"], 130), (2, 2, "regressed", [], 110)),
        turns(spark, (2, 2, "failed", None, 135), (1, 3, "applied", ["c"], 140)),
    ]
    got = jobs.replay_in_steps(parts, lambda s: jobs.stream_sessions(s, idle="1 hour")).collect()
    one = sorted((r.turn, r.turns, r.status, r.accepted, r.supplied) for r in got if r.session_id == 1)
    # after an idle hour the first session starts anew: its paths and turns count from nothing
    assert one == [(1, 1, "awaiting-response", True, 2), (1, 1, "expired", False, 2), (2, 1, "awaiting-response", True, 2), (3, 2, "green", True, 2)]
    two = sorted((r.turn, r.turns, r.status, r.accepted, r.regressions) for r in got if r.session_id == 2)
    assert two == [(1, 1, "awaiting-response", True, 0), (2, 2, "awaiting-response", False, 1), (2, 2, "awaiting-response", True, 1)]


def test_state_lasts_over_steps_and_equals_the_batch_fold(spark):
    rows = _turns(spark, SF)
    needs = F.when(F.col("needs") > 0, F.array(F.lit("src/x"))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("session_id", "turn", "outcome", needs.alias("needs"))
    parts = [rows.where("turn < 3"), rows.where("turn >= 3")]
    got = jobs.replay_in_steps(parts, jobs.stream_sessions).select("session_id", "turn", "status")
    want = jobs.replay_in_steps([rows], jobs.stream_sessions).select("session_id", "turn", "status")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == rows.count()


def test_second_batch_reads_its_own_prefixes(spark, tmp_path):
    folder, asked = f"file://{tmp_path}/index", []
    docs = lambda *rows: spark.createDataFrame(list(rows), "chunk_id int, text string")

    def embed(chunks):
        asked.append(chunks.count())
        return hooks.embed_chunks(chunks)

    source = f"file://{tmp_path}/in"
    run = lambda: jobs.stream_index(spark.readStream.schema("chunk_id int, text string").parquet(source), lambda b: b, embed, folder)
    docs(*[(i, f"text {i}") for i in range(40)]).write.mode("append").parquet(source)
    run()
    docs((3, "text 3"), (50, "text 7"), (4, "changed")).write.mode("append").parquet(source)
    run()
    assert asked == [40, 1]
    got = {r.chunk_id: r.text for r in jobs.read_stream_index(spark, folder).collect()}
    assert len(got) == 41 and got[4] == "changed" and got[50] == "text 7"
    prefixes = [r[0] for r in docs((3, "text 3"), (50, "text 7")).select(F.concat(F.lit("k"), F.left(F.sha2("text", 256), F.lit(jobs.PREFIX)))).collect()]
    known = jobs.known_rows(spark, folder, prefixes, 99)
    assert "prefix" in known._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1].split("PushedFilters")[0]
    read = {r[0] for r in known.select(F.input_file_name()).distinct().collect()}
    assert read and all(any(f"prefix={p}/" in f for p in prefixes) for f in read)
