"""The stored index: exhaustive and pruned results, reuse, rebuilding, versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import search
from lodestone.operators import search_index as I
from lodestone.sources import store


@pytest.fixture(scope="module")
def made(spark):
    """Documents of common and rare words; some texts are alike."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["running", "runs", "runner", "tested", "testing"]
    rows = []
    for i in range(3000):
        body = sorted({rng.choice(words[: rng.choice([5, 60, 305])]) for _ in range(rng.randrange(40))})
        rows.append((f"d/{i:05}", body, [f"d{i % 7}"], body[:1]))
    rows += [("e/none", None, None, None), ("e/a", ["running", "w1"], [], []), ("e/b", ["running", "w1"], [], [])]
    docs = spark.createDataFrame(rows, "path string, body array<string>, path_tokens array<string>, symbols array<string>").repartition(3)
    asked = [(q, rng.sample(words, rng.choice([1, 2, 8, 30]))) for q in range(60)] + [(98, ["nowhere"]), (99, None), (100, ["test", "run", "run", None])]
    return docs, spark.createDataFrame(asked, "query_id long, terms array<string>")


def test_index_scores_equal_those_of_one_pass(spark, made, tmp_path):
    docs, asked = made
    index = I.build_index(docs, f"file://{tmp_path}/i", shard_docs=700)
    plain = docs.select("path", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("body", "path_tokens", "symbols")])
    once = asked.withColumn("terms", F.array_distinct(F.filter("terms", lambda t: t.isNotNull())))
    for stems in (True, False):
        got = {(r.query_id, r.path): r.score for r in I.index_scores(index, asked, stems, block=16).collect()}
        want = {(r.query_id, r.path): r.score for r in search.bm25_scores(plain, once, stems).collect()}
        assert got.keys() == want.keys() and len(got) > 10_000
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    top = I.index_topk(index, asked, 20, block=16).select("query_id", "path", "rank")
    want = search.topk(search.bm25_scores(plain, once).withColumn("near", F.round("score", 9)), 20, score="near").select("query_id", "path", "rank")
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, want.collect()))


def test_blocks_that_cant_matter_are_not_scored():
    rng = np.random.default_rng(5)
    n = 4 * I.BLOCK
    rows = []
    for term in range(6):
        local = np.flatnonzero(rng.random(n) < 0.4)
        weight = np.where(local < I.BLOCK, 6.0, 1.0)  # the first block has the heavy ones
        length = np.full(len(local), 50)
        cut = np.flatnonzero(np.append(True, local[1:] // I.BLOCK != local[:-1] // I.BLOCK))
        rows.append((term, True, local, weight, length, local[cut] // I.BLOCK, np.maximum.reduceat(weight, cut), np.minimum.reduceat(length, cut)))
    use, idf = np.ones((3, 6)), np.full(6, 2.0)
    q, d, s, scored = I.best_in_shard(use, idf, rows, 50.0, 10, True)
    every = I.best_in_shard(use, idf, rows, 50.0, None, True)
    assert every[3] == 3 * 4 and scored == 3
    for k in range(3):
        own = every[0] == k
        order = np.lexsort((every[1][own], -np.round(every[2][own], 9)))[:10]
        assert d[q == k].tolist() == every[1][own][order].tolist()


def test_a_stored_index_is_reused_and_rebuilt(spark, made, tmp_path):
    docs, asked = made
    folder, calls = f"file://{tmp_path}/r", []

    def make():
        calls.append(1)
        return docs

    one = I.open_index(spark, folder, "s1", make)
    two = I.open_index(spark, folder, "s1", make)
    assert len(calls) == 1 and one == two
    plan = I.index_topk(two, asked, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "path_tokens" not in plan and "symbols" not in plan
    three = I.open_index(spark, folder, "s1", make, rebuild=True)
    assert len(calls) == 2 and three.path != one.path and I.open_index(spark, folder, "s1", make).path == three.path
    I.open_index(spark, folder, "s2", make)
    assert len(calls) == 3 and store.latest(spark, folder)["number"] == 2
    assert I.open_index(spark, folder, "s1", make).path == three.path


def test_a_failed_build_leaves_the_last_version(spark, made, tmp_path):
    docs, asked = made
    folder = f"file://{tmp_path}/f"
    index = I.build_index(docs.limit(50), folder, "s")
    with pytest.raises(Exception, match="(?i)broken"):
        I.build_index(docs.withColumn("path", F.when(F.col("path") > "d/01", F.raise_error(F.lit("broken"))).otherwise(F.col("path"))), folder, "s")
    assert store.latest(spark, folder)["path"] == index.path
    assert I.index_topk(index, asked, 3).count() > 0


def test_an_empty_index(spark, made, tmp_path):
    docs, asked = made
    index = I.build_index(docs.limit(0), f"file://{tmp_path}/e")
    assert index.n == 0 and I.index_topk(index, asked, 3).count() == I.index_scores(index, asked).count() == 0
