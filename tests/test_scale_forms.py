"""Forms for tables of any size against the plain fold: packing by blocks, rolling windows by ranges, buckets, sketches."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import hooks
from lodestone.functions import text as T
from lodestone.operators import corpus, extract, search, sessions, vectors
from lodestone.sources import files, store


def fold(items, most_tokens=15_000, most_items=50):
    out, batch, used, n = [], 0, 0, 0
    for t in items:
        if n and (used + t > most_tokens or n >= most_items):
            batch, used, n = batch + 1, 0, 0
        used, n = used + t, n + 1
        out.append(batch)
    return out


def test_batches_by_blocks_equal_the_fold(spark):
    rng = random.Random(2)
    shards = {
        "small": [rng.randrange(3000) for _ in range(40)],
        "large": [rng.choice([0, 1, 10, 700, 16_000]) for _ in range(700)],
        "tiny": [5] * 333,
        "one": [99_999],
        None: [rng.randrange(900) for _ in range(150)],
        "zeros": [0] * 129,
    }
    rows = [(s, i, t) for s, items in shards.items() for i, t in enumerate(items)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "shard string, ord long, tokens long").repartition(5)
    for block in (50, 64, 4096):
        got = collections.defaultdict(dict)
        for r in sessions.pack_batches(df, block=block).collect():
            got[r.shard][r.ord] = r.batch
        assert {s: [v[k] for k in sorted(v)] for s, v in got.items()} == {s: fold(items) for s, items in shards.items()}
    assert sessions.pack_batches(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sessions.pack_batches(df, block=10)


def test_one_shard_is_packed_by_many_tasks(spark):
    df = spark.range(5000).select(F.lit("s").alias("shard"), F.col("id").alias("ord"), (F.col("id") % 900).alias("tokens"))
    got = sessions.pack_batches(df, block=100)
    assert got.groupBy("batch").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).where("t > 15000 or n > 50").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas [shard" in plan and "block" in plan.split("FlatMapGroupsInPandas [")[1].split("]")[0]


def test_a_hot_client_is_audited_by_ranges(spark):
    rng = random.Random(3)
    rows = [("hot", i, rng.randrange(3_000), rng.randrange(1000)) for i in range(1500)] + [("cold", 0, 5, 7), (None, 1, 6, 8)]
    df = spark.createDataFrame(rows, "client string, id long, s long, tokens long").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.client, r.id): (r.used, r.calls, r.over) for r in sessions.quota_audit(df, windows=2).collect()}
    for client, i, s, t in rows:
        before = [(x, n) for c, x, at, n in rows if c == client and (s - 60 < at < s or at == s and x < i)]
        used, calls = sum(n for _, n in before), len(before)
        assert got[client, i] == (used, calls, bool(calls and used + t > 25_000 or calls + 1 > 80))
    assert len(got) == len(rows)


def test_index_is_read_without_a_shuffle(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    assert files.read_index(spark, folder) is None
    chunks = spark.range(300).select(F.col("id").alias("chunk_id"), F.concat(F.lit("d"), F.col("id") % 7).alias("document"))
    vecs = spark.range(1, 301).select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    files.write_index(chunks, vecs, folder, "m1", buckets=5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = files.read_index(spark, folder)
        plan = index._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        got = index.groupBy("sound").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.sound, r["count"]) for r in got} == {(True, 299), (False, 2)}
    with pytest.raises(Exception, match="(?i)broken"):
        files.write_index(chunks.withColumn("document", F.raise_error(F.lit("broken")).cast("string")), vecs, folder, "m2")
    assert store.latest(spark, folder)["facts"]["model"] == "m1" and files.read_index(spark, folder).count() == 301
    files.write_index(chunks.limit(10), vecs.limit(10), folder, "m3", buckets=2)
    assert {r.model for r in files.read_index(spark, folder).collect()} == {"m3"} and store.latest(spark, folder)["number"] == 1


def test_counters_and_batch_limits(spark):
    text = "# A\n" + " ".join(f"Sentence {i} is here." for i in range(200))
    parts = corpus.sections(corpus.doc_lines(spark.createDataFrame([(1, text)], "doc_id int, text string")))
    few, many = (corpus.chunk_sections(parts, counter=c).count() for c in (T.estimate_tokens, lambda c: F.size(F.split(c, " ")).cast("bigint")))
    assert few > many >= 2
    seen = spark.sparkContext.accumulator(0)

    def embedder(texts):
        assert len(texts) <= 7 and (sum(map(len, texts)) <= 300 or len(texts) == 1)
        seen.add(1)
        return [hooks.np.zeros(2) for _ in texts]

    chunks = spark.range(200).select(F.col("id").alias("chunk_id"), F.when(F.col("id") % 9 > 0, F.repeat(F.lit("x"), (F.col("id") * 37 % 350).cast("int"))).alias("text"))
    got = hooks.embed_chunks(chunks, embedder, 300, 7, F.length)
    assert got.count() == 200 and got.select("chunk_id").distinct().count() == 200
    with pytest.raises(Exception, match="gave 0 vectors"):
        hooks.embed_chunks(chunks, lambda texts: []).count()


def test_extractors_take_bytes_of_files(spark):
    rows = [(1, b"<p>one</p><script>x</script> two"), (2, b"a\x00b"), (3, None), (4, "é".encode())]
    df = spark.createDataFrame(rows, "path int, content binary")
    got = {r.path: (r.ok, r.markdown, r.reason) for r in hooks.extract_texts(df, "path", content="content").collect()}
    assert got == {1: (True, "one two", None), 2: (False, None, "no text"), 3: (False, None, "no text"), 4: (True, "é", None)}
    kinds = {r.markdown for r in hooks.extract_texts(df.where("path <> 3"), "path", lambda xs: [type(x).__name__ for x in xs], content="content").collect()}
    assert kinds <= {"bytes", "bytearray"}


def test_sketches_of_parts_make_that_of_the_whole(spark):
    rows = spark.range(60_000).select((F.col("id") % 5).alias("day"), F.expr("id * 7 % 20011").alias("x"))
    stored = vectors.distinct_sketches(rows.where("day < 3"), "x", ["day"]).unionByName(vectors.distinct_sketches(rows.where("day >= 3"), "x", ["day"]))
    got = vectors.merged_sketches(stored).first()
    assert got.n == 60_000 and abs(got.about - 20_011) < 0.02 * 20_011


def test_directories_are_cut_before_the_shuffle(spark):
    rows = spark.range(3000).select(F.lit(0).alias("query_id"), F.concat(F.lit("one/"), "id").alias("path"), F.col("id").cast("double").alias("score"))
    got = search.diversify(rows, F.regexp_replace("path", "/[^/]*$", ""), limit=5)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString() and got.count() == 5


def test_salvaged_json(spark):
    cases = [
        ('{"files":[{"path":"src/[a,].ts"}]}', '{"files":[{"path":"src/[a,].ts"}]}'),
        ('Sure: {"a":[1,2,],} done', '{"a":[1,2]}'),
        ("```JSON {\"a\": \"x,}\"}\n```", '{"a": "x,}"}'),
        ('{"a":1} and {"b":2}', None),
        ("```json\nnone\n``` {\"a\":1}", None),
        ("{a: 1}", None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string")
    got = [r.y for r in df.select("i", T.salvage_json(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [c[1] for c in cases]


def test_language_lines_of_plain_sections(spark):
    bodies = {
        "python\n\nprint(1)": "print(1)\n",
        "\n\n(my language)\nx = 1\n\n": "x = 1\n",
        "return 1\nmore": "return 1\nmore\n",
        "(half\nx": "(half\nx\n",
        "TypeScript\r\nlet a\r\n": "let a\n",
        "python\n\n": None,
        "  indented\nx  ": "  indented\nx  \n",
    }
    rows = [(i, 1, f"p{i}.py", b) for i, b in enumerate(bodies)]
    got = {r.response_id: r.content for r in extract.plain_blocks(spark.createDataFrame(rows, "response_id int, section_no int, path string, body string")).collect()}
    assert got == {i: c for i, c in enumerate(bodies.values()) if c is not None}


def test_commit_ids_keep_their_length(spark):
    log = spark.createDataFrame([("p", 0, "__C__" + "f" * 300), ("p", 1, "a.py")], "project string, line_no int, line string")
    assert [len(r.commit) for r in files.read_commit_log(log).collect()] == [300]


def test_vectors_of_other_models_are_not_reused(spark):
    chunk = "document string, heading_path string, text string"
    chunks = spark.createDataFrame([("a", "b\u001fc", "t"), ("a", "b", "c\u001ft"), ("a", None, "t"), ("a", "", "t")], chunk)
    old = spark.createDataFrame([("a", "b\u001fc", "t", "m", [1.0]), ("a", "b", "c\u001ft", "other", [2.0]), ("a", None, "t", "m", [3.0])], chunk + ", model string, embedding array<double>")
    got = [(r.heading_path, r.vector) for r in vectors.reuse_vectors(chunks, old, "m").collect()]
    assert sorted(got, key=str) == sorted([("b\u001fc", [1.0]), ("b", None), (None, [3.0]), ("", None)], key=str)


def test_signatures_ask_for_rebuilding(spark):
    rows = lambda *r: corpus.corpus_signature(spark.createDataFrame(list(r), "project string, path string, head string"), head="head")
    old = rows(("p", "a", "1"), ("p", "b", "1"), ("q", "a", "1"), ("r", "a", "1"))
    new = rows(("p", "b", "1"), ("p", "a", "1"), ("q", "a", "2"), ("r", "c", "1"), ("s", "a", "1"))
    assert {r.project: r.rebuild for r in corpus.rebuild_flags(new, old).collect()} == {"p": False, "q": True, "r": True, "s": True}
