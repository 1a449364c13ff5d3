"""Findings of the third round, each on a small input."""

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import TABLES, duck, rows_of, rows_of_sql
from lodestone.functions import text
from lodestone.operators import extract, search, search_index, vectors
from lodestone.plans import queries as _registered  # noqa: F401
from lodestone.plans import registry
from lodestone.sources import files
from lodestone.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture
def odd_tables(tmp_path):
    """The smallest tables, with a document without words and one without a text."""
    for t in TABLES:
        if t != "documents":
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    odd = "(VALUES (1, 'getHTTPUrl of WebChat, a 3DKey'), (2, ''), (3, NULL), (4, '... ?! é'), (5, 'a b c')) t(doc_id, text)"
    duckdb.execute(f"COPY (SELECT doc_id::BIGINT AS doc_id, text, 'en' AS lang, 's' AS source, length(text)::BIGINT AS n_chars FROM {odd}) TO '{tmp_path}/documents.parquet'")
    return str(tmp_path)


def test_words_of_texts_without_words(spark, odd_tables):
    columns, rows = rows_of(registry.queries()["fn01_tokenize"](spark, odd_tables))
    assert (columns, rows) == rows_of_sql(duck(odd_tables), registry.oracle_sql()["fn01_tokenize"])
    assert columns == ["doc_id", "n", "tokens"]
    assert {r[0]: r[1:] for r in rows if r[0] != "1"} == {"2": ("0", ""), "3": ("None", "None"), "4": ("0", ""), "5": ("0", "")}


def test_only_the_last_commits_of_a_log_are_ranged(spark, monkeypatch):
    """What is sorted into ranges doesn't grow with the log, where only so many commits are wanted."""
    rows = [(p, 3 * n + k, line) for p, last in (("a", 300), ("b", 2)) for n in range(last) for k, line in enumerate((f"__C__{p}{n}", f"src\\{n}", " "))]
    log = spark.createDataFrame([("a", -1, "before"), ("c", 5, "none"), *rows], "project string, line_no long, line string")
    held, keep = [], files.checkpointed
    monkeypatch.setattr(files, "checkpointed", lambda df: held.append(keep(df)) or held[-1])
    got = sorted(tuple(r) for r in files.read_commit_log(log, most=3).collect())
    assert got == [("a", k, f"a{299 - k}", 3 * (299 - k) + 1, f"src/{299 - k}") for k in range(3)] + [("b", k, f"b{1 - k}", 3 * (1 - k) + 1, f"src/{1 - k}") for k in range(2)]
    assert max(df.count() for df in held) == 15
    whole = files.read_commit_log(log, most=None)
    assert got == sorted(tuple(r) for r in whole.where("seq < 3").collect()) and whole.count() == 302


def test_patterns_of_failures_stand_once_in_the_plan(spark):
    log = "\u001b[31msrc/a.ts(12,5): error TS2322: no\u001b[0m\r\nsrc/b.ts:3:9  error  bad  rule\nFAILED t.py::test_a - why\n\t FAIL src/a.test.ts > suite > case \nan error\nsrc/a.ts(12,5): error TS2322: no"
    hits = extract.parse_failures(spark.createDataFrame([(1, log)], "log_id int, text string"))
    got = [tuple(r)[1:] for r in hits.orderBy("line_no").collect()]
    assert got == [(0, "src/a.ts", 12, None, "TS2322: no"), (1, "src/b.ts", 3, None, "bad  rule (error)"), (2, "t.py", None, "test_a", "why"), (3, "src/a.test.ts", None, "suite > case", "src/a.test.ts > suite > case")]
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 7  # each once; they were put in place of each use before


def test_totals_of_queries_are_those_of_their_scores(spark, tmp_path):
    """Sums made inside shards, with the words sent to all tasks and not, against the rows they stand for."""
    docs = search.bm25_docs(spark.createDataFrame([(f"d{n}", f"the words of {'apples' if n % 3 else 'apple'} number{n % 5}") for n in range(40)], "path string, content string"))
    index = search_index.build_index(docs, str(tmp_path), shard_docs=7, buckets=3)
    queries = spark.createDataFrame([(1, ["apple", "number3"]), (2, ["apples", "words"]), (3, ["nothing"]), (4, ["word"])], "query_id int, terms array<string>")
    for stems in (True, False):
        rows = search_index.index_scores(index, queries, stems).groupBy("query_id").agg(F.count("*"), F.round(F.sum("score"), 9))
        want = sorted(map(tuple, rows.collect()))
        got = search_index.index_totals(index, queries, stems).select("query_id", "hits", F.round("total", 9))
        assert sorted(map(tuple, got.collect())) == want and [r[0] for r in want] == ([1, 2, 4] if stems else [1, 2])
        unsent = search_index._found(index, queries, None, stems, 2, total=True, most_sent=0).groupBy("query_id").agg(F.sum("hits"), F.round(F.sum("total"), 9))
        assert sorted(map(tuple, unsent.collect())) == want
    assert "Exchange hashpartitioning(bucket" not in search_index.index_totals(index, queries)._jdf.queryExecution().executedPlan().toString()


def test_words_are_not_cut_at_a_negated_class(spark):
    """Such a class of several ranges took most of the time of tokenising."""
    words = spark.createDataFrame([("a1, B2 getHTTPUrl \u212aelvin _x_ " + "z" * 41 + " " + "y" * 40,)], "text string").select(text.tokenize(F.col("text")).alias("t"))
    assert words.first().t == ["a1", "b2", "gethttpurl", "elvin", "y" * 40, "get", "http", "url", "kelvin"]
    assert "[^a-z" not in words._jdf.queryExecution().optimizedPlan().toString()


def test_queries_do_not_travel_with_each_block_of_chunks(spark):
    """A worker gets the queries once; a batch of blocks holds no copies of them. By block, the scores are the same."""
    rows = [(n, n % 3, [float(n % 7), 1.0, float(n % 5)]) for n in range(50)]
    chunks = spark.createDataFrame(rows, "chunk_id int, document int, embedding array<double>")
    asked = chunks.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    sent = vectors.cosine_scores(chunks, asked, block=4)
    assert "NestedLoopJoin" not in sent._jdf.queryExecution().executedPlan().toString()
    parted = vectors.cosine_scores(chunks, asked, block=4, most_sent=0)
    got = sorted((r.query_id, r.chunk_id, r.document, round(r.score, 9)) for r in sent.collect())
    assert len(got) == 250 and got == sorted((r.query_id, r.chunk_id, r.document, round(r.score, 9)) for r in parted.collect())


def test_a_batch_of_the_stream_writes_few_files_to_a_folder(spark, tmp_path):
    """Every task wrote a file to each folder of the index."""
    texts = spark.range(3000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("word"), "id").alias("text"))
    texts.repartition(8).write.parquet(f"{tmp_path}/in")
    embed = lambda c: c.select("chunk_id", F.array(F.lit(1.0)).alias("embedding"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many tasks as a large table has
    try:
        jobs.stream_index(jobs.read_stream(spark, f"{tmp_path}/in"), lambda b: b, embed, f"{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    folders = [p for p in (tmp_path / "out/index").glob("*/*") if p.is_dir()]
    assert len(folders) > 100 and sum(len(list(p.glob("*.parquet"))) for p in folders) <= 1.1 * len(folders)
    assert jobs.read_stream_index(spark, f"{tmp_path}/out").count() == 3000
