"""Registered queries of vector search, fusion and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import corpus as C
from lodestone.operators import search as S
from lodestone.operators import vectors as V
from lodestone.plans.registry import register
from lodestone.plans.search_queries import EXPANDED_TOP, bm25_top, expanded
from lodestone.plans.tables import files, table


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document"), "embedding")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector as a query."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


UNIT = "list_transform(embedding, lambda x: x::DOUBLE)"
COSINE = f"""vecs AS (SELECT vec_id, label, {UNIT} AS v FROM embeddings),
units AS (SELECT vec_id, label, list_transform(v, lambda x: CASE WHEN n = 0 THEN x ELSE x / n END) AS v FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM vecs)),
cosine AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label AS document, list_dot_product(c.v, q.v) AS score FROM units c, units q WHERE q.vec_id % 50 = 0)"""


@register("fn12_l2_normalize", f"WITH {COSINE} SELECT vec_id, round(list_sum(v), 6) AS total, round(list_dot_product(v, v), 6) AS norm FROM units")
def fn12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.unit_vectors(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(V.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"))


@register("jon10_cosine_scores", f"WITH {COSINE} SELECT query_id, chunk_id, document, round(score, 6) AS score FROM cosine WHERE score >= 0.25")
def jon10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.cosine_scores(_chunks(spark, sf_dir), _asked(spark, sf_dir), least=0.25).withColumn("score", F.round("score", 6))


@register("prj10_doc_filter", f"WITH {COSINE} SELECT query_id, chunk_id, document, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cosine WHERE document % 2 = 0) WHERE rank <= 10")
def prj10(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = V.nearest(_chunks(spark, sf_dir), _asked(spark, sf_dir), 10, F.col("document") % 2 == 0)
    return top.withColumn("score", F.round("score", 6))


@register("top02_vector_topk", f"WITH {COSINE} SELECT query_id, chunk_id, document, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cosine) WHERE rank <= 30")
def top02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.nearest(_chunks(spark, sf_dir), _asked(spark, sf_dir), 30).withColumn("score", F.round("score", 6))


def _picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in reranker: for even queries the places 3, 1, 3, 99 and 7, else none."""
    even = F.col("query_id") % 100 == 0
    return _asked(spark, sf_dir).select("query_id", F.when(even, F.array(*map(F.lit, (3, 1, 3, 99, 7)))).otherwise(F.array().cast("array<int>")).alias("picks"))


SHORT = f"{COSINE}, short AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cosine QUALIFY rank <= 30)"
PICKED = f"""{SHORT}, picked AS (
  SELECT s.query_id, chunk_id, document, score, CASE WHEN s.query_id % 100 = 0 THEN o ELSE rank END AS o, s.query_id % 100 = 0 AS reranked
  FROM short s LEFT JOIN (VALUES (3, 0), (1, 1), (7, 2)) p(r, o) ON p.r = s.rank WHERE s.query_id % 100 <> 0 OR p.r IS NOT NULL)"""


@register("jon12_apply_picks", f"WITH {PICKED} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY o)::INTEGER AS place, reranked FROM picked QUALIFY place <= 8")
def jon12(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = V.nearest(_chunks(spark, sf_dir), _asked(spark, sf_dir), 30)
    return V.apply_picks(short, _picks(spark, sf_dir), 8).select("query_id", "chunk_id", "place", "reranked")


@register("top03_retrieve", f"""WITH {PICKED}, kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS place FROM picked QUALIFY place <= 8)
SELECT query_id, count(*)::BIGINT AS hits, (SELECT count(*) FROM short s WHERE s.query_id = p.query_id)::BIGINT AS candidate_count, bool_or(reranked) AS reranked, round(sum(score), 6) AS total,
  CASE WHEN bool_or(reranked) THEN '' ELSE 'no usable pick; the shortlist is shown as it was ranked' END AS warning FROM kept p GROUP BY query_id""")
def top03(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = V.retrieve(_chunks(spark, sf_dir), _asked(spark, sf_dir), _picks(spark, sf_dir), 8)
    return got.groupBy("query_id").agg(F.count("*").alias("hits"), F.max("candidate_count").alias("candidate_count"), F.max("reranked").alias("reranked"), F.round(F.sum("score"), 6).alias("total"), F.coalesce(F.max("warning"), F.lit("")).alias("warning"))


@register("agg03_index_meta", "SELECT count(DISTINCT label)::BIGINT AS document_count, count(*)::BIGINT AS chunk_count, max(len(embedding))::BIGINT AS dimensions FROM embeddings")
def agg03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.index_meta(_chunks(spark, sf_dir))


@register("agg03_distinct_sketch", "SELECT l_returnflag AS flag, count(*)::BIGINT AS n, true AS close, true AS same FROM lineitem GROUP BY l_returnflag UNION ALL SELECT NULL, count(*)::BIGINT, true, true FROM lineitem UNION ALL SELECT 'vectors', count(*)::BIGINT, true, true FROM embeddings")
def agg03_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts of order lines from sketches of each ship month: of each return flag, of all, and distinct
    vectors from sketches of each label; whether they are within 2 % of the exact number (close), as one sketch of
    the whole is too (same)."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.date_trunc("month", "l_shipdate").alias("part"), F.col("l_partkey").cast("string").alias("x"))
    vectors = table(spark, sf_dir, "embeddings").select(F.lit("vectors").alias("flag"), F.col("label").cast("timestamp").alias("part"), F.to_json(F.col("embedding")).alias("x"))

    def row(rows: DataFrame, by: list[str]) -> DataFrame:
        flag = F.lit(None).cast("string") if not by else F.col("flag")
        parts = V.merged_sketches(V.distinct_sketches(rows, "x", [*by, "part"]), by).select(flag.alias("f"), "n", "about")
        near = lambda c: F.abs(F.col(c) - F.col("exact")) <= 0.02 * F.col("exact")
        whole = V.merged_sketches(V.distinct_sketches(rows, "x", by), by).select(flag.alias("g"), F.col("about").alias("one"))
        exact = rows.groupBy(*by).agg(F.countDistinct("x").alias("exact")).select(flag.alias("e"), "exact")
        both = parts.join(whole, F.col("f").eqNullSafe(F.col("g"))).join(exact, F.col("f").eqNullSafe(F.col("e")))
        return both.select(F.col("f").alias("flag"), "n", near("about").alias("close"), near("one").alias("same"))

    return row(lines, ["flag"]).unionByName(row(lines, [])).unionByName(row(vectors, ["flag"]))


@register("set01_remove_documents", "SELECT label AS document, count(*)::BIGINT AS chunks, label % 3 = 0 AS gone FROM embeddings GROUP BY label UNION ALL SELECT 1000001, 0, true")
def set01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that stay with their chunks, and those that go with as many as they had; one of them was never there."""
    chunks = _chunks(spark, sf_dir)
    gone = chunks.where("document % 3 = 0").select("document").unionByName(spark.range(1).select(F.lit(1000001).cast("int").alias("document")))
    kept, removed = V.remove_documents(chunks, gone)
    kept = kept.groupBy("document").agg(F.count("*").alias("chunks"))
    return kept.withColumn("gone", F.lit(False)).unionByName(removed.select("document", F.col("removed").alias("chunks"), F.lit(True).alias("gone")))


@register("jon09_align_vectors", "SELECT count(*)::BIGINT AS chunks, count(*) FILTER (vec_id % 7 = 0)::BIGINT AS missing, count(*) FILTER (vec_id % 11 = 0 AND vec_id % 7 <> 0)::BIGINT AS repeated, 0::BIGINT AS orphans, 1::BIGINT AS widths FROM embeddings")
def jon09(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    fresh, cached = chunks.where("chunk_id % 7 <> 0"), chunks.where("chunk_id % 11 = 0 AND chunk_id % 7 <> 0")
    return V.alignment_report(chunks, fresh.unionByName(cached))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as candidates by revenue: path, score, brand."""
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("score"))
    return table(spark, sf_dir, "part").join(sold, "p_partkey").select(F.lit(0).alias("query_id"), F.col("p_partkey").alias("path"), F.col("p_brand").alias("brand"), "score")


PARTS = "parts AS (SELECT 0 AS query_id, p_partkey AS path, p_brand AS brand, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS score FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL)"


@register(
    "win06_fuse_ranks",
    f"""WITH {PARTS},
sig AS (SELECT brand AS query_id, path, 'graph' AS signal, score AS raw FROM parts UNION ALL SELECT p_brand, p_partkey, 'text', p_retailprice FROM part UNION ALL SELECT p_brand, p_partkey, 'recent', p_size FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, signal ORDER BY raw DESC, path) - 1 AS n FROM sig)
SELECT query_id, path, round(sum(CASE signal WHEN 'graph' THEN 3.0 WHEN 'text' THEN 2.0 ELSE 1.5 END / (n + 5)), 12) AS score FROM r GROUP BY ALL""",
)
def win06(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    signal = lambda name, raw: part.select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("path"), F.lit(name).alias("signal"), F.col(raw).cast("double").alias("raw"))
    graph = _parts(spark, sf_dir).select(F.col("brand").alias("query_id"), "path", F.lit("graph").alias("signal"), F.col("score").alias("raw"))
    fused = S.fuse_ranks(graph.unionByName(signal("text", "p_retailprice")).unionByName(signal("recent", "p_size")), {"graph": 3, "text": 2, "recent": 1.5}, long=True)
    return fused.select("query_id", "path", F.round("score", 12).alias("score"))


@register(
    "agg10_reasons",
    """SELECT p_brand AS query_id, p_partkey AS path, 'matched via ' || CASE WHEN p_brand NOT LIKE '%1' AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey) THEN 'graph, ' ELSE '' END || 'text' || CASE WHEN p_size % 2 = 0 THEN ', recent' ELSE '' END || CASE WHEN p_brand LIKE '%1' THEN ' (text only, there is no symbol index)' ELSE '' END AS purpose FROM part""",
)
def agg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands whose name ends in 1 have no symbol index."""
    part = table(spark, sf_dir, "part")
    signal = lambda df, name, raw: df.select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("path"), F.lit(name).alias("signal"), F.col(raw).cast("double").alias("raw"))
    graph = _parts(spark, sf_dir).select(F.col("brand").alias("query_id"), "path", F.lit("graph").alias("signal"), F.col("score").alias("raw"))
    graph = graph.where("query_id not like '%1'")
    fused = S.fuse_ranks(graph.unionByName(signal(part, "text", "p_retailprice")).unionByName(signal(part.where("p_size % 2 = 0"), "recent", "p_size")), {"graph": 3, "text": 2, "recent": 1.5}, long=True)
    return fused.select("query_id", "path", S.purpose(F.col("reasons"), F.endswith("query_id", F.lit("1"))).alias("purpose"))


@register("win08_diversify", f"WITH {PARTS}, d AS (SELECT *, score * pow(0.7, row_number() OVER (PARTITION BY brand ORDER BY score DESC, path) - 1) AS worth FROM parts) SELECT path, brand, round(score, 2) AS score, row_number() OVER (ORDER BY round(worth, 9) DESC, path)::INTEGER AS rank FROM d QUALIFY rank <= 60")
def win08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.diversify(_parts(spark, sf_dir), F.col("brand")).select("path", "brand", F.round("score", 2).alias("score"), "rank")


@register(
    "jon05_graph_expand",
    f"""WITH {PARTS}, cand AS (SELECT 'p' || path AS path, score FROM parts),
seeds AS (SELECT path FROM cand ORDER BY score DESC, path LIMIT 10),
edges AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem), sym AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)
SELECT dst AS path, round(count(*) * 0.3 + CASE WHEN dst IN (SELECT path FROM cand) THEN 0 ELSE 0.1 END, 6) AS bump FROM sym WHERE src IN (SELECT path FROM seeds) GROUP BY dst""",
)
def jon05(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand = _parts(spark, sf_dir).select("query_id", F.concat(F.lit("p"), "path").alias("path"), "score")
    pairs = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    edges = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return S.graph_expand(cand, edges).select("path", F.round("bump", 6).alias("bump"))


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path")).distinct()


CAND = "cand AS (SELECT p_partkey AS path FROM part WHERE p_size <= 25)"


@register("jon06_cochange_in", f"WITH {CAND}, c AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS path FROM lineitem WHERE l_partkey IN (SELECT path FROM cand)), k AS (SELECT *, count(*) OVER (PARTITION BY o) AS n FROM c) SELECT path, sum(n - 1)::BIGINT AS together, round(least(sum(n - 1), 10) * 0.4, 6) AS bump FROM k WHERE n >= 2 GROUP BY path")
def jon06(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand = table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("path"))
    return S.cochange_in(cand, _commits(spark, sf_dir)).withColumn("bump", F.round("bump", 6))


@register("jon07_cochange_out", f"WITH {CAND}, seeds AS (SELECT p_partkey AS path FROM part WHERE p_size <= 5), c AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS path FROM lineitem), k AS (SELECT *, count(*) FILTER (path IN (SELECT path FROM seeds)) OVER (PARTITION BY o) AS n FROM c) SELECT path, sum(n)::BIGINT AS together, round(least(sum(n), 6) * 0.3, 6) AS bump FROM k WHERE n > 0 AND path NOT IN (SELECT path FROM cand) GROUP BY path HAVING sum(n) >= 2")
def jon07(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "path")
    return S.cochange_out(part.where("p_size <= 25").select("path"), _commits(spark, sf_dir), part.where("p_size <= 5").select("path")).withColumn("bump", F.round("bump", 6))


COMMITS = "commits AS (SELECT c_nationkey AS project, l_partkey AS path, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS seq, l_linenumber AS ord FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey)"


@register("win07_recent_files", f"WITH {COMMITS}, f AS (SELECT project, path, min(seq * 100 + ord) AS newest FROM commits GROUP BY ALL) SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY newest, path)::INTEGER AS rank FROM f QUALIFY rank <= 60")
def win07(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    newest = F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("at"), (-F.col("o_orderkey")).alias("key"))
    log = C.ordered_paths(orders.select(F.col("c_nationkey").alias("project"), "o_orderkey", newest.alias("newest")), "project", "newest").select("project", "o_orderkey", F.col("place").alias("seq"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("ord"))
    return S.recent_files(log.join(lines, "o_orderkey"))


HYBRID = f"""{EXPANDED_TOP},
known AS (SELECT path FROM files WHERE doc_id % 10 <> 7),
sym AS (SELECT item_id AS query_id, path, length(content)::DOUBLE AS raw FROM benchmark JOIN files ON doc_id % 97 = item_id % 97 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY raw DESC, path) <= 60),
recent AS (SELECT path, doc_id::DOUBLE AS raw FROM files ORDER BY doc_id DESC LIMIT 60),
sig AS (SELECT query_id, path, 'graph' AS s, 3.0::DOUBLE AS w, raw FROM sym UNION ALL SELECT query_id, path, 'text', 2.0, round(score, 9) FROM top UNION ALL SELECT item_id, path, 'recent', 1.5, raw FROM recent, benchmark),
fused AS (SELECT query_id, path, round(sum(w / (n + 4)), 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, s ORDER BY raw DESC, path) AS n FROM sig) WHERE path IN (SELECT path FROM known) GROUP BY query_id, path),
seeds AS (SELECT query_id, path FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) <= 10),
pairs AS (SELECT a.path AS src, b.path AS dst FROM files a JOIN files b ON b.doc_id = a.doc_id + 3),
edges AS (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs),
near AS (SELECT s.query_id, dst AS path, count(*) AS k FROM seeds s JOIN edges ON src = s.path WHERE dst IN (SELECT path FROM known) GROUP BY ALL),
graph AS (SELECT n.query_id, n.path, k * 0.3 + CASE WHEN f.path IS NULL THEN 0.1 ELSE 0 END AS score FROM near n LEFT JOIN fused f ON f.query_id = n.query_id AND f.path = n.path),
pool AS (SELECT query_id, path, sum(score) AS score FROM (SELECT query_id, path, score FROM fused UNION ALL SELECT query_id, path, score FROM graph) GROUP BY query_id, path),
commits AS (SELECT 'a' || doc_id // 4 AS c, path FROM files UNION ALL SELECT 'b' || doc_id % 211, path FROM files),
ins AS (SELECT query_id, path, least(sum(k - 1), 10) * 0.4 AS score FROM (SELECT p.query_id, p.path, count(*) OVER (PARTITION BY p.query_id, c) AS k FROM pool p JOIN commits m ON m.path = p.path) WHERE k >= 2 GROUP BY query_id, path),
hits AS (SELECT s.query_id, c, count(*) AS k FROM seeds s JOIN commits m ON m.path = s.path GROUP BY ALL),
outs AS (SELECT h.query_id, m.path, least(sum(k), 6) * 0.3 AS score FROM hits h JOIN commits m USING (c) LEFT JOIN pool p ON p.query_id = h.query_id AND p.path = m.path WHERE p.path IS NULL AND m.path IN (SELECT path FROM known) GROUP BY h.query_id, m.path HAVING sum(k) >= 2),
total AS (SELECT query_id, path, round(sum(score), 9) AS score FROM (SELECT * FROM pool UNION ALL SELECT * FROM ins UNION ALL SELECT * FROM outs) GROUP BY query_id, path),
why AS (SELECT query_id, path, CASE s WHEN 'graph' THEN 0 WHEN 'text' THEN 1 ELSE 2 END AS o, s AS reason FROM sig UNION SELECT query_id, path, 3, 'import-graph' FROM near UNION SELECT query_id, path, 4, 'co-change' FROM ins UNION SELECT query_id, path, 4, 'co-change' FROM outs),
reasons AS (SELECT query_id, path, string_agg(reason, ',' ORDER BY o) AS reasons FROM why GROUP BY query_id, path),
worth AS (SELECT *, round(score * pow(0.7::DOUBLE, row_number() OVER (PARTITION BY query_id, regexp_replace(path, '/[^/]*$', '') ORDER BY score DESC, path) - 1), 9) AS w FROM total)"""


@register("top05_hybrid_search", f"WITH {HYBRID} SELECT query_id, path, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, path)::INTEGER AS rank, reasons FROM worth JOIN reasons USING (query_id, path) QUALIFY rank <= 60")
def top05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanded queries over all documents as files: BM25 hits, hits of a symbol index (documents by a remainder of
    their id), the newest files; then imports (ids three apart), shared commits, and diversity over folders. A tenth of
    the files is unknown to the scan."""
    docs = files(spark, sf_dir)
    asked = expanded(spark, sf_dir).groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    generated = F.concat(F.lit("The session, token: for Item"), "query_id")  # what a model would add
    asked = asked.select("query_id", S.merge_terms(F.col("terms"), generated).alias("terms"))
    text = bm25_top(spark, sf_dir, asked).select("query_id", "path", F.lit("text").alias("signal"), F.round("score", 9).alias("raw"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 97).alias("m"))
    hits = docs.select((F.col("doc_id") % 97).alias("m"), "path", F.length("content").cast("double").alias("raw")).join(items, "m")
    symbols = S.topk(hits, 60, score="raw").select("query_id", "path", F.lit("graph").alias("signal"), "raw")
    newest = docs.select("path", F.col("doc_id").cast("double").alias("raw")).orderBy(F.col("raw").desc()).limit(60)
    recent = items.join(F.broadcast(newest)).select("query_id", "path", F.lit("recent").alias("signal"), "raw")  # 60 rows for each query
    ids = docs.select("doc_id", "path")
    pairs = ids.withColumn("doc_id", F.col("doc_id") + 3).withColumnRenamed("path", "src").join(ids.withColumnRenamed("path", "dst"), "doc_id").select("src", "dst")
    edges = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    commit = lambda name, c: ids.select(F.concat(F.lit(name), c).alias("commit"), "path")
    commits = commit("a", F.expr("doc_id div 4")).unionByName(commit("b", F.col("doc_id") % 211))
    known = ids.where("doc_id % 10 <> 7").select("path")
    found = S.hybrid_search(text.unionByName(symbols).unionByName(recent), edges, commits, known, F.regexp_replace("path", "/[^/]*$", ""), {"graph": 3, "text": 2, "recent": 1.5})
    return found.select("query_id", "path", F.round("score", 6).alias("score"), "rank", F.array_join("reasons", ",").alias("reasons"))
