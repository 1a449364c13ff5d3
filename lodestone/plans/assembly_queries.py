"""Registered queries of files, prompts and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import assembly as A
from lodestone.operators import corpus as C
from lodestone.operators import extract as X
from lodestone.operators import sessions as S
from lodestone.operators import vectors as V
from lodestone.plans.corpus_queries import _chunks
from lodestone.plans.extract_queries import SOURCES, sources
from lodestone.plans.registry import register
from lodestone.plans.session_queries import _budget_files
from lodestone.plans.tables import files, table
from lodestone.plans.vector_queries import SHORT, _asked
from lodestone.plans.vector_queries import _chunks as _vectors
from lodestone.sources import files as L


@register("src01_scan_tree", "SELECT source, lang, sum(octet_length(encode(replace(text, chr(10), ' '))) + 1)::BIGINT AS size FROM documents GROUP BY ALL")
def src01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as lines of files, a folder for each source and language, and what a scan of that tree finds;
    a second tree below a skipped folder isn't found."""
    root = L.scratch_folder(spark, "tree")
    lines = table(spark, sf_dir, "documents").select("source", "lang", F.regexp_replace("text", "\n", " ").alias("value"))
    for folder in (root, f"{root}/node_modules"):
        lines.write.partitionBy("source", "lang").mode("append").text(folder)
    found = L.scan_tree(spark, root).where("name like 'part-%'")
    of = lambda c: F.regexp_extract("dir", f"{c}=([^/]*)", 1).alias(c)
    return found.select(of("source"), of("lang"), "size").groupBy("source", "lang").agg(F.sum("size").alias("size"))


_IGNORED = "SELECT p_partkey FROM part WHERE NOT (p_size > 40 AND p_partkey % 10 <> 3)"


@register("src02_ignore_filter", _IGNORED)
def src02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files; each brand ignores its folder of large parts, but for names that end in 3."""
    part = table(spark, sf_dir, "part")
    folder = F.regexp_replace("p_brand", "#", "")
    paths = part.select("p_partkey", F.concat(folder, F.when(F.col("p_size") > 40, "/large/p").otherwise("/small/p"), "p_partkey", F.lit(".ts")).alias("path"))
    base = part.select(folder.alias("base")).distinct()
    rule = lambda n, pattern, negated: base.select("base", F.lit(n).alias("ord"), F.lit(pattern).alias("pattern"), F.lit(negated).alias("negated"))
    rules = rule(0, "^large(/|$)", False).unionByName(rule(1, r"3\.ts$", True))
    return L.ignore_filter(paths, rules).select("p_partkey")


@register("src03_binary_sniff", "SELECT doc_id, doc_id % 5 = 0 OR doc_id % 7 = 0 AS is_binary FROM documents")
def src03(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("f"), "doc_id", F.when(F.col("doc_id") % 7 == 0, ".png").otherwise(".md"))
    raw = F.encode(F.concat(F.when(F.col("doc_id") % 5 == 0, F.lit("\u0000")).otherwise(""), "text"), "UTF-8")
    return L.binary_sniff(table(spark, sf_dir, "documents").select("doc_id", name.alias("path"), raw.alias("content"))).select("doc_id", "is_binary")


@register("src04_read_text", "SELECT doc_id, octet_length(encode(text)) <= 3000 AS readable FROM documents")
def src04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    good, bad = L.read_text(rows, 3000)
    return good.select(F.col("path").alias("doc_id"), F.lit(True).alias("readable")).unionByName(bad.select(F.col("path").alias("doc_id"), F.lit(False).alias("readable")))


@register("src09_index", "SELECT vec_id AS chunk_id, label AS document, len(embedding)::INTEGER AS width, true AS sound FROM embeddings")
def src09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written to the shared folder and read again."""
    chunks = _vectors(spark, sf_dir)
    folder = L.scratch_folder(spark, "index")
    L.write_index(chunks.select("chunk_id", "document"), chunks.select("chunk_id", "embedding"), folder, "given")
    return L.read_index(spark, folder).select("chunk_id", "document", F.size("embedding").alias("width"), "sound")


@register("src14_conversion_ledger", "SELECT doc_id, CASE WHEN doc_id % 4 = 3 OR toxic = 1 OR (doc_id % 4 = 0 AND quality = 0) THEN 'failed' ELSE 'converted' END AS status, CASE WHEN doc_id % 4 = 3 THEN 'unsupported format' WHEN doc_id % 4 = 0 AND quality = 0 THEN 'the fast engine cannot extract images' WHEN toxic = 1 THEN 'extraction failed' END AS error FROM labels")
def src14(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    ending = F.when(F.col("doc_id") % 4 == 3, ".csv").when(F.col("doc_id") % 4 == 0, ".pdf").otherwise(".md")
    docs = labels.select("doc_id", F.concat(F.lit("d"), "doc_id", ending).alias("name"))
    null = F.lit(None).cast("string")
    attempts = labels.select("doc_id", F.when(F.col("quality") == 0, "fast").otherwise("layout").alias("engine"), F.lit("text-images").alias("mode"), F.when(F.col("toxic") == 1, "extraction failed").alias("error"), F.lit(1).alias("figures"), null.alias("vision_error"), null.alias("warning"))
    return L.conversion_ledger(docs, attempts).select("doc_id", "status", "error")


@register("jon08_reuse_vectors", "SELECT doc_id AS document, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN doc_id + 0.5::DOUBLE END AS kept FROM documents")
def jon08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of even documents are known, those of every sixth by another model; an odd document's text differs by
    its id."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), "source", F.concat("text", F.lit(" "), "doc_id").alias("text")).withColumnRenamed("source", "heading_path")
    model = F.when(F.col("document") % 3 == 0, "earlier").otherwise("present")
    old = docs.where("document % 2 = 0").withColumn("embedding", F.array(F.col("document") + F.lit(0.5))).withColumn("model", model)
    return V.reuse_vectors(docs, old, "present").select("document", F.get("vector", F.lit(0)).alias("kept"))


@register("asm01_tree_listing", f"""WITH {SOURCES}, n AS (SELECT d, path, row_number() OVER (PARTITION BY d ORDER BY path) AS r, count(*) OVER (PARTITION BY d) AS n FROM sources)
SELECT d AS project, 1::BIGINT AS place, '└── ' || d AS line FROM n GROUP BY d UNION ALL SELECT d, r + 1, '    ' || CASE WHEN r = n THEN '└── ' ELSE '├── ' END || split_part(path, '/', 2) FROM n""")
def asm01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tree_lines(sources(spark, sf_dir).select(F.substring_index("path", "/", 1).alias("project"), "path"))


def _skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources(spark, sf_dir)
    return X.skeletons(rows).join(rows.select("path", "content"), "path").withColumn("project", F.substring_index("path", "/", 1))


MAP = f"{SOURCES}, entries AS (SELECT d, path, '### ' || path || chr(10) || 'imports: ./p' || (k + 1) || ', node:fs' || chr(10) || 'export function f' || k || '(a: number): string' || chr(10) || 'export const c' || k || ' = 1;' AS e FROM sources)"


@register("asm02_codebase_map", f"WITH {MAP} SELECT d AS project, row_number() OVER (PARTITION BY d ORDER BY path)::BIGINT AS place, path, e AS entry FROM entries")
def asm02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.map_entries(_skeletons(spark, sf_dir))


@register("agg06_map_tokens", f"WITH {MAP} SELECT d AS project, ceil(length(string_agg(e, chr(10) || chr(10))) / 3.2::DOUBLE)::BIGINT AS tokens FROM entries GROUP BY d")
def agg06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.map_tokens(_skeletons(spark, sf_dir))


@register("asm03_coding_prompt")
def asm03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a folder within 2000 tokens; some can't be read, some have names of secrets."""
    k = F.col("k")
    path = F.when(k % 11 == 3, F.concat(F.col("project"), F.lit("/.env."), k)).otherwise(F.col("path"))
    rows = sources(spark, sf_dir).withColumn("project", F.substring_index("path", "/", 1)).select("k", "project", path.alias("path"), F.when(k % 13 != 5, F.col("content")).alias("content"))
    sized = rows.where("content is not null").select(F.col("project").alias("query_id"), F.col("k").alias("ord"), T.estimate_tokens(F.col("content")).alias("tokens"))
    fit = S.fill_prompt(sized, 2000).select(F.col("ord").alias("k"), "included")
    picked = rows.join(fit, "k", "left").withColumn("included", F.coalesce("included", F.lit(False)))
    return A.coding_prompt(picked, A.tree_listing(rows.select("project", "path")), "Answer with whole files.")


@register("asm04_full_document_prompt", "SELECT source || '-' || (doc_id // 100) AS request, md5(string_agg('## doc-' || doc_id || chr(10) || chr(10) || CASE WHEN length(text) > 4000 THEN left(text, 4000) || chr(10) || chr(10) || '[TRUNCATED: the document is longer than the limit]' ELSE text END, chr(10) || chr(10) ORDER BY 'doc-' || doc_id)) AS digest, count(*)::BIGINT AS documents FROM documents GROUP BY ALL")
def asm04(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("-"), F.expr("doc_id div 100")).alias("request"), F.concat(F.lit("doc-"), "doc_id").alias("name"), "text")
    return A.full_document_prompt(docs, chars=4000).select("request", F.md5("prompt").alias("digest"), "documents")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = V.nearest(_vectors(spark, sf_dir), _asked(spark, sf_dir), 8)
    return top.select("query_id", "rank", F.concat(F.lit("d"), "document").alias("document"), F.when(F.col("chunk_id") % 2 == 0, "Intro").alias("heading_path"), F.concat(F.lit("text of "), "chunk_id").alias("text"))


RAG = f"""{SHORT}, hits AS (SELECT query_id, rank, 'd' || document AS document, CASE WHEN chunk_id % 2 = 0 THEN 'Intro' ELSE 'no heading' END AS head, 'text of ' || chunk_id AS text, CASE WHEN chunk_id % 2 = 0 THEN 'Intro' ELSE '' END AS path FROM short WHERE rank <= 8),
body AS (SELECT query_id, string_agg('[' || rank || '] ' || document || ' — ' || head || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS body, count(*)::BIGINT AS excerpts, count(DISTINCT document)::BIGINT AS documents, string_agg(document || ' > ' || path, '; ' ORDER BY rank) AS citations FROM hits GROUP BY query_id),
lead AS (SELECT query_id, string_agg(document || ': about ' || document, chr(10) ORDER BY document) AS lead FROM (SELECT DISTINCT query_id, document FROM hits) GROUP BY query_id),
rag AS (SELECT query_id, 'Question: q' || query_id || chr(10) || chr(10) || 'Sources:' || chr(10) || lead || chr(10) || chr(10) || 'Excerpts:' || chr(10) || body AS prompt, excerpts, documents, citations FROM body JOIN lead USING (query_id) WHERE query_id % 100 = 0)"""


def _rag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second query has a question."""
    questions = _asked(spark, sf_dir).select("query_id", F.when(F.col("query_id") % 100 == 0, F.concat(F.lit("q"), "query_id")).alias("question"))
    abstracts = _vectors(spark, sf_dir).select(F.concat(F.lit("d"), "document").alias("document")).distinct().withColumn("abstract", F.concat(F.lit("about "), "document"))
    return A.rag_prompt(questions, _hits(spark, sf_dir), abstracts)


@register("asm05_rag_prompt", f"WITH {RAG} SELECT query_id, prompt, excerpts, documents FROM rag")
def asm05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rag(spark, sf_dir)


@register("agg11_prompt_summary", f"WITH {RAG} SELECT query_id, ceil(length(prompt) / 3.2::DOUBLE)::BIGINT AS tokens, documents, excerpts AS chunks, citations, CASE WHEN query_id % 200 = 0 THEN ['x/a.pdf', 'x/q' || query_id || '.pdf'] ELSE [] END AS unreadable FROM rag")
def agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits lie in folders; every second question also asked for two documents that can't be read."""
    hits = _hits(spark, sf_dir)
    lost = hits.where("query_id % 200 = 0").select("query_id", F.explode(F.array(F.concat(F.lit("x/q"), "query_id", F.lit(".pdf")), F.lit("x/a.pdf"))).alias("document"), F.lit(False).alias("readable"))
    wanted = hits.select("query_id", "document", F.lit(True).alias("readable")).unionByName(lost)
    return A.prompt_summary(_rag(spark, sf_dir), hits.withColumn("document", F.concat(F.lit("docs/in/"), "document")), wanted)


@register("jon11_preambles", f"WITH {RAG} SELECT DISTINCT query_id, document, 'about ' || document AS abstract FROM hits")
def jon11(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    return A.preambles(hits, hits.select("document").distinct().withColumn("abstract", F.concat(F.lit("about "), "document")))


@register("asm06_turn_prompt")
def asm06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents as sessions, fitted to a budget; their labels as verification."""
    fitted = S.fit_to_budget(_budget_files(spark, sf_dir), 8000).select(F.col("query_id").alias("session_id"), "path", "fate")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("path"), F.col("text").alias("content"), F.substring_index("text", "\n", 1).alias("outline"))
    files_ = fitted.join(docs, "path")
    failure = F.struct(F.col("path").alias("file"), F.col("doc_id").alias("line"), F.lit(None).cast("string").alias("test"), F.lit("poor").alias("message"))
    judged = files_.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    failures = F.transform(F.array_sort(F.collect_list(F.when(F.col("quality") == 0, F.struct("doc_id", failure.alias("f"))))), lambda x: x["f"])
    per = judged.groupBy("session_id").agg(failures.alias("failures"), F.min("doc_id").alias("first"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    lint = F.struct(F.lit("lint").alias("stage"), F.lit("run lint").alias("command"), (F.size("failures") == 0).alias("success"), "failures", F.lit("").alias("output"))
    tests = F.struct(F.lit("test").alias("stage"), F.lit("run tests").alias("command"), (F.col("toxic") == 0).alias("success"), F.array().cast("array<struct<file:string,line:bigint,test:string,message:string>>").alias("failures"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("line "), i)), "\n").alias("output"))
    step = lambda status, text: F.struct(F.lit(status).alias("status"), F.lit(text).alias("text"))
    sessions = per.select(
        "session_id",
        (F.col("first") % 7 + 1).alias("turn"),
        F.concat(F.lit("summarise "), "session_id").alias("task"),
        F.array(step("done", "read"), step("active", "write"), step("blocked", "check"), step("pending", "send")).alias("plan"),
        F.when(F.col("first") % 2 == 0, F.array(F.lit("plain words"), F.lit("short"))).otherwise(F.array().cast("array<string>")).alias("decisions"),
        F.when(F.col("first") % 3 == 0, F.array(F.concat(F.lit("doc-"), "first"))).otherwise(F.array().cast("array<string>")).alias("applied"),
        F.array(lint, tests).alias("verification"),
        F.concat(F.lit("n-"), "first").alias("nonce"),
    )
    return A.turn_prompt(sessions, files_, "Answer with whole files.")


@register("jon13_attach_figure_notes", "SELECT doc_id, source || chr(10) || '![a](img/f1.png)' || chr(10) || '> first of ' || doc_id || chr(10) || '![b](img/f1.png)' || chr(10) || text || chr(10) || chr(10) || '## Figures' || chr(10) || '- f2.png: second' AS text FROM documents")
def jon13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = docs.select("doc_id", F.concat("source", F.lit("\n![a](img/f1.png)\n![b](img/f1.png)\n"), "text").alias("text"))
    notes = docs.select("doc_id", F.lit("f1.png").alias("file"), F.concat(F.lit("first of "), "doc_id").alias("note")).unionByName(docs.select("doc_id", F.lit("f2.png").alias("file"), F.lit("second").alias("note")))
    return A.attach_figure_notes(text, notes)


@register("jon14_missing_figures", "WITH f AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS file FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) SELECT doc_id, count(*)::BIGINT AS missing, count(*) || ' image(s) without a description: ' || array_to_string(list_sort(list(file::VARCHAR))[1:3], ', ') AS error FROM f WHERE file % 3 <> 1 GROUP BY doc_id")
def jon14_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as figures after a run: finished orders have all their notes, others every third."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    figures = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("file"), F.when((F.col("o_orderstatus") == "F") | (F.col("l_linenumber") % 3 == 1), "seen").alias("note"))
    return A.missing_figures(figures, figures)


@register("jon14_figure_cache_plan", "SELECT doc_id, file, bool_and(known) OVER (PARTITION BY doc_id) AS reuse FROM (SELECT l_orderkey AS doc_id, l_linenumber AS file, bool_or(l_partkey % 3 <> 0) AS known FROM lineitem GROUP BY ALL)")
def jon14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as figures; the cache lacks some or has them by another model."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("file"), "l_partkey")
    cache = lines.select("doc_id", "file", F.lit("p").alias("provider"), F.when(F.col("l_partkey") % 3 == 0, "old").otherwise("new").alias("model"))
    return A.figure_cache_plan(lines.select("doc_id", "file").distinct(), cache, "p", "new")
