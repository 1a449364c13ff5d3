"""Registered queries of the corpus: scalar functions, status, sections and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths as P
from lodestone.functions import text as T
from lodestone.operators import corpus as C
from lodestone.operators import ranking as R
from lodestone.operators import search as S
from lodestone.plans.registry import register
from lodestone.plans.search_queries import _sql_list
from lodestone.plans.tables import FILES, files, spread, sql_tokens, table
from lodestone.sources import files as L

TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _units(x: str) -> str:
    """Sentences in SQL: marks instead of look-around."""
    marked = f"""regexp_replace(regexp_replace({x}, '([.!?])\\s+([A-Z(\\["''`*_])', '\\1' || chr(1) || '\\2', 'g'), '\\n{{2,}}', chr(1), 'g')"""
    return f"(SELECT CASE WHEN len(l) > 0 THEN l ELSE [{x}] END FROM (SELECT list_filter(list_transform(string_split({marked}, chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS l))"


@register("fn03_sentences", f"SELECT doc_id, len(u)::BIGINT AS n, md5(array_to_string(u, '|')) AS digest FROM (SELECT doc_id, {_units('text')} AS u FROM documents)")
def fn03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("u")).select("doc_id", F.size("u").cast("bigint").alias("n"), F.md5(F.array_join("u", "|")).alias("digest"))


@register("fn04_estimate_tokens", "SELECT doc_id, ceil(length(text) / 3.2::DOUBLE)::BIGINT AS tokens FROM documents")
def fn04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


CUT = """CASE WHEN length(t) <= {n} THEN t
  WHEN greatest(a, b) > {n} / 2 THEN left(left(t, {n}), greatest(a, b) + 1) ELSE regexp_replace(left(t, {n}), '^\\s+|\\s+$', '', 'g') || '…' END"""


def _cut(source: str, n: int) -> str:
    last = lambda m: f"CASE WHEN instr(reverse(left(t, {n})), {m}) > 0 THEN length(left(t, {n})) - instr(reverse(left(t, {n})), {m}) - 1 ELSE -1 END"
    return f"SELECT doc_id, {CUT.format(n=n)} AS cut FROM (SELECT *, {last(repr(' .'))} AS a, {last('chr(10) || ' + repr('.'))} AS b FROM ({source}))"


@register("fn06_truncate_sentence", _cut("SELECT doc_id, text AS t FROM documents", 300))
def fn06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.truncate_sentence(F.col("text"), 300).alias("cut"))


@register("fn05_extract_abstract", _cut("SELECT doc_id, regexp_replace('Abstract words of ' || source || chr(10) || text, '^\\s+|\\s+$', '', 'g') AS t FROM documents", 1200).replace("AS cut", "AS abstract"))
def fn05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled abstract for even documents, else the first paragraph after a heading; both hold the same text."""
    body = F.concat(F.lit("Abstract words of "), "source", F.lit("\n"), "text")
    even = F.concat(F.lit("# Title\n\n## Abstract\n\n"), body, F.lit("\n\n## Next\n\nmore"))
    odd = F.concat(F.lit("# Title\n\n> quoted\n\n"), body, F.lit("\n\nmore"))
    return _docs(spark, sf_dir).select("doc_id", T.extract_abstract(F.when(F.col("doc_id") % 2 == 0, even).otherwise(odd)).alias("abstract"))


@register("fn07_preview", "SELECT doc_id, CASE WHEN length(h) > 800 THEN left(h, 800) || ' …' ELSE h END AS head FROM (SELECT doc_id, regexp_replace(array_to_string(string_split(text, chr(10))[1:25], chr(10)), '^\\s+|\\s+$', '', 'g') AS h FROM documents)")
def fn07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.preview(F.col("text")).alias("head"))


@register("fn08_tail", "SELECT doc_id, CASE WHEN length(text) > 2000 THEN '… (earlier output omitted)' || chr(10) || right(text, 2000) ELSE text END AS tail FROM documents")
def fn08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.tail(F.col("text"), 2000).alias("tail"))


@register("fn09_safe_fence", "SELECT doc_id, repeat('`', CASE WHEN doc_id % 6 >= 3 THEN doc_id % 6 + 1 ELSE 3 END::INTEGER) AS fence FROM documents")
def fn09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold a run of 0 to 5 backticks."""
    held = F.concat("text", F.expr("repeat('`', cast(doc_id % 6 as int))"), F.lit("\n`x`"))
    return _docs(spark, sf_dir).select("doc_id", T.safe_fence(held).alias("fence"))


@register("fn10_salvage_json", "SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 = 0 THEN ' [a, ].ts,}' ELSE '' END AS name, p_size::BIGINT AS size FROM part")
def fn10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects behind prose or in a fence, a third with commas too many; valid ones may hold such commas in a name."""
    part = table(spark, sf_dir, "part")
    name = F.concat("p_name", F.when((F.col("p_partkey") % 3 != 0) & (F.col("p_partkey") % 5 == 0), " [a, ].ts,}").otherwise(""))
    plain = F.to_json(F.struct(F.array(F.struct(name.alias("name"), F.col("p_size").alias("size"))).alias("files")))
    loose = F.when(F.col("p_partkey") % 3 == 0, F.regexp_replace(plain, r"\]\}$", ", ] , }")).otherwise(plain)
    reply = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), loose, F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("Here it is: "), loose, F.lit(" - that's all")))
    read = F.from_json(T.salvage_json(reply), "files array<struct<name:string,size:bigint>>")
    return part.select("p_partkey", F.explode(read["files"]).alias("f")).select("p_partkey", "f.name", "f.size")


@register("fn11_insert_instruction", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || chr(10) || 'do ' || source ELSE '## Output' || chr(10) || text || chr(10) || 'do ' || source || chr(10) || chr(10) || '## Output' || chr(10) || 'rest' END AS prompt FROM documents")
def fn11(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("## Output\n"), "text", F.lit("\n## Output\nrest")))
    return _docs(spark, sf_dir).select("doc_id", T.insert_instruction(prompt, F.concat(F.lit("do "), "source")).alias("prompt"))


@register("fn13_content_hash", "SELECT doc_id, left(sha1(text), 8) AS hash FROM documents")
def fn13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@register("fn14_strip_ansi", "SELECT doc_id, source || ': ' || text AS plain FROM documents")
def fn14(spark: SparkSession, sf_dir: str) -> DataFrame:
    painted = F.concat(F.lit("\u001b[31m"), "source", F.lit("\u001b[0m: \u001b[1;32m"), "text", F.lit("\u001b[K"))
    return _docs(spark, sf_dir).select("doc_id", T.strip_ansi(painted).alias("plain"))


@register("fn15_truncate_document", "SELECT doc_id, CASE WHEN length(text) > 3000 THEN left(text, 3000) || chr(10) || chr(10) || '[TRUNCATED: the document is longer than the limit]' ELSE text END AS text FROM documents")
def fn15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.truncate_document(F.col("text"), 3000).alias("text"))


@register("fn16_helpers", "SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS suppliers, round(least(10, count(*)) * pow(0.7, count(*)), 6) AS damped, round(ln(1 + sum(l_linenumber)), 6) AS logged FROM lineitem GROUP BY l_orderkey")
def fn16(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.array_distinct(F.collect_list("l_suppkey"))).alias("suppliers"), F.round(F.least(F.lit(10), n) * F.pow(F.lit(0.7), n), 6).alias("damped"), F.round(F.log1p(F.sum("l_linenumber")), 6).alias("logged"))


_EXT = ["ts", "PY", "json", "md", "png", "min.js", "go", "rs", "lock", "sql", "svg", "tsx", "env", "unknown"]
_NAMED = "named AS (SELECT doc_id, source || '/' || lang || '/doc.' || doc_id || '.' || (" + _sql_list(_EXT) + ")[(doc_id % 14 + 1)::INTEGER] AS path FROM documents)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, _EXT)), (F.col("doc_id") % len(_EXT) + 1).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/doc."), "doc_id", F.lit("."), ext).alias("path"))


@register("prj01_classify_file", f"WITH {_NAMED} SELECT doc_id, CASE (doc_id % 14)::INTEGER WHEN 0 THEN 'code' WHEN 1 THEN 'code' WHEN 2 THEN 'config' WHEN 3 THEN 'doc' WHEN 4 THEN 'asset' WHEN 5 THEN 'asset' WHEN 6 THEN 'code' WHEN 7 THEN 'code' WHEN 10 THEN 'asset' WHEN 11 THEN 'code' ELSE 'config' END AS kind FROM named")
def prj01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("doc_id", P.classify_file(F.col("path")).alias("kind"))


@register("prj02_language_of", f"WITH {_NAMED} SELECT doc_id, CASE (doc_id % 14)::INTEGER WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 5 THEN 'typescript' WHEN 6 THEN 'go' WHEN 7 THEN 'rust' WHEN 11 THEN 'typescript' ELSE 'other' END AS family, CASE (doc_id % 14)::INTEGER WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'json' WHEN 3 THEN 'markdown' WHEN 5 THEN 'javascript' WHEN 6 THEN 'go' WHEN 7 THEN 'rust' WHEN 9 THEN 'sql' WHEN 11 THEN 'tsx' ELSE 'text' END AS fence FROM named")
def prj02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("doc_id", P.family(F.col("path")).alias("family"), P.fence_language(F.col("path")).alias("fence"))


_SECRETS = [".env", ".env.example", "id_rsa", "server.pem", "readme.md", "credentials.json", "secrets.sample.toml", ".env.local"]


@register("prj03_is_sensitive", "SELECT p_partkey, (p_partkey % 8) IN (0, 2, 3, 5, 7) AS sensitive FROM part")
def prj03(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _SECRETS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", P.is_sensitive(name).alias("sensitive"))


@register("prj04_slug", f"WITH {FILES} SELECT doc_id, left(replace(source || '-' || lang || '-doc-' || doc_id, '_', '-'), 48) || '-' || left(sha1(path), 6) AS slug FROM files JOIN documents USING (doc_id)")
def prj04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", P.slug(F.col("path")).alias("slug"))


_TAILS = ["a.ts", "../a.ts", "CON.txt", "b?.md", "c./d.md", "ok name.md", "nul", "x/y/z.py"]


@register("prj05_portable_path", "SELECT p_partkey, (p_partkey % 8) IN (0, 5, 7) AS portable FROM part")
def prj05(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", P.is_portable(F.concat_ws("/", F.lit("src"), F.regexp_replace("p_name", r"[^\w ]", "x"), end)).alias("portable"))


_BELOW = ["", "node_modules/", ".git/", "a/out/", "a/b.dist/", "converted/x/", "out.md/"]


@register("prj06_supported_document", "SELECT doc_id, doc_id % 14 = 3 AS supported, doc_id // 14 % 7 <> 2 AS in_docs, doc_id % 14 = 3 AND doc_id // 14 % 7 IN (0, 4, 6) AS in_root FROM documents")
def prj06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of many formats in folders that scans enter or not."""
    folder = F.element_at(F.array(*map(F.lit, _BELOW)), (F.expr("doc_id div 14") % 7 + 1).cast("int"))
    path = F.concat(folder, "path")
    return _named(spark, sf_dir).select("doc_id", P.is_supported_document(path).alias("supported"), P.is_listed_document(path, False).alias("in_docs"), P.is_listed_document(path, True).alias("in_root"))


@register("prj07_known_only", "SELECT l_partkey AS path, sum(l_quantity)::DOUBLE AS score FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20) GROUP BY l_partkey")
def prj07(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), "l_quantity")
    known = table(spark, sf_dir, "part").where("p_size > 20").select(F.col("p_partkey").alias("path"))
    return hits.join(known, "path", "left_semi").groupBy("path").agg(F.sum("l_quantity").alias("score"))


VERDICTS = "verdicts AS (SELECT p_brand AS query_id, p_partkey AS path, (p_size % 4)::DOUBLE AS score, (p_retailprice % 100) / 100 AS confidence FROM part)"


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("path"), (F.col("p_size") % 4).cast("double").alias("score"), ((F.col("p_retailprice") % 100) / 100).alias("confidence"))


@register("prj08_route_verdicts", f"WITH {VERDICTS} SELECT query_id, path, CASE WHEN score >= 2.5 AND confidence >= 0.85 THEN 'include' ELSE 'flag' END AS bucket FROM verdicts WHERE score >= 1.5")
def prj08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.route_verdicts(_verdicts(spark, sf_dir)).select("query_id", "path", "bucket")


@register("prj09_coerce_verdict", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE least(3, p_size % 6) END::DOUBLE AS score, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE least(1, greatest(0, (p_size - 10) / 20.0)) END::DOUBLE AS confidence FROM part")
def prj09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as text, some without a number."""
    bad = F.col("p_partkey") % 5 == 0
    score = F.when(bad, F.lit("n/a")).otherwise(((F.col("p_size") % 6) + F.lit(0.2)).cast("string"))
    confidence = F.when(bad, F.lit("")).otherwise(((F.col("p_size") - 10) / 20.0).cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", score.alias("score"), confidence.alias("confidence"))
    return R.coerce_verdicts(rows).select("p_partkey", "score", "confidence")


@register(
    "src05_read_head",
    """SELECT doc_id, left(text, n) || CASE WHEN octet_length(encode(left(text, n))) < 400 AND n < length(text) THEN chr(65533) ELSE '' END AS head
FROM (SELECT doc_id, text, list_max(list_filter(range(0, 401), lambda i: octet_length(encode(left(text, i::BIGINT))) <= 400)) AS n FROM (SELECT doc_id, text FROM documents))""",
)
def src05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 400 bytes, which may end inside a character."""
    files_ = _docs(spark, sf_dir).select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return L.read_head(files_, 400).select(F.col("path").alias("doc_id"), "head")


STATUS = """SELECT path, CASE WHEN doc_id % 4 = 3 THEN 'failed' WHEN quality = 1 AND toxic = 0 AND doc_id % 2 = 0 THEN 'converted' WHEN toxic = 1 THEN 'failed' ELSE 'ready' END AS status,
  CASE WHEN toxic = 1 THEN 'toxic' WHEN doc_id % 4 = 3 THEN 'unsupported format' END AS error
FROM (SELECT doc_id, source || '/' || lang || '/doc-' || doc_id || '.md' AS path FROM documents) LEFT JOIN labels USING (doc_id)"""


@register("src06_scan_documents", STATUS)
def src06(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = files(spark, sf_dir)
    docs = own.select("path", F.concat(F.lit("doc"), F.when(F.col("doc_id") % 4 == 3, ".csv").otherwise(".md")).alias("name"))
    labels = table(spark, sf_dir, "labels").join(own.select("doc_id", "path"), "doc_id")
    state = labels.select("path", F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "converted").alias("status"), F.when(F.col("toxic") == 1, "toxic").alias("error"))
    return C.scan_documents(docs, state, labels.where("doc_id % 2 = 0").select("path"))


@register("src07_upsert_state", "SELECT slug, CASE status WHEN 'P' THEN 'ready' WHEN 'F' THEN 'converted' ELSE 'failed' END AS status, seq FROM (SELECT 'c' || o_custkey AS slug, o_orderstatus AS status, o_orderkey AS seq FROM orders) QUALIFY row_number() OVER (PARTITION BY slug ORDER BY seq DESC) = 1")
def src07(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "converted").when(F.col("o_orderstatus") == "P", "strange").otherwise("failed")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("slug"), status.alias("status"), F.col("o_orderkey").alias("seq"))
    nameless = rows.limit(3).withColumn("slug", F.lit(""))
    return C.upsert_state(rows.where("seq % 2 = 0").unionByName(nameless), rows.where("seq % 2 = 1"))


@register("src10_index_status", "SELECT doc_id, quality = 1 AS built, CASE WHEN quality = 1 THEN doc_id + 1 ELSE 0 END::BIGINT AS chunks FROM labels")
def src10(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, F.col("doc_id") + 1).alias("chunk_count"))
    return C.index_status(meta).select("doc_id", "built", F.col("chunk_count").alias("chunks"))


@register("src13_corpus_signature", f"WITH {FILES} SELECT source AS project, count(*)::BIGINT AS files, md5(count(*) || ':' || sum(('0x' || left(md5(path), 15))::BIGINT::HUGEINT) || ':' || sum(('0x' || substr(md5(path), 17, 15))::BIGINT::HUGEINT) || ':c' || max(length(source)) % 3) AS signature, max(length(source)) % 3 <> 0 OR max(doc_id) % 7 = 0 AS rebuild FROM files JOIN documents USING (doc_id) GROUP BY source")
def src13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as projects, whose commits are named by the length of their names; signatures were stored when all had
    commit c0, and without its last file where that has an id divisible by seven."""
    rows = files(spark, sf_dir).select(F.substring_index("path", "/", 1).alias("project"), "path", "doc_id").withColumn("head", F.concat(F.lit("c"), F.length("project") % 3))
    last = rows.groupBy("project").agg(F.max("doc_id").alias("doc_id")).where("doc_id % 7 = 0")
    before = rows.join(last, ["project", "doc_id"], "left_anti").withColumn("head", F.lit("c0"))
    return C.rebuild_flags(C.corpus_signature(rows, head="head"), C.corpus_signature(before, head="head"))


@register("agg05_tree_rollup", "WITH f AS (SELECT source, lang, doc_id FROM documents) SELECT 'all' AS project, dir, count(*)::BIGINT AS total, sum((doc_id % 2 = 0)::INTEGER)::BIGINT AS selected FROM (SELECT unnest(['', source, source || '/' || lang]) AS dir, doc_id FROM f) GROUP BY dir")
def agg05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tree_rollup(files(spark, sf_dir).select(F.lit("all").alias("project"), "path", (F.col("doc_id") % 2 == 0).alias("selected")))


@register("top04_ordered_paths", f"WITH {FILES} SELECT path, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY path)::BIGINT AS place FROM files")
def top04(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = files(spark, sf_dir).select(F.substring_index("path", "/", 1).alias("project"), "path")
    return C.ordered_paths(docs, "project").select("path", "place")


_COLLATED = ["zebra", "Äpfel", "apfel", "Zoo", "éclair", "eclair", "_x", "Eclair"]


@register("top04_locale_order", f"""WITH n AS (SELECT doc_id, source AS project, ({_sql_list(_COLLATED)})[(doc_id % 8 + 1)::INTEGER] AS word FROM documents),
o AS (SELECT doc_id, project, word || '-' || lpad(doc_id::VARCHAR, 9, '0') AS path, ({_sql_list([str(x) for x in (7, 3, 2, 8, 6, 4, 1, 5)])})[(doc_id % 8 + 1)::INTEGER] AS k FROM n)
SELECT path, row_number() OVER (PARTITION BY project ORDER BY k, path)::BIGINT AS place FROM o""")
def top04_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accented and mixed-case paths as a reader expects them: marks first, accents and case only between equal letters."""
    word = F.element_at(F.array(*map(F.lit, _COLLATED)), (F.col("doc_id") % 8 + 1).cast("int"))
    docs = _docs(spark, sf_dir).select(F.col("source").alias("project"), F.concat(word, F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"))
    return C.ordered_paths(docs, "project", locale="UNICODE").select("path", "place")


@register("set03_merge_terms", f"WITH a AS (SELECT item_id AS query_id, {sql_tokens('text')} AS l FROM benchmark), h AS (SELECT query_id, l, l[1:len(l) // 2] AS own FROM a), b AS (SELECT query_id, list_concat(own, list_filter(l, lambda w: NOT list_contains(own, w) AND NOT list_contains({_sql_list(S.STOPWORDS)}, w))) AS m FROM h) SELECT query_id, array_to_string(m, ' ') AS terms FROM b")
def set03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of a query's tokens as its own terms, and all of them as generated ones."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.tokenize(F.col("text")).alias("l"))
    merged = S.merge_terms(F.slice("l", 1, F.floor(F.size("l") / 2).cast("int")), F.array_join("l", ", "))
    return rows.select("query_id", F.array_join(merged, " ").alias("terms"))


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as headed markdown: source and lang as headings, and every fifth line a deeper one."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 4, F.concat(F.lit("### "), x)).otherwise(x))
    return _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n## "), "lang", F.lit("\n"), F.array_join(lines, "\n")).alias("text"))


HEADED = """lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
marked AS (SELECT *, i % 5 = 4 AND regexp_matches(line, '\\S') AS h, regexp_replace(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '\\s*#*$', '') AS title FROM lines),
numbered AS (SELECT *, 2 + sum(h::INTEGER) OVER w AS section_no, last(CASE WHEN h THEN title END IGNORE NULLS) OVER w AS deep FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
secs AS (SELECT doc_id, section_no, max(source || ' > ' || lang || coalesce(' > ' || deep, '')) AS heading_path, regexp_replace(string_agg(CASE WHEN i % 5 = 4 THEN '### ' || line ELSE line END, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS text FROM numbered WHERE NOT h GROUP BY ALL)"""


@register("win01_heading_paths", f"WITH {HEADED} SELECT doc_id, section_no::BIGINT AS section_no, heading_path FROM secs WHERE text <> ''")
def win01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sections(C.doc_lines(headed(spark, sf_dir))).select("doc_id", F.col("section_no").cast("bigint").alias("section_no"), "heading_path")


@register("win03_split_sections", f"WITH {HEADED} SELECT doc_id, section_no::BIGINT AS section_no, md5(text) AS digest FROM secs WHERE text <> ''")
def win03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sections(C.doc_lines(headed(spark, sf_dir))).select("doc_id", F.col("section_no").cast("bigint").alias("section_no"), F.md5("text").alias("digest"))


@register("win02_fence_state", "SELECT doc_id, unnest(range(0, 4 + len(string_split(text, chr(10)))))::INTEGER AS line_no, line_no BETWEEN 1 AND 2 OR line_no > 3 AS in_fence FROM documents")
def win02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fence of backticks that holds a line of tildes, then each text inside an open fence of tildes."""
    made = F.concat(F.lit("```\n~~~ not its end\n```\n~~~\n"), "text")
    return C.doc_lines(_docs(spark, sf_dir).select("doc_id", made.alias("text"))).select("doc_id", F.col("line_no").cast("int").alias("line_no"), "in_fence")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.number_chunks(C.chunk_sections(C.sections(C.doc_lines(headed(spark, sf_dir)))))


@register("win04_chunk_sections")
def win04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_sections(C.sections(C.doc_lines(headed(spark, sf_dir))))


@register("win05_number_chunks")
def win05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("chunk_id", "doc_id", "chunk_index", "tokens")


@register("agg04_chunks_per_document")
def agg04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk counts written to those documents that have a state row."""
    counts = _chunks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    return table(spark, sf_dir, "labels").select("doc_id").join(counts, "doc_id")


@register("prj11_embed_input", f"WITH {HEADED} SELECT doc_id, section_no::BIGINT AS section_no, md5(heading_path || chr(10) || chr(10) || text) AS digest FROM secs WHERE text <> ''")
def prj11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.sections(C.doc_lines(headed(spark, sf_dir)))
    return rows.select("doc_id", F.col("section_no").cast("bigint").alias("section_no"), F.md5(C.embed_input(F.col("heading_path"), F.col("text"))).alias("digest"))
