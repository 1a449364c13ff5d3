"""Registered queries of extraction and change application, on texts made from driver columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import changes as C
from lodestone.operators import extract as X
from lodestone.operators import ranking as R
from lodestone.plans.registry import register
from lodestone.plans.tables import table
from lodestone.sources import files as L

ANSWERS = "answers AS (SELECT conv_id * 1000 + turn AS response_id, conv_id, turn, text, (conv_id + turn) % 6 AS k, 'src/c' || conv_id || '/t' || turn || '.md' AS path FROM conversations WHERE role = 'assistant')"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistants' turns as answers of six kinds: full fence, patch, delete, plain section (some with a line that names a
    language), open fence, prose."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    path = F.concat(F.lit("src/c"), "conv_id", F.lit("/t"), "turn", F.lit(".md"))
    k = (F.col("conv_id") + F.col("turn")) % 6
    piece = (
        F.when(k == 0, F.concat(F.lit("File: "), path, F.lit("\n```md\n"), "text", F.lit("\n```")))
        .when(k == 1, F.concat(F.lit("**File:** `"), path, F.lit("`\n<<<<<<< SEARCH\nold\n=======\n"), "text", F.lit("\n>>>>>>> REPLACE")))
        .when(k == 2, F.concat(F.lit("Delete: "), path))
        .when(k == 3, F.concat(F.lit("## File: "), path, F.element_at(F.array(F.lit("\n\n"), F.lit("\npython\n\n"), F.lit("\n\n(some words)\n")), (F.col("conv_id") % 3 + 1).cast("int")), "text"))
        .when(k == 4, F.concat(F.lit("File: "), path, F.lit("\n~~~md\n"), "text"))
        .otherwise(F.concat(F.lit("Nothing to do in part "), "conv_id"))
    )
    tail = F.concat(F.lit("\n======\n===Explanation===\nwhy\n======\n===Debug===\n```bash\n# run\n$ npm test "), "conv_id", F.lit("\n```\n======\n===Plan===\n- [x] first\n2. second "), "turn", F.lit("\n======\n===Need===\n- `src/need"), "conv_id", F.lit(".md`\n- None\n======"))
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("response_id"), "conv_id", "turn", k.alias("k"), path.alias("path"), F.col("text").alias("body"), F.concat(F.lit("===Files===\n"), piece, tail).alias("text"))


@register("ext01_code_blocks", f"WITH {ANSWERS} SELECT response_id, 'md' AS language, k = 4 AS truncated, md5(text) AS digest FROM answers WHERE k IN (0, 4)")
def ext01(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = answers(spark, sf_dir).select("response_id", F.regexp_replace(X.files_section(F.col("text")), r"\n$", "").alias("text"))
    return X.code_blocks(part).select("response_id", "language", "truncated", F.md5("content").alias("digest"))


@register("ext02_resolve_paths", f"WITH {ANSWERS} SELECT response_id, path, 'header' AS path_source FROM answers WHERE k IN (0, 4)")
def ext02(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = answers(spark, sf_dir).select("response_id", X.files_section(F.col("text")).alias("text"))
    return X.resolve_paths(X.code_blocks(part)).select("response_id", "path", "path_source")


@register("win17_nearest_header", f"""WITH {ANSWERS} SELECT response_id, 1 AS line_no, path AS header FROM answers WHERE k IN (0, 4) UNION ALL
SELECT response_id, (2 + len(string_split(text, chr(10))))::INTEGER, CASE WHEN len(string_split(text, chr(10))) <= 4 THEN path END FROM answers WHERE k = 0""")
def win17(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = answers(spark, sf_dir).select("response_id", X.files_section(F.col("text")).alias("text"))
    return X.nearest_header(X.lines_of(part)).select("response_id", "line_no", "header")


@register("ext03_plain_blocks", f"WITH {ANSWERS} SELECT response_id, path, md5(text || chr(10)) AS digest FROM answers WHERE k = 3")
def ext03(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = answers(spark, sf_dir).select("response_id", X.files_section(F.col("text")).alias("text"))
    return X.plain_blocks(X.header_sections(part)).select("response_id", "path", F.md5("content").alias("digest"))


@register("ext04_patch_pairs", f"WITH {ANSWERS} SELECT response_id, path, 'old' AS search, text AS replace FROM answers WHERE k = 1")
def ext04(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = answers(spark, sf_dir).select("response_id", X.files_section(F.col("text")).alias("text"))
    return X.patch_pairs(X.header_sections(part)).select("response_id", "path", "search", "replace")


@register("ext05_delete_directives", f"WITH {ANSWERS} SELECT response_id, path FROM answers WHERE k = 2")
def ext05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.delete_directives(answers(spark, sf_dir).select("response_id", "text"))


CHANGES = f"{ANSWERS}, changes AS (SELECT response_id, CASE k WHEN 0 THEN 'markdown' WHEN 1 THEN 'patch' WHEN 2 THEN 'delete' WHEN 3 THEN 'plaintext' ELSE 'markdown' END AS strategy, CASE k WHEN 1 THEN 'patch' WHEN 2 THEN 'delete' ELSE 'full' END AS kind, path, k = 4 AS truncated FROM answers WHERE k <> 5)"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.parse_changes(answers(spark, sf_dir).select("response_id", "text"))


@register("ext06_parse_changes", f"WITH {CHANGES} SELECT * FROM changes")
def ext06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("response_id", "strategy", "kind", "path", "truncated")


@register("agg13_parse_report", f"WITH {CHANGES} SELECT a.response_id, coalesce(strategy, 'user-assisted') AS strategy, count(c.path)::BIGINT AS entries, count(*) FILTER (truncated)::BIGINT AS truncated, max((k = 0)::INTEGER)::BIGINT AS dropped, max((k IN (1, 3))::INTEGER)::BIGINT AS rejected, CASE WHEN max(k) = 4 THEN [3] ELSE [] END AS open_lines FROM answers a LEFT JOIN changes c USING (response_id) GROUP BY ALL")
def agg13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a fenced example far below any path, a patch for no path, or a plain section whose path is none."""
    more = (
        F.when(F.col("k") == 0, "\nSuch as:" + "\n" * 9 + "```\nshort\n```")
        .when(F.col("k") == 1, "\nFile: ???\n<<<<<<< SEARCH\na\n=======\nb\n>>>>>>> REPLACE")
        .when(F.col("k") == 3, "\nFile: nowhere\nbody")
        .otherwise("")
    )
    rows = answers(spark, sf_dir).select("response_id", F.concat(F.substring_index("text", "\n======\n===Explanation===", 1), more, F.lit("\n======\n===Explanation==="), F.substring_index("text", "\n======\n===Explanation===", -1)).alias("text"))
    return X.parse_report(rows, X.parse_changes(rows))


@register("set04_merge_entries", f"WITH {CHANGES} SELECT response_id, path, CASE kind WHEN 'delete' THEN 0 WHEN 'full' THEN 1 ELSE 2 END AS branch FROM changes")
def set04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response's entries in their order: deletes, whole files, patches."""
    rows = _changes(spark, sf_dir)
    branch = lambda kind, n: rows.where(F.col("kind") == kind).select("response_id", "path", F.lit(n).alias("branch"))
    return branch("delete", 0).unionByName(branch("full", 1)).unionByName(branch("patch", 2))


@register("jon16_drop_delete_collisions", f"WITH {ANSWERS} SELECT response_id, path FROM answers WHERE turn % 4 <> 1")
def jon16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer deletes its path; every fourth also writes it."""
    rows = answers(spark, sf_dir).select("response_id", "path", "turn")
    return X.drop_delete_collisions(rows.select("response_id", "path"), rows.where("turn % 4 = 1"))


@register("ext07_debug_commands", f"WITH {ANSWERS} SELECT response_id, 0 AS ord, 'npm test ' || conv_id AS command FROM answers")
def ext07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.debug_commands(answers(spark, sf_dir).select("response_id", "text"))


@register("ext08_session_sections", f"WITH {ANSWERS} SELECT response_id, 'step-1' AS id, 'done' AS status, 'first' AS what FROM answers UNION ALL SELECT response_id, 'step-2', 'pending', 'second ' || turn FROM answers UNION ALL SELECT response_id, 'need', 'need', 'src/need' || conv_id || '.md' FROM answers")
def ext08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).select("response_id", "text")
    steps = X.plan_steps(rows).select("response_id", F.col("step_id").alias("id"), "status", F.col("title").alias("what"))
    return steps.unionByName(X.needed_paths(rows).select("response_id", F.lit("need").alias("id"), F.lit("need").alias("status"), F.col("path").alias("what")))


@register("ext09_parse_failures", "SELECT l_orderkey AS log_id, 'src/p' || l_partkey || CASE WHEN l_linenumber % 5 = 0 THEN '.py' ELSE '.ts' END AS file, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_linenumber END::BIGINT AS line, CASE WHEN l_linenumber % 5 = 0 THEN 'test_' || l_suppkey || ' n' || l_linenumber END AS test, CASE WHEN l_linenumber % 5 = 0 THEN 'bad ' || l_returnflag ELSE 'TS' || l_suppkey || ': ' || l_returnflag END AS message FROM lineitem GROUP BY ALL")
def ext09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as compiler and test output; some repeated, some coloured."""
    n = F.col("l_linenumber")
    py = F.concat(F.lit("FAILED src/p"), "l_partkey", F.lit(".py::test_"), "l_suppkey", F.lit(" n"), n, F.lit(" - bad "), "l_returnflag")
    ts = F.concat(F.lit("\u001b[31msrc/p"), "l_partkey", F.lit(".ts("), n, F.lit(",1): error TS"), "l_suppkey", F.lit(": "), "l_returnflag", F.lit("\u001b[0m"))
    line = F.when(n % 5 == 0, py).otherwise(ts)
    twice = F.when(n % 3 == 0, F.concat(line, F.lit("\nnoise\n"), line)).otherwise(line)
    logs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("log_id")).agg(F.array_join(F.array_sort(F.collect_list(twice)), "\n").alias("text"))
    return X.parse_failures(logs).drop("line_no")


SOURCES = "sources AS (SELECT p_partkey AS k, replace(p_brand, '#', '') AS d, replace(p_brand, '#', '') || '/p' || p_partkey || '.ts' AS path FROM part)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, k = F.regexp_replace("p_brand", "#", ""), F.col("p_partkey")
    content = F.concat(F.lit("import x from './p"), k + 1, F.lit("'\nimport fs from \"node:fs\"\n\nexport function f"), k, F.lit("(a: number): string {\n  return '"), "p_name", F.lit("'\n}\nexport const c"), k, F.lit(" = 1;\n"))
    return table(spark, sf_dir, "part").select(k.alias("k"), F.concat(folder, F.lit("/p"), k, F.lit(".ts")).alias("path"), content.alias("content"))


@register("ext10_skeletons", f"WITH {SOURCES} SELECT path, './p' || (k + 1) || ',node:fs' AS deps, 'export function f' || k || '(a: number): string|export const c' || k || ' = 1;' AS signatures FROM sources")
def ext10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.skeletons(sources(spark, sf_dir)).select("path", F.array_join("deps", ",").alias("deps"), F.array_join("signatures", "|").alias("signatures"))


@register("jon04_import_edges", f"WITH {SOURCES}, e AS (SELECT a.path AS src, b.path AS dst FROM sources a JOIN sources b ON b.d = a.d AND b.k = a.k + 1) SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def jon04(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = sources(spark, sf_dir)
    return X.import_edges(X.skeletons(files), files)


@register("ext11_data_uri_figures", "SELECT doc_id, unnest([1, 2, 0]) AS figure_no, unnest(['figure-1.jpg', 'figure-2.png', 'text']) AS file, unnest([md5(text), md5(source), md5('a' || chr(10) || '![f](figures/figure-1.jpg)' || chr(10) || chr(10) || '![f](data:image/png;base64,*not base64*)' || chr(10) || chr(10) || '![f](figures/figure-2.png)' || chr(10) || text)]) AS digest FROM documents")
def ext11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two images that decode, one of them the whole text, and one that doesn't; then the rewritten text itself."""
    figure = lambda kind, c: F.concat(F.lit(f"\n![f](data:image/{kind};base64,"), c, F.lit(")\n"))
    coded = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "")
    text = F.concat(F.lit("a"), figure("jpeg", coded), figure("png", F.lit("*not base64*")), figure("png", F.base64("source")), "text")
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    figures = X.data_uri_figures(docs).select("doc_id", "figure_no", "file", F.md5("data").alias("digest"))
    return figures.unionByName(X.rewrite_figure_links(docs).select("doc_id", F.lit(0).alias("figure_no"), F.lit("text").alias("file"), F.md5("text").alias("digest")))


def _replies(spark: SparkSession, sf_dir: str, name: str, row: list) -> DataFrame:
    part = table(spark, sf_dir, "part")
    per = part.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct(*row))).alias(name))
    plain = F.to_json(F.struct(name))
    return per.select(F.col("p_brand").alias("query_id"), F.concat(F.lit("Here:\n```json\n"), F.regexp_replace(plain, r"\]\}$", ", ] }"), F.lit("\n```")).alias("text"))


@register("ext12_parse_verdicts", "SELECT p_brand AS query_id, 'p' || p_partkey AS path, least(3, p_size % 5)::DOUBLE AS score FROM part WHERE p_partkey % 2 = 0")
def ext12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that judge all parts, half of which are known."""
    row = [F.concat(F.lit("p"), "p_partkey").alias("path"), (F.col("p_size") % 5).cast("double").alias("score")]
    read = X.read_json_rows(_replies(spark, sf_dir, "results", row), "query_id", "path string, score double".replace(" ", ":", 1).replace(", score ", ",score:"), ("files", "results"))
    known = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("path"))
    return read.join(known, "path", "left_semi").select("query_id", "path", F.least(F.lit(3.0), F.greatest(F.lit(0.0), F.round("score"))).alias("score"))


@register("ext13_parse_descriptions", "SELECT p_brand AS query_id, 'f' || p_partkey || '.png' AS file, p_name AS description FROM part WHERE p_partkey % 2 = 0")
def ext13(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = [F.concat(F.lit("img/f"), "p_partkey", F.lit(".png")).alias("file"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(" ").alias("description")]
    read = X.read_json_rows(_replies(spark, sf_dir, "images", row), "query_id", "file:string,description:string", ("images",))
    return read.select("query_id", F.regexp_extract("file", r"([^/]*)$", 1).alias("file"), "description").where("trim(description) <> ''")


@register("src12_read_symbol_hits", "SELECT p_brand AS query_id, 'src/p' || p_partkey AS path, CASE WHEN p_size % 3 = 0 THEN 1 ELSE p_size END::DOUBLE AS score FROM part WHERE p_partkey % 4 <> 0")
def src12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as a bare list for even brands, else under results; some without a path or a score."""
    part = table(spark, sf_dir, "part")
    hit = F.struct(F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("src\\p"), "p_partkey")).alias("path"), F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("double")).alias("score"))
    per = part.groupBy("p_brand").agg(F.to_json(F.collect_list(hit)).alias("list"))
    text = F.when(F.col("p_brand").rlike("[02468]$"), F.col("list")).otherwise(F.concat(F.lit('{"results":'), "list", F.lit("}")))
    return R.read_symbol_hits(per.select(F.col("p_brand").alias("query_id"), text.alias("text")))


@register(
    "src08_read_commit_log",
    """WITH o AS (SELECT o_custkey % 25 AS project, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderkey DESC) - 1 AS seq FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) QUALIFY seq < 40)
SELECT project, seq::BIGINT AS seq, o AS commit, 'src/p' || l_partkey AS path, count(*)::BIGINT AS times FROM o JOIN lineitem ON l_orderkey = o GROUP BY ALL""",
)
def src08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log per project: a commit line for each order, its id padded to 240 digits, then its files with backslashes
    and blank lines."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    files = lines.select((F.col("o_custkey") % 25).alias("project"), F.col("l_orderkey").alias("o"), (F.col("l_linenumber") + 1).alias("n"), F.concat(F.lit("src\\p"), "l_partkey").alias("line"))
    heads = files.select("project", "o").distinct()
    marks = F.array(F.struct(F.lit(0).alias("n"), F.concat(F.lit("__C__"), F.lpad(F.col("o").cast("string"), 240, "0")).alias("line")), F.struct(F.lit(99).alias("n"), F.lit("  ").alias("line")))
    log = files.unionByName(heads.select("project", "o", F.inline(marks))).withColumn("line_no", F.struct("o", "n"))
    read = L.read_commit_log(log)
    return read.groupBy("project", "seq", F.col("commit").cast("bigint").alias("commit"), "path").agg(F.count("*").alias("times"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current contents: some absent, some long, some with the text that patches search for."""
    rows = answers(spark, sf_dir)
    content = F.when(F.col("k") == 0, F.array_join(F.array_repeat(F.lit("line"), 50), "\n")).when(F.col("k") == 1, F.concat(F.lit("head\nold\n"), "body")).when(F.col("k") == 3, F.concat("body", F.lit("\n"))).otherwise(F.col("body"))
    return rows.where("turn % 5 <> 3").select("path", content.alias("content"))


def _applied(spark: SparkSession, sf_dir: str, atomic: bool) -> DataFrame:
    patches = F.from_json(F.when(F.col("kind") == "patch", F.col("content")), "array<struct<search:string,replace:string>>")
    changes = _changes(spark, sf_dir).select((F.expr("response_id div 1000") if atomic else F.col("response_id")).alias("batch_id"), "path", "kind", "content", patches.alias("patches"))
    return C.apply_changes(_versions(spark, sf_dir), changes, atomic)


LINES = "len(string_split(text, chr(10)))"
APPLIED = f"""{ANSWERS}, applied AS (SELECT response_id, conv_id, path, CASE
  WHEN k = 2 THEN 'deleted' WHEN k = 1 AND turn % 5 = 3 THEN 'failed' WHEN k = 1 THEN 'patched' WHEN turn % 5 = 3 THEN 'created'
  WHEN k = 0 AND {LINES} < 20 THEN 'failed' WHEN k IN (0, 4) THEN 'overwritten' ELSE 'skipped' END AS status FROM answers WHERE k <> 5)"""


@register("chg04_apply_changes", f"WITH {APPLIED} SELECT conv_id AS batch_id, path, CASE WHEN bool_or(status = 'failed') OVER (PARTITION BY conv_id) AND status <> 'failed' THEN 'skipped' ELSE status END AS status FROM applied")
def chg04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark, sf_dir, True).select("batch_id", "path", "status")


@register("chg01_apply_patches", f"WITH {ANSWERS} SELECT path, md5('head' || chr(10) || text || chr(10) || text) AS digest FROM answers WHERE k = 1 AND turn % 5 <> 3")
def chg01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark, sf_dir, False).where("status = 'patched'").select("path", F.md5("content").alias("digest"))


@register("chg02_size_collapse", f"WITH {ANSWERS} SELECT path, {LINES} < 20 AS collapse FROM answers WHERE k = 0")
def chg02(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.array_join(F.array_repeat(F.lit("line"), 50), "\n")
    return answers(spark, sf_dir).where("k = 0").select("path", C.is_collapse(old, F.col("body")).alias("collapse"))


GUARDED = f"{ANSWERS}, guarded AS (SELECT response_id, path, CASE WHEN k = 4 THEN 'truncated' WHEN k = 0 AND turn % 5 <> 3 AND {LINES} < 20 THEN 'size-collapse' END AS issue FROM answers WHERE k <> 5)"


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.guard_changes(_changes(spark, sf_dir).withColumn("recorded", F.lit(None).cast("string")), _versions(spark, sf_dir))


@register("chg03_guard_changes", f"WITH {GUARDED} SELECT response_id, path, issue, issue IS NOT NULL AS blocks FROM guarded")
def chg03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guarded(spark, sf_dir)


@register("asm07_repair_prompt", f"WITH {GUARDED} SELECT response_id, '- ' || path || ': ' || issue AS prompt FROM guarded WHERE issue IS NOT NULL")
def asm07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repair_prompt(_guarded(spark, sf_dir))


@register("chg05_diff_pairs", f"WITH {ANSWERS} SELECT response_id, path, turn % 5 <> 3 AS exists, CASE WHEN k = 2 THEN '' ELSE 'new' END AS proposed FROM answers WHERE k <> 5")
def chg05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.diff_pairs(_versions(spark, sf_dir), _changes(spark, sf_dir))
    return rows.select("response_id", "path", "exists", F.when(F.col("proposed") == "", "").otherwise("new").alias("proposed"))
