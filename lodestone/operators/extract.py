"""Changes, commands, plans and failures out of tables of texts."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import paths as P
from lodestone.functions import text as T
from lodestone.sources.files import checkpointed

# How answers mark their parts.
HEADER = r"(?i)^\s*(?:#{1,6}\s*)?(?:\*\*)?\s*File\s*:\s*(.+?)\s*$"
DELETE = r"^\s*(?:#{1,6}\s*)?(?:\*\*)?\s*Delete\s*:\s*(.+?)\s*$"
COMMENT = r"^\s*(?://|#|<!--)\s*(?:File:)?\s*(.+?\.\w+)\s*(?:-->)?\s*$"
BACKTICKED = r"`([^`\n]*?\.[A-Za-z0-9]{1,12})`"
BOLD = r"\*\*([^*\n]*?\.[A-Za-z0-9]{1,12})\*\*"
PAIR = r"(?m)^<<<<<<< SEARCH[ \t]*\n((?s:.*?))^={7,}[ \t]*\n((?s:.*?))^>>>>>>> REPLACE"
FENCE = r"^ {0,3}(`{3,}|~{3,})"
# Languages that may stand alone above a file's text.
LANGUAGES = [
    "ts", "typescript", "tsx", "js", "javascript", "jsx", "mjs", "cjs", "py", "python", "rb", "ruby", "go", "rs", "rust",
    "java", "kt", "swift", "php", "cs", "c", "cpp", "h", "hpp", "css", "scss", "html", "vue", "svelte", "json", "yaml",
    "yml", "toml", "md", "markdown", "sh", "bash", "zsh", "sql", "xml", "ini", "env",
]


def section_body(text: Column, name: str) -> Column:
    """The body of a delimited or headed section; null where the section is absent, empty where it is blank."""
    opener = rf"(?im)^[ \t]*(?:={{2,}}\s*{name}\s*={{2,}}[ \t]*$|#{{1,6}}[^\n]*\b{name}\b[^\n]*$)\n?((?s:.*))"
    rest = F.regexp_extract(text, opener, 1)
    end = r"(?m)(?:^[ \t]*={6}[ \t]*$|^[ \t]*={2,}\s*[A-Za-z][A-Za-z ]*\s*={2,}[ \t]*$|^[ \t]*#{1,6}\s+\S)(?s:.*)"
    return F.when(text.rlike(opener), F.regexp_replace(rest, end, ""))


def files_section(text: Column) -> Column:
    """What holds the changes: the delimited Files section, else all before the first Explanation or Debug heading."""
    opened = F.regexp_extract(text, r"(?i)^(?:[ \t]*\n)*[ \t]*={2,}\s*Files\s*={2,}[ \t]*\n((?s:.*))", 1)
    closed = F.regexp_replace(opened, r"(?m)^[ \t]*={6}[ \t]*$(?s:.*)", "")
    heading = r"(?im)^[ \t]*(?:#{2,6}[^\n]*\b(?:Explanation|Debug)\b[^\n]*|={2,}\s*(?:Explanation|Debug)\s*={2,}[ \t]*)$(?s:.*)"
    return F.when(opened.rlike(r"(?m)^[ \t]*={6}[ \t]*$"), closed).otherwise(F.regexp_replace(text, heading, ""))


def clean_path(raw: Column) -> Column:
    """The last path-like word of a candidate, without quotes and leading ./ or /; null if it can't be a path."""
    plain = F.regexp_replace(F.regexp_replace(T.trimmed(raw), r"\\", "/"), "[`*\"']", "")
    words = F.filter(F.split(plain, r"\s+"), lambda w: w.rlike(r"\.\w+$"))
    last = F.regexp_replace(F.element_at(F.when(F.size(words) > 0, words), -1), r"^(?:\./|/)+|:$", "")
    return F.when((F.length(last) <= 512) & last.rlike(r"\.[^.]+$") & P.is_portable(last), last)


def code_blocks(responses: DataFrame) -> DataFrame:
    """(response_id, block_no, start_line, language, truncated, content, above) of fenced blocks in ``text``. A fence
    closes on its own character at the same length or more; one left open runs to the end and is marked. The fold
    runs over one text's fence lines; the content is then sliced out of its lines."""
    rows = responses.select("response_id", F.split("text", "\n").alias("lines"))
    fences = F.filter(
        F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, FENCE, 1).alias("mark"), T.trimmed(F.regexp_replace(x, FENCE, "")).alias("info"))),
        lambda f: f["mark"] != "",
    )
    block = "struct<start:int,stop:int,info:string,truncated:boolean>"
    start = F.struct(F.lit(-1).alias("at"), F.lit("").alias("mark"), F.lit("").alias("info"), F.array().cast(f"array<{block}>").alias("out"))

    def step(s: Column, f: Column) -> Column:
        closes = (s["at"] >= 0) & (f["info"] == "") & (F.left(f["mark"], F.lit(1)) == F.left(s["mark"], F.lit(1))) & (F.length(f["mark"]) >= F.length(s["mark"]))
        opens = s["at"] < 0
        made = F.struct(s["at"].alias("start"), f["i"].alias("stop"), s["info"].alias("info"), F.lit(False).alias("truncated"))
        keep = F.struct(F.when(opens, f["i"]).when(closes, F.lit(-1)).otherwise(s["at"]).alias("at"), F.when(opens, f["mark"]).otherwise(s["mark"]).alias("mark"), F.when(opens, f["info"]).otherwise(s["info"]).alias("info"), F.when(closes, F.concat(s["out"], F.array(made))).otherwise(s["out"]).alias("out"))
        return keep

    def finish(s: Column) -> Column:
        rest = F.struct(s["at"].alias("start"), F.lit(None).cast("int").alias("stop"), s["info"].alias("info"), F.lit(True).alias("truncated"))
        return F.when(s["at"] >= 0, F.concat(s["out"], F.array(rest))).otherwise(s["out"])

    found = rows.select("response_id", "lines", F.posexplode(F.aggregate(fences, start, step, finish)).alias("block_no", "b"))
    first, stop = F.col("b.start"), F.coalesce("b.stop", F.size("lines"))
    return found.select(
        "response_id",
        "block_no",
        first.alias("start_line"),
        F.regexp_extract("b.info", r"^([^\s(]+)", 1).alias("language"),
        F.col("b.truncated").alias("truncated"),
        F.array_join(F.slice("lines", first + 2, stop - first - 1), "\n").alias("content"),
        F.slice("lines", F.greatest(F.lit(1), first - 5), F.least(F.lit(6), first)).alias("above"),
    )


def resolve_paths(blocks: DataFrame) -> DataFrame:
    """path and path_source of blocks: the nearest header above, a comment in the first line, a backticked or bold
    path above, or none."""
    nearest = lambda p: F.element_at(F.filter(F.transform("above", lambda x: clean_path(F.nullif(F.regexp_extract(x, p, 1), F.lit("")))), lambda x: x.isNotNull()), -1)
    pick = lambda p: F.when(F.exists("above", lambda x: clean_path(F.nullif(F.regexp_extract(x, p, 1), F.lit(""))).isNotNull()), nearest(p))
    comment = clean_path(F.nullif(F.regexp_extract(F.substring_index("content", "\n", 1), COMMENT, 1), F.lit("")))
    rows = blocks.withColumns({"h": pick(HEADER), "c": comment, "t": pick(BACKTICKED), "b": pick(BOLD)})
    source = F.when(F.col("h").isNotNull(), "header").when(F.col("c").isNotNull(), "comment").when(F.col("t").isNotNull(), "backtick").when(F.col("b").isNotNull(), "bold").otherwise("unresolved")
    return rows.withColumn("path", F.coalesce("h", "c", "t", "b")).withColumn("path_source", source).drop("h", "c", "t", "b")


def lines_of(texts: DataFrame, key: str = "response_id") -> DataFrame:
    return texts.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def nearest_header(lines: DataFrame, key: str = "response_id") -> DataFrame:
    """For each fence line, the path of the nearest header in the six lines before it."""
    path = clean_path(F.nullif(F.regexp_extract("line", HEADER, 1), F.lit("")))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(-6, -1)
    return lines.withColumn("header", F.last(path, ignorenulls=True).over(before)).where(F.col("line").rlike(FENCE)).select(key, "line_no", "header")


def header_sections(responses: DataFrame) -> DataFrame:
    """(response_id, section_no, path, body) of what follows each File header, up to the next header or Delete line."""
    return all_sections(responses).where("path is not null").drop("named")


def all_sections(responses: DataFrame) -> DataFrame:
    """The same with what stands before the first header, and those whose header names no usable path: their path is
    null, and ``named`` says whether there is a header."""
    lines = lines_of(responses)
    mark = F.col("line").rlike(HEADER) | F.col("line").rlike(DELETE)
    order = Window.partitionBy("response_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("mark", mark).withColumn("section_no", F.sum(F.when(F.col("mark"), 1).otherwise(0)).over(order))
    named = rows.groupBy("response_id", "section_no").agg(
        F.max(F.when(F.col("mark"), F.regexp_extract("line", HEADER, 1))).alias("raw"),
        F.array_sort(F.collect_list(F.when(~F.col("mark"), F.struct("line_no", "line")))).alias("ls"),
    )
    body = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    return named.select("response_id", "section_no", clean_path(F.nullif("raw", F.lit(""))).alias("path"), body.alias("body"), (F.coalesce("raw", F.lit("")) != "").alias("named"))


def plain_blocks(parts: DataFrame) -> DataFrame:
    """Sections without fences or patch marks as whole files that end in a line end: a first line that names a language,
    in brackets or by a known name alone, is left out, and so are blank lines at both ends."""
    plain = parts.where(~F.col("body").rlike(r"(?m)^ {0,3}(?:`{3,}|~{3,})") & ~F.col("body").rlike(r"(?m)^<<<<<<< SEARCH"))
    bare = lambda c: F.regexp_replace(c, r"^(?:[^\S\n]*\n)+|(?:\n[^\S\n]*)+$", "")
    rows = plain.select("response_id", "section_no", "path", bare(F.regexp_replace("body", r"\r\n", "\n")).alias("body"))
    first = T.trimmed(F.substring_index("body", "\n", 1))
    named = first.rlike(r"^\(.*\)$") | F.lower(F.translate(first, "()", "")).isin(LANGUAGES)
    rest = F.when(named, bare(F.regexp_replace("body", r"^[^\n]*\n?", ""))).otherwise(F.col("body"))
    return rows.withColumn("body", rest).where(T.trimmed(F.col("body")) != "").select("response_id", "section_no", "path", F.concat("body", F.lit("\n")).alias("content"))


def patch_pairs(parts: DataFrame) -> DataFrame:
    """(response_id, section_no, path, pair_no, search, replace) inside header sections; an empty search is rejected."""
    less = lambda c: F.regexp_replace(c, r"\n$", "")
    pairs = F.arrays_zip(F.regexp_extract_all("body", F.lit(PAIR), F.lit(1)).alias("s"), F.regexp_extract_all("body", F.lit(PAIR), F.lit(2)).alias("r"))
    rows = parts.select("response_id", "section_no", "path", F.posexplode(pairs).alias("pair_no", "p"))
    return rows.select("response_id", "section_no", "path", "pair_no", less(F.col("p.s")).alias("search"), less(F.col("p.r")).alias("replace")).where("search <> ''")


def delete_directives(responses: DataFrame) -> DataFrame:
    """(response_id, path) of Delete lines outside fenced blocks."""
    outside = F.regexp_replace("text", r"(?m)^ {0,3}(`{3,}|~{3,})(?s:.*?)(?:^ {0,3}\1[`~]*[ \t]*$|\z)", "")
    lines = lines_of(responses.select("response_id", outside.alias("text")))
    raw = F.nullif(F.regexp_extract("line", DELETE, 1), F.lit(""))
    return lines.select("response_id", clean_path(raw).alias("path")).where("path is not null").distinct()


def drop_delete_collisions(deletes: DataFrame, writes: DataFrame) -> DataFrame:
    """Deletes of paths that the same response doesn't also write."""
    return deletes.join(writes.select("response_id", "path").distinct(), ["response_id", "path"], "left_anti")


def parse_changes(responses: DataFrame) -> DataFrame:
    """(response_id, strategy, kind, path, content, truncated) of answers (response_id, text).

    All extractors run as tables over the part that holds changes; each response then keeps those of the first
    strategy that found something: patches (with whole files beside them), fenced files, plain sections, deletes.
    """
    part = responses.select("response_id", files_section(F.col("text")).alias("text"))
    sections = header_sections(part)
    pairs = patch_pairs(sections)
    patches = pairs.groupBy("response_id", "path").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pair_no", "search", "replace"))), lambda x: F.struct(x["search"].alias("search"), x["replace"].alias("replace")))).alias("content"))
    full = resolve_paths(code_blocks(part)).where("path is not null").groupBy("response_id", "path").agg(F.min_by(F.struct("content", "truncated"), "block_no").alias("f"))
    plain = plain_blocks(sections).groupBy("response_id", "path").agg(F.min_by("content", "section_no").alias("content"))
    deletes = delete_directives(part)
    entry = lambda df, rank, kind, content, truncated: df.select("response_id", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), "path", content.alias("content"), truncated.alias("truncated"))
    no = F.lit(False)
    found = entry(patches, 1, "patch", F.col("content"), no).unionByName(entry(full, 2, "full", F.col("f.content"), F.col("f.truncated"))).unionByName(entry(plain, 3, "full", F.col("content"), no)).unionByName(entry(drop_delete_collisions(deletes, patches.select("response_id", "path").unionByName(full.select("response_id", "path"))), 4, "delete", F.lit(None).cast("string"), no))
    best = F.min("rank").over(Window.partitionBy("response_id"))
    kept = found.withColumn("best", best).where("rank = best or (rank = 2 and best = 1) or (rank = 4 and best < 4)")
    strategy = F.when(F.col("best") == 1, "patch").when(F.col("best") == 2, "markdown").when(F.col("best") == 3, "plaintext").otherwise("delete")
    return kept.select("response_id", strategy.alias("strategy"), "kind", "path", "content", "truncated")


def parse_report(responses: DataFrame, changes: DataFrame) -> DataFrame:
    """(response_id, strategy, entries, truncated, dropped, rejected, open_lines): responses without an entry are left to
    the user. Dropped are fenced blocks without a path in an answer of fenced files; rejected are sections of patches
    or plain files whose path is missing or unusable; open_lines are the lines (from 1) of fences that never close."""
    part = checkpointed(responses.select("response_id", files_section(F.col("text")).alias("text")))
    blocks = resolve_paths(code_blocks(part)).groupBy("response_id").agg(F.count_if(F.col("path").isNull()).alias("loose"))
    lost = all_sections(part).where("path is null")
    pair = F.col("body").rlike(PAIR)
    plain = F.col("named") & ~pair & ~F.col("body").rlike(r"(?m)^ {0,3}(?:`{3,}|~{3,})") & (T.trimmed(F.col("body")) != "")
    lost = lost.groupBy("response_id").agg(F.count_if(pair).alias("lost_patches"), F.count_if(plain).alias("lost_plain"))
    open_ = code_blocks(responses.select("response_id", "text")).where("truncated").groupBy("response_id").agg(F.array_sort(F.collect_list(F.col("start_line") + 1)).alias("open_lines"))
    per = changes.groupBy("response_id").agg(F.first("strategy").alias("strategy"), F.count("*").alias("entries"), F.count_if("truncated").alias("truncated"))
    rows = responses.select("response_id").join(per, "response_id", "left")
    for more in (blocks, lost, open_):
        rows = rows.join(more, "response_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    rejected = F.when(F.col("strategy") == "patch", F.col("lost_patches")).when(F.col("strategy") == "plaintext", F.col("lost_plain"))
    return rows.select(
        "response_id",
        F.coalesce("strategy", F.lit("user-assisted")).alias("strategy"),
        count(F.col("entries")).alias("entries"),
        count(F.col("truncated")).alias("truncated"),
        count(F.when(F.col("strategy") == "markdown", F.col("loose"))).alias("dropped"),
        count(rejected).alias("rejected"),
        F.coalesce("open_lines", F.array().cast("array<int>")).alias("open_lines"),
    )


# What is no command in a section without fences.
NO_COMMAND = r"(?i)^(?:to\s|you\s|run\s|first\s|then\s|please\s|after\s|if\s|note:)"


def debug_commands(responses: DataFrame) -> DataFrame:
    """(response_id, ord, command) of the Debug section: the lines of its fenced blocks; in a section without a closed
    block, lines after a $ and those that don't read like prose. Comments, blank lines and None are left out."""
    rest = F.regexp_extract("text", r"(?im)^[ \t]*(?:={2,}\s*Debug\s*={2,}[ \t]*$|#{1,6}[^\n]*\bDebug\b[^\n]*$)\n?((?s:.*))", 1)
    body = F.nullif(F.regexp_replace(rest, r"(?m)^[ \t]*={6}[ \t]*$(?s:.*)", ""), F.lit(""))  # a comment is no heading here
    blocks = F.regexp_extract_all("body", F.lit(r"```(?:[a-zA-Z0-9_-]+)?\s*\r?\n([\s\S]*?)```"), F.lit(1))
    rows = responses.select("response_id", body.alias("body")).where("body is not null").select("response_id", "body", blocks.alias("blocks"))
    rows = rows.select("response_id", (F.size("blocks") > 0).alias("fenced"), F.when(F.size("blocks") > 0, F.array_join("blocks", "\n")).otherwise(F.col("body")).alias("part"))
    lines = rows.select("response_id", "fenced", F.posexplode(F.split("part", r"\r?\n")).alias("n", "line")).withColumn("s", T.trimmed(F.col("line")))
    lines = lines.where((F.col("s") != "") & ~F.col("s").rlike(r"^#|^//") & ~F.col("s").rlike(r"(?i)^none\.?$"))
    prose = F.endswith("s", F.lit(":")) | (~F.startswith("s", F.lit("$ ")) & (F.col("s").rlike(NO_COMMAND) | F.contains("s", F.lit(" should ")) | F.contains("s", F.lit(" would "))))
    kept = lines.where(F.col("fenced") | ~prose).select("response_id", "n", T.trimmed(F.regexp_replace("s", r"^\$\s+", "")).alias("command")).where("command <> ''")
    order = Window.partitionBy("response_id").orderBy("n")
    return kept.select("response_id", (F.row_number().over(order) - 1).alias("ord"), "command")


def plan_steps(responses: DataFrame) -> DataFrame:
    """(response_id, step_id, status, title) of the Plan section's check boxes and numbered lines."""
    lines = lines_of(responses.select("response_id", section_body(F.col("text"), "Plan").alias("text")).where("text is not null"))
    box = F.regexp_extract("line", r"^\s*[-*]?\s*\[(.)\]\s*(.+?)\s*$", 1)
    title = F.coalesce(F.nullif(F.regexp_extract("line", r"^\s*[-*]?\s*\[.\]\s*(.+?)\s*$", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"^\s*\d+[.)]\s+(.+?)\s*$", 1), F.lit("")))
    status = F.when(F.lower(box) == "x", "done").when(box.isin(">", "~"), "active").when(box == "!", "blocked").otherwise("pending")
    rows = lines.select("response_id", "line_no", title.alias("title"), status.alias("status")).where("title is not null")
    n = F.row_number().over(Window.partitionBy("response_id").orderBy("line_no"))
    return rows.select("response_id", F.concat(F.lit("step-"), n).alias("step_id"), "status", "title")


def needed_paths(responses: DataFrame) -> DataFrame:
    """(response_id, path) of the Need section: one path a line, without bullets, backticks or words for none."""
    lines = lines_of(responses.select("response_id", section_body(F.col("text"), "Need").alias("text")).where("text is not null"))
    raw = T.trimmed(F.regexp_replace("line", r"^\s*[-*]\s*|`", ""))
    return lines.select("response_id", clean_path(F.when(~F.lower(raw).isin("none", "n/a", "nothing", "no", "nope", "-", ""), raw)).alias("path")).where("path is not null").distinct()


# The shapes of failures in compiler and test output.
TSC = r"^(\S+?)\((\d+),\d+\):\s*error\s+(TS\d+:.*)$"
LINT = r"^(\S+?):(\d+):(\d+)\s+(error|warning)\s+(.*)$"
FAIL = r"^(?:FAIL|✕|×)\s+(.+)$"
PYTEST = r"^FAILED\s+(\S+?)(?:::(.+?))?(?:\s+-\s+(.*))?$"


def parse_failures(logs: DataFrame) -> DataFrame:
    """(log_id, file, line, test, message) of compiler and test output (log_id, text): the first shape that a line
    matches counts, and equal failures of a log count once, at their first line. Lines without a shape's word never
    meet its pattern, and one that matches is taken apart in a single pass."""
    rows = lines_of(logs.select(F.col("log_id"), T.strip_ansi(F.col("text")).alias("text")), "log_id")
    # what is made from a line goes through a generator: Spark would otherwise put its patterns in place of each use
    only = lambda c: F.explode(F.array(c))
    worded = functools.reduce(Column.__or__, [F.contains("line", F.lit(w)) for w in ("error", "warning", "FAIL", "✕", "×")])
    rows = rows.where(worded).select("log_id", "line_no", only(T.trimmed(F.replace("line", F.lit("\r"), F.lit("")))).alias("s"))
    # the groups of a match behind one another; a mark that no line holds parts them
    cut = lambda p, groups: F.when(F.col("s").rlike(p), F.split(F.regexp_replace("s", p, "\u0001".join(f"${g}" for g in groups)), "\u0001", -1))
    first = (
        F.when(F.contains("s", F.lit("): error TS")) | F.col("s").rlike(r"\):\s*error\s"), F.struct(F.lit("tsc").alias("shape"), cut(TSC, (1, 2, 3)).alias("g")))
        .when(F.startswith("s", F.lit("FAILED")), F.struct(F.lit("pytest").alias("shape"), cut(PYTEST, (1, 2, 3)).alias("g")))
        .when(F.col("s").rlike("^(?:FAIL|✕|×)"), F.struct(F.lit("fail").alias("shape"), cut(FAIL, (1,)).alias("g")))
    )
    rows = rows.select("log_id", "line_no", "s", only(first).alias("m"))
    lint = F.struct(F.lit("lint").alias("shape"), cut(LINT, (1, 2, 4, 5)).alias("g"))
    last = F.when(F.col("m.g").isNotNull(), F.col("m")).when(F.col("s").rlike(r":\d+:\d+\s"), lint)
    rows = rows.select("log_id", "line_no", "s", only(last).alias("m")).where("m.g is not null")
    g = lambda k: F.get("m.g", F.lit(k))
    shape = lambda file, line, test, message: F.struct(file.alias("file"), line.cast("bigint").alias("line"), test.alias("test"), message.alias("message"))
    null, body, kind = F.lit(None).cast("string"), F.split(g(0), " > "), F.col("m.shape")
    rest = F.array_join(F.slice(body, 2, F.size(body)), " > ")
    found = (
        F.when(kind == "tsc", shape(g(0), g(1), null, T.trimmed(g(2))))
        .when(kind == "lint", shape(g(0), g(1), null, F.concat(g(3), F.lit(" ("), g(2), F.lit(")"))))
        .when(kind == "fail", shape(body[0], null, F.when(rest != "", rest).otherwise(body[0]), g(0)))
        .otherwise(shape(g(0), null, F.nullif(g(1), F.lit("")), F.when(g(2) != "", g(2)).otherwise(F.col("s"))))
    )
    hits = rows.withColumn("f", found).groupBy("log_id", "f").agg(F.min("line_no").alias("line_no"))
    return hits.select("log_id", "line_no", "f.file", "f.line", "f.test", "f.message")


# Dependencies and declarations by family of languages.
IMPORTS = {
    "typescript": r"""(?m)^\s*import\s+(?:[\s\S]*?)\s+from\s+['"]([^'"]+)['"]""",
    "python": r"(?m)^\s*(?:from\s+|import\s+)([\w.]+)",
}
GO_IMPORTS = r"import\s*\(([\s\S]*?)\)"
EXPORT = r"(?m)^(?=(export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var|type|interface|enum|abstract\s+class)\s+[A-Za-z_$][\w$]*[\s\S]{0,400}))"
DECLARATIONS = {
    "python": r"(?m)^(?:async\s+)?def\s+\w+\s*\([^)]*\)[^:]*:",
    "go": r"(?m)^func\s+(?:\([^)]*\)\s+)?\w+\s*\([^)]*\)[^{]*",
    "rust": r"(?m)^(?:pub\s+)?(?:fn|struct|enum|trait|impl|mod)\s+\w+[^{;]*",
    "java": r"(?m)^(?:public|private|protected|internal)?\s*(?:static\s+)?(?:class|interface|enum|record)\s+\w+[^{]*|^\s*(?:public|private|protected|internal)?\s*(?:static\s+)?[\w<>\[\],\s]+\s+\w+\s*\([^)]*\)\s*(?:throws\s+[\w,\s]+)?",
    "c": r"(?m)^(?:class|struct|enum|union)\s+\w+[^{;]*|^[\w:<>~*&\s]+\s+\w+\s*\([^;{]*\)\s*(?:const\s*)?[;{]",
    "ruby": r"(?m)^\s*(?:def\s+\w+|class\s+\w+|module\s+\w+)[^\n]*",
    "php": r"(?m)^\s*(?:public|private|protected|static|abstract|final|\s)*(?:function\s+\w+|class\s+\w+|interface\s+\w+|trait\s+\w+)[^\n{]*",
    "shell": r"(?m)^\s*(?:function\s+)?\w+\s*\(\s*\)\s*\{[^\n]*|^\w+(?=\s*\(\))",
}
_BRACKET = re.compile(r"=>|[(<\[)>\];{]")


def cut_signature(text: str, most: int = 400) -> str:
    """A declaration up to what ends it outside brackets: a brace, or with it a semicolon or an arrow."""
    depth, end = 0, min(len(text), most)
    for m in _BRACKET.finditer(text[:end]):
        mark = m[0]
        if depth == 0 and mark in "{;=>" and mark != ">":
            end = m.start() if mark == "{" else m.end()
            break
        depth += 1 if mark in "(<[" else -1 if mark in (")", ">", "]", "=>") else 0
    return re.sub(r"\s*\{$", "", re.sub(r"\s+", " ", text[:end]).strip())


def _cut_signatures(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda found: [s for s in map(cut_signature, found) if s] if found is not None else None)


def skeletons(files: DataFrame, most: int = 40) -> DataFrame:
    """(path, deps, signatures) of source files (path, content): import specifiers and up to ``most`` declarations, by
    the family of the path's ending; other files have none. A short Python helper finds where the brackets of an
    export close; all else are Spark's own expressions."""
    kind, none = P.family(F.col("path")), F.array().cast("array<string>")
    rows = files.select("path", "content", kind.alias("kind"))
    every = lambda p, g=0: F.regexp_extract_all("content", F.lit(p), F.lit(g))
    go = F.regexp_extract_all(F.regexp_extract("content", GO_IMPORTS, 1), F.lit('"([^"]+)"'), F.lit(1))
    deps = F.when(F.col("kind") == "go", go)
    for name, p in IMPORTS.items():
        deps = deps.when(F.col("kind") == name, every(p, 1))
    tidy = lambda c: F.transform(c, lambda x: T.trimmed(F.regexp_replace(x, r"\s+", " ")))
    found = F.when(F.col("kind") == "typescript", F.pandas_udf(_cut_signatures, "array<string>")(F.slice(F.when(F.col("kind") == "typescript", every(EXPORT, 1)).otherwise(none), 1, most)))
    for name, p in DECLARATIONS.items():
        found = found.when(F.col("kind") == name, tidy(F.slice(every(p), 1, most)))
    return rows.select("path", F.array_distinct(F.coalesce(deps, none)).alias("deps"), F.coalesce(found, none).alias("signatures"))


def import_edges(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst), both ways, of relative imports that name a file: nine endings are tried, the first there wins."""
    endings = ["", ".ts", ".tsx", ".js", ".jsx", ".json", "/index.ts", "/index.tsx", "/index.js"]
    rows = parsed.select("path", F.explode("deps").alias("dep")).where("startswith(dep, '.')")
    parts = F.filter(F.split(F.concat_ws("/", F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "dep"), "/"), lambda x: (x != "") & (x != "."))
    flat = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    rows = rows.select("path", F.array_join(flat, "/").alias("base")).distinct()
    tries = rows.select("path", "base", F.posexplode(F.array(*map(F.lit, endings))).alias("n", "end")).withColumn("target", F.concat("base", "end"))
    there = tries.join(files.select(F.col("path").alias("target")), "target").groupBy("path", "base").agg(F.min_by("target", "n").alias("target"))
    one = there.where("path <> target").select(F.col("path").alias("src"), F.col("target").alias("dst"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


DATA_URI = r"!\[[^\]]*\]\(data:image/([a-z+]+);base64,([^)]*)\)"


def _figure_parts(text: Column) -> Column:
    """A text as parts (before, mark, kind, data): what stands before each inline image, its mark up to the link, its
    kind and what it decodes to, null where it doesn't; the last part holds what follows them all."""
    marks = F.regexp_extract_all(text, F.lit(DATA_URI), F.lit(0))
    between = F.split(text, DATA_URI, -1)
    pairs = F.zip_with(between, marks, lambda b, m: F.struct(b.alias("before"), m.alias("mark")))
    return F.transform(
        pairs,
        lambda p: F.struct(
            p["before"].alias("before"),
            p["mark"].alias("mark"),
            F.regexp_extract(p["mark"], DATA_URI, 1).alias("kind"),
            F.try_to_binary(F.nullif(F.regexp_extract(p["mark"], DATA_URI, 2), F.lit("")), F.lit("base64")).alias("data"),
        ),
    )


def _ending(kind: Column) -> Column:
    return F.when(kind == "jpeg", "jpg").when(kind == "svg+xml", "svg").otherwise(kind)


def data_uri_figures(docs: DataFrame) -> DataFrame:
    """(doc_id, figure_no, file, data) of inline base64 images that decode, numbered in each document from 1."""
    rows = docs.select("doc_id", F.posexplode(F.filter(_figure_parts(F.col("text")), lambda p: p["data"].isNotNull())).alias("n", "f"))
    no = F.col("n") + 1
    return rows.select("doc_id", no.alias("figure_no"), F.concat(F.lit("figure-"), no, F.lit("."), _ending(F.col("f.kind"))).alias("file"), "f.data")


def rewrite_figure_links(docs: DataFrame, folder: str = "figures") -> DataFrame:
    """(doc_id, text) with the link of each image that decodes turned to its file, as data_uri_figures names it, below
    ``folder``; those that don't decode stay as they are and have no number."""
    step = lambda s, p: T.once(
        F.struct((s["n"] + F.when(p["data"].isNotNull(), 1).otherwise(0)).alias("n"), p.alias("p")),
        lambda x: F.struct(
            x["n"].alias("n"),
            F.concat(
                s["out"],
                F.coalesce(p["before"], F.lit("")),
                F.when(p["data"].isNotNull(), F.concat(F.regexp_extract(p["mark"], r"^(!\[[^\]]*\]\()", 1), F.lit(f"{folder}/figure-"), x["n"], F.lit("."), _ending(p["kind"]), F.lit(")"))).otherwise(F.coalesce(p["mark"], F.lit(""))),
            ).alias("out"),
        ),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))
    return docs.select("doc_id", F.aggregate(_figure_parts(F.coalesce("text", F.lit(""))), start, step)["out"].alias("text"))


def read_json_rows(replies: DataFrame, key: str, row_schema: str, names: tuple[str, ...]) -> DataFrame:
    """The rows of the first list found under one of ``names`` in a reply's JSON, with their place."""
    schema = ", ".join(f"{n} array<struct<{row_schema}>>" for n in names)
    read = F.from_json(T.salvage_json(F.col("text")), schema)
    rows = F.coalesce(*[read[n] for n in names])
    return replies.select(key, F.posexplode(rows).alias("ord", "r")).select(key, "ord", "r.*")
