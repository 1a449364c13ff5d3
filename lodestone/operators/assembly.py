"""Prompts and listings: one row out for each query, project or session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import paths as P
from lodestone.functions import text as T
from lodestone.operators.corpus import ordered_paths
from lodestone.sources.files import checkpointed


def ordered(order: str | Column, value: str | Column, sep: str) -> Column:
    """The values of a group joined in their order."""
    pairs = F.array_sort(F.collect_list(F.struct((F.col(order) if isinstance(order, str) else order).alias("o"), (F.col(value) if isinstance(value, str) else value).alias("v"))))
    return F.array_join(F.transform(pairs, lambda x: x["v"]), sep)


def tree_lines(files: DataFrame, by: str = "project") -> DataFrame:
    """(project, place, line): a tree of the paths with box characters, folders and files by name, a row for each line.
    A line is drawn from the flags of the nodes above it, and places come from ranges: no project meets in one task."""
    parts = F.split("path", "/")
    nodes = files.select(by, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("node")).distinct()
    nodes = nodes.withColumn("parent", F.regexp_extract("node", r"^(.*)/[^/]*$", 1))
    # a folder's last entry is its greatest; one row for each folder
    last = nodes.groupBy(by, "parent").agg(F.max("node").alias("node")).select(by, "node", F.lit(True).alias("is_last"))
    nodes = checkpointed(nodes.join(last, [by, "node"], "left").withColumn("is_last", F.coalesce("is_last", F.lit(False))))
    steps = F.split("node", "/")
    above = nodes.select(by, "node", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))).alias("depth", "up"))
    marks = above.join(nodes.select(by, F.col("node").alias("up"), "is_last"), [by, "up"])
    line = marks.groupBy(by, "node").agg(F.array_sort(F.collect_list(F.struct("depth", "is_last"))).alias("m"))
    n = F.size("m")
    indent = F.array_join(F.transform(F.slice("m", 1, n - 1), lambda x: F.when(x["is_last"], "    ").otherwise("│   ")), "")
    own = F.when(F.element_at("m", -1)["is_last"], "└── ").otherwise("├── ")
    line = line.select(by, F.regexp_replace("node", "/", "\u0001").alias("__node"), F.concat(indent, own, P.basename(F.col("node"))).alias("line"))
    return ordered_paths(line, by, "__node").select(by, "place", "line")


def tree_listing(files: DataFrame, by: str = "project") -> DataFrame:
    """(project, listing): the lines of tree_lines as one text, for projects that a prompt can hold."""
    return tree_lines(files, by).groupBy(by).agg(ordered("place", "line", "\n").alias("listing"))


def render_skeleton() -> Column:
    """A file's entry in the codebase map, from path, content, deps and signatures."""
    kind = P.classify_file(F.col("path"))
    deps = F.when(F.size("deps") > 0, F.concat(F.lit("\nimports: "), F.array_join(F.slice("deps", 1, 12), ", "))).otherwise("")
    signatures = F.when(F.size("signatures") > 0, F.array_join("signatures", "\n")).otherwise("(no declarations)")
    code = F.concat(F.lit("### "), "path", deps, F.lit("\n"), signatures)
    return F.when(kind == "asset", F.concat(F.lit("### "), "path")).when(kind == "code", code).otherwise(F.concat(F.lit("### "), "path", F.lit("\n"), T.preview(F.col("content"))))


def map_entries(skeletons: DataFrame, by: str = "project") -> DataFrame:
    """(project, place, path, entry): a project's map as a row for each file, in the order of the paths."""
    return ordered_paths(skeletons.select(by, "path", render_skeleton().alias("entry")), by).select(by, "place", "path", "entry")


def codebase_map(skeletons: DataFrame, by: str = "project") -> DataFrame:
    """(project, map, tokens): the entries of map_entries as one text, a blank line between them, for projects that a
    prompt can hold."""
    rows = skeletons.withColumn("entry", render_skeleton())
    return rows.groupBy(by).agg(ordered("path", "entry", "\n\n").alias("map")).withColumn("tokens", T.estimate_tokens(F.col("map")))


def map_tokens(skeletons: DataFrame, by: str = "project", per_token: float = T.CHARS_PER_TOKEN) -> DataFrame:
    """(project, tokens) of a project's map, from the lengths of its entries; the map itself isn't put together."""
    rows = skeletons.select(by, F.length(render_skeleton()).alias("n"))
    chars = F.sum("n") + 2 * (F.count("*") - 1)
    return rows.groupBy(by).agg(F.ceil(chars / F.lit(per_token)).cast("bigint").alias("tokens"))


def _paths(c: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(c, F.col("path"))))


def coding_prompt(picked: DataFrame, trees: DataFrame, contract: str, by: str = "project") -> DataFrame:
    """(project, prompt, skipped, sensitive, unreadable) from files (project, path, content, included) and their trees:
    included files are shown whole; among them those whose names look like secrets are reported, not dropped. Files
    beyond the budget and files without content are named."""
    rows = picked.withColumn("readable", F.col("content").isNotNull()).withColumn("shown", F.col("included") & F.col("readable"))
    fence = T.safe_fence(F.col("content"))
    text = F.concat(F.lit("File: "), "path", F.lit("\n"), fence, P.fence_language(F.col("path")), F.lit("\n"), "content", F.lit("\n"), fence)
    rows = rows.withColumn("text", F.when(F.col("shown"), text))
    per = rows.groupBy(by).agg(
        ordered("path", "text", "\n\n").alias("files"),
        _paths(~F.col("included") & F.col("readable")).alias("skipped"),
        _paths(F.col("shown") & P.is_sensitive(P.basename(F.col("path")))).alias("sensitive"),
        _paths(~F.col("readable")).alias("unreadable"),
    )
    return per.join(trees, by).select(by, F.concat("listing", F.lit("\n\n"), "files", F.lit("\n\n" + contract)).alias("prompt"), "skipped", "sensitive", "unreadable")


def full_document_prompt(docs: DataFrame, by: str = "request", chars: int = 400_000) -> DataFrame:
    entry = F.concat(F.lit("## "), "name", F.lit("\n\n"), T.truncate_document(F.col("text"), chars))
    return docs.withColumn("entry", entry).groupBy(by).agg(ordered("name", "entry", "\n\n").alias("prompt"), F.count("*").alias("documents"))


def preambles(hits: DataFrame, abstracts: DataFrame) -> DataFrame:
    """(query_id, document, abstract): one for each document among the hits."""
    return hits.select("query_id", "document").distinct().join(abstracts, "document").select("query_id", "document", "abstract")


def rag_prompt(questions: DataFrame, hits: DataFrame, abstracts: DataFrame) -> DataFrame:
    """(query_id, prompt, excerpts, documents): the question, one abstract for each source, numbered excerpts with
    document and heading. Queries without a question have no prompt."""
    head = F.when(F.coalesce("heading_path", F.lit("")) == "", "no heading").otherwise(F.col("heading_path"))
    excerpt = F.concat(F.lit("["), "rank", F.lit("] "), "document", F.lit(" — "), head, F.lit("\n"), "text")
    body = hits.withColumn("e", excerpt).groupBy("query_id").agg(ordered("rank", "e", "\n\n").alias("body"), F.count("*").alias("excerpts"), F.countDistinct("document").alias("documents"))
    lead = preambles(hits, abstracts).withColumn("a", F.concat("document", F.lit(": "), "abstract")).groupBy("query_id").agg(ordered("document", "a", "\n").alias("lead"))
    rows = questions.where("question is not null and trim(question) <> ''").join(body, "query_id").join(lead, "query_id", "left")
    return rows.select("query_id", F.concat(F.lit("Question: "), "question", F.lit("\n\nSources:\n"), F.coalesce("lead", F.lit("")), F.lit("\n\nExcerpts:\n"), "body").alias("prompt"), "excerpts", "documents")


def prompt_summary(prompts: DataFrame, hits: DataFrame, wanted: DataFrame, counter: Callable[[Column], Column] = T.estimate_tokens) -> DataFrame:
    """(query_id, tokens, documents, chunks, citations, unreadable) of finished prompts: citations by file name and
    heading; unreadable are the documents asked for (wanted: query_id, document, readable) that can't be read."""
    name = lambda c: P.basename(F.col(c))
    cites = hits.withColumn("c", F.concat(name("document"), F.lit(" > "), F.coalesce("heading_path", F.lit("")))).groupBy("query_id").agg(ordered("rank", "c", "; ").alias("citations"))
    lost = wanted.where("not readable").groupBy("query_id").agg(F.array_sort(F.collect_set("document")).alias("unreadable"))
    rows = prompts.join(cites, "query_id").join(lost, "query_id", "left")
    return rows.select("query_id", counter(F.col("prompt")).alias("tokens"), F.col("documents").alias("documents"), F.col("excerpts").alias("chunks"), "citations", F.coalesce("unreadable", F.array().cast("array<string>")).alias("unreadable"))


def fenced(text: Column) -> Column:
    fence = T.safe_fence(text)
    return F.concat(fence, F.lit("\n"), text, F.lit("\n"), fence)


def verification_text(stages: Column, failures: int = 25, lines: int = 40) -> Column:
    """Stages (stage, command, success, failures, output) as text: a failed one with its first ``failures`` failures
    (file, line, test, message), or the last ``lines`` lines of its output if none was read."""

    def failure(x: Column) -> Column:
        where = F.concat_ws(":", x["file"], x["line"].cast("string"))
        return F.concat(F.lit("- "), where, F.when(F.coalesce(x["test"], F.lit("")) != "", F.concat(F.lit(" "), x["test"])).otherwise(""), F.lit(": "), F.coalesce(x["message"], F.lit("")))

    def stage(r: Column) -> Column:
        head = F.concat(r["stage"], F.lit(" (`"), r["command"], F.lit("`) — "), F.when(r["success"], "PASSED").otherwise("FAILED"))
        out = F.split(F.coalesce(r["output"], F.lit("")), "\n")
        last = F.array_join(F.slice(out, F.greatest(F.lit(1), F.size(out) - lines + 1), lines), "\n")
        body = F.when(F.size(r["failures"]) > 0, F.array_join(F.transform(F.slice(r["failures"], 1, failures), failure), "\n")).otherwise(last)
        return F.when(r["success"], head).otherwise(F.concat(head, F.lit("\n"), body))

    return F.array_join(F.transform(stages, stage), "\n\n")


def turn_prompt(sessions: DataFrame, files: DataFrame, contract: str = "", by: str = "session_id") -> DataFrame:
    """(session_id, prompt, tokens, included, omitted) of sessions (session_id, turn, task, plan, decisions, applied,
    verification, nonce) and their files (session_id, path, content, outline, fate).

    In order, each where there is something to say: the task, the plan with its boxes, facts, what happened since the
    last turn, files whole with their hashes, outlines, files not shown, verification, what to do next, the contract
    and the nonce.
    """
    n_lines = F.size(F.split("content", "\n"))
    whole = F.concat(F.lit("### "), "path", F.lit(" · "), n_lines, F.lit(" lines · sha "), T.content_hash(F.col("content")), F.lit("\n\n"), fenced(F.col("content")))
    outline = F.concat(F.lit("### "), "path", F.lit("\n\n"), fenced(F.coalesce("outline", F.lit(""))))
    absent = F.concat(F.lit("- "), "path", F.lit(" ("), n_lines, F.lit(" lines)"))
    of = lambda fate, c: F.when(F.col("fate") == fate, c)
    listed = files.groupBy(by).agg(
        ordered("path", of("included", whole), "\n\n").alias("files"),
        ordered("path", of("outline", outline), "\n\n").alias("outlines"),
        ordered("path", of("omitted", absent), "\n").alias("absent"),
        _paths(F.col("fate") == "included").alias("included"),
        _paths(F.col("fate") == "omitted").alias("omitted"),
    )
    boxes = {"done": "[x]", "active": "[>]", "blocked": "[!]"}
    box = lambda status: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in boxes.items() for x in kv]), status), F.lit("[ ]"))
    plan = F.array_join(F.transform("plan", lambda p, i: F.concat(box(p["status"]), F.lit(" "), i + 1, F.lit(". "), p["text"])), "\n")
    failed = F.transform(F.filter("verification", lambda r: ~r["success"]), lambda r: r["stage"])
    since = F.concat_ws(
        "\n",
        F.when(F.size("applied") > 0, F.concat(F.lit("- applied: "), F.array_join("applied", ", "))),
        F.when(F.size("verification") > 0, F.when(F.size(failed) == 0, "- verification: all stages passed").otherwise(F.concat(F.lit("- verification: "), F.array_join(failed, ", "), F.lit(" FAILED")))),
    )
    part = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"## {title}\n\n"), c))
    rows = sessions.join(listed, by, "left")
    prompt = F.concat_ws(
        "\n\n",
        F.concat(F.lit("# Coding session — turn "), "turn"),
        part("Task", F.col("task")),
        part("Plan", plan),
        part("Project facts", F.array_join(F.transform("decisions", lambda d: F.concat(F.lit("- "), d)), "\n")),
        part("Since the last turn", since),
        part("Files — current on-disk content", F.col("files")),
        part("File outlines — signatures only", F.col("outlines")),
        part("Not shown — request with ===Need===", F.col("absent")),
        part("Verification output", F.when(F.size("verification") > 0, fenced(verification_text(F.col("verification"))))),
        part("Your next action", F.lit("Take the smallest step that advances the plan; ask for a file that is not shown with ===Need===.")),
        F.nullif(F.lit(contract), F.lit("")),
        part("Turn reference", F.col("nonce")),
    )
    none = F.array().cast("array<string>")
    rows = rows.withColumn("prompt", prompt)
    return rows.select(by, "prompt", T.estimate_tokens(F.col("prompt")).alias("tokens"), F.coalesce("included", none).alias("included"), F.coalesce("omitted", none).alias("omitted"))


def attach_figure_notes(docs: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, text): each note (doc_id, file, note) below the first line whose image has its file name; notes that
    no line refers to follow under Figures."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    image = lines.withColumn("file", P.basename(F.regexp_extract("line", r"!\[[^\]]*\]\(([^)\s]+)", 1))).where("file <> ''")
    first = image.groupBy("doc_id", "file").agg(F.min("n").alias("n"))
    placed = notes.join(first, ["doc_id", "file"]).select("doc_id", "n", F.lit(1).alias("k"), F.concat(F.lit("> "), "note").alias("line"))
    loose = notes.join(first, ["doc_id", "file"], "left_anti").groupBy("doc_id").agg(ordered("file", F.concat(F.lit("- "), "file", F.lit(": "), "note"), "\n").alias("rest"))
    rest = loose.select("doc_id", F.lit(1 << 30).alias("n"), F.lit(0).alias("k"), F.concat(F.lit("\n## Figures\n"), "rest").alias("line"))
    rows = lines.select("doc_id", "n", F.lit(0).alias("k"), "line").unionByName(placed).unionByName(rest)
    return rows.groupBy("doc_id").agg(ordered(F.struct("n", "k", "line"), "line", "\n").alias("text"))


def figure_cache_plan(figures: DataFrame, cache: DataFrame, provider: str, model: str) -> DataFrame:
    """(doc_id, file, reuse): a document's notes are reused only if provider and model match for all its figures."""
    known = cache.where((F.col("provider") == provider) & (F.col("model") == model)).select("doc_id", "file", F.lit(True).alias("known")).distinct()
    rows = figures.join(known, ["doc_id", "file"], "left")
    return rows.select("doc_id", "file", F.min(F.col("known").isNotNull()).over(Window.partitionBy("doc_id")).alias("reuse"))


def missing_figures(figures: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, missing, error) of documents some of whose figures (doc_id, file) still have no note (doc_id, file, note)
    after a run; the error names the first three."""
    done = notes.where("note is not null").select("doc_id", "file").distinct()
    left = figures.select("doc_id", "file").distinct().join(done, ["doc_id", "file"], "left_anti")
    first = F.array_sort(F.collect_set(F.col("file").cast("string")))
    per = left.groupBy("doc_id").agg(F.count("*").alias("missing"), first.alias("f"))
    return per.select("doc_id", "missing", F.concat("missing", F.lit(" image(s) without a description: "), F.array_join(F.slice("f", 1, 3), ", ")).alias("error"))
