"""Applying parsed changes to tables of file versions; nothing is written to disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

# A rewrite of at least this many lines to less than this share counts as a collapse.
COLLAPSE_LINES, COLLAPSE_SHARE = 40, 0.4


def apply_patches(content: Column, patches: Column) -> Column:
    """``content`` with each {search, replace} done once, in order, at its first exact place, or else at the first run
    of whole lines that are equal but for blanks at their ends; null if one of them is nowhere. Nothing outside the
    match changes, and what follows the last matched line stays."""

    def step(text: Column, p: Column) -> Column:
        at = F.position(p["search"], text)
        exact = F.concat(F.left(text, at - 1), p["replace"], F.substring(text, at + F.length(p["search"]), F.length(text)))
        return F.when(at > 0, exact).otherwise(T.once(F.split(text, "\n"), lambda lines: _by_lines(lines, p)))

    return F.aggregate(patches, content, step)


def _by_lines(lines: Column, p: Column) -> Column:
    """The patch at the first run of lines that match without blanks and carriage returns at their ends."""
    bare = lambda c: F.regexp_replace(c, r"[ \t]+$", "")
    n = F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0)  # a last newline opens no line
    want = F.transform(F.split(p["search"], r"\r?\n"), bare)
    m = F.size(want)

    def spliced(i: Column) -> Column:
        last = F.get(lines, i + m - 1)
        rest = F.when(F.endswith(last, F.lit("\r")) & (i + m < F.size(lines)), F.lit("\r")).otherwise("")
        return F.array_join(F.concat(F.slice(lines, 1, i), F.array(F.concat(p["replace"], rest)), F.slice(lines, i + m + 1, F.size(lines))), "\n")

    def found(have: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), n - m), lambda i: F.slice(have, i + 1, m) == want)
        return F.when((n >= m) & (F.size(starts) > 0), spliced(F.get(starts, F.lit(0))))

    return T.once(F.transform(lines, lambda x: bare(F.regexp_replace(x, r"\r$", ""))), found)


def is_collapse(old: Column, new: Column) -> Column:
    n = lambda c: F.size(F.split(c, "\n"))
    return (n(old) >= COLLAPSE_LINES) & (n(new) < COLLAPSE_SHARE * n(old))


def guard_changes(changes: DataFrame, files: DataFrame) -> DataFrame:
    """(response_id, path, issue, blocks): truncated, size-collapse or stale entries (with recorded hashes), and
    whether their response has any."""
    rows = changes.join(files.select("path", F.col("content").alias("old")), "path", "left")
    stale = F.col("recorded").isNotNull() & (F.col("recorded") != F.left(F.sha1("old"), F.lit(8)))
    issue = F.when(F.col("truncated"), "truncated").when((F.col("kind") == "full") & is_collapse(F.col("old"), F.col("content")), "size-collapse").when(stale, "stale")
    blocks = F.max(issue.isNotNull()).over(Window.partitionBy("response_id"))
    return rows.select("response_id", "path", issue.alias("issue"), blocks.alias("blocks"))


def apply_changes(files: DataFrame, changes: DataFrame, atomic: bool = False) -> DataFrame:
    """(batch_id, path, status, content): each change (batch_id, path, kind, content, patches) against the file
    versions (path, content). With ``atomic``, one failure in a batch skips all its other changes."""
    rows = changes.join(files.select("path", F.col("content").alias("old")), "path", "left")
    patched = apply_patches(F.col("old"), F.col("patches"))
    rows = rows.withColumn("new", F.when(F.col("kind") == "full", F.col("content")).when(F.col("kind") == "patch", patched))
    bad_path = F.col("path").rlike(r"(?:^|/)\.\.(?:/|$)")
    status = (
        F.when(bad_path, "failed")
        .when(F.col("kind") == "delete", "deleted")
        .when((F.col("kind") == "patch") & F.col("new").isNull(), "failed")
        .when((F.col("kind") == "full") & F.col("old").isNull(), "created")
        .when((F.col("kind") == "full") & is_collapse(F.col("old"), F.col("content")), "failed")
        .when(F.col("new") == F.col("old"), "skipped")
        .when(F.col("kind") == "patch", "patched")
        .otherwise("overwritten")
    )
    rows = rows.withColumn("status", status)
    if atomic:
        failed = F.max(F.col("status") == "failed").over(Window.partitionBy("batch_id"))
        rows = rows.withColumn("status", F.when(failed & (F.col("status") != "failed"), "skipped").otherwise(F.col("status")))
    done = F.col("status").isin("created", "overwritten", "patched")
    return rows.select("batch_id", "path", "status", F.when(done, F.col("new")).when(F.col("status") != "deleted", F.col("old")).alias("content"))


def diff_pairs(files: DataFrame, changes: DataFrame) -> DataFrame:
    rows = changes.join(files.select("path", F.col("content").alias("original")), "path", "left")
    return rows.select("response_id", "path", F.coalesce("original", F.lit("")).alias("original"), F.coalesce("content", F.lit("")).alias("proposed"), F.col("original").isNotNull().alias("exists"))


def repair_prompt(issues: DataFrame) -> DataFrame:
    """(response_id, prompt): one bullet for each issue, by path."""
    lines = F.array_sort(F.collect_list(F.when(F.col("issue").isNotNull(), F.concat(F.lit("- "), "path", F.lit(": "), "issue"))))
    return issues.groupBy("response_id").agg(F.array_join(lines, "\n").alias("prompt")).where("prompt <> ''")
