"""The corpus: status of documents, sections under headings, chunks, and reuse of earlier work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import paths as P
from lodestone.functions import text as T
from lodestone.functions.chunking import chunk_ranges
from lodestone.sources.files import checkpointed


def scan_documents(docs: DataFrame, state: DataFrame, converted: DataFrame) -> DataFrame:
    """(path, status, error) of documents (path, name), with stored state (path, status, error) and converted paths.
    A format that can't be read fails; converted needs both the state and the converted text; its own error wins."""
    joined = docs.join(state.select("path", F.col("status").alias("was"), F.col("error").alias("own")), "path", "left")
    joined = joined.join(converted.select("path", F.lit(True).alias("there")), "path", "left")
    supported = P.is_supported_document(F.col("name"))
    status = F.when(~supported, "failed").when((F.col("was") == "converted") & F.coalesce("there", F.lit(False)), "converted").when(F.col("was") == "failed", "failed").otherwise("ready")
    return joined.select("path", status.alias("status"), F.coalesce("own", F.when(~supported, "unsupported format")).alias("error"))


def upsert_state(state: DataFrame, updates: DataFrame) -> DataFrame:
    """The last record (by seq) of each slug; records without a slug are dropped, unknown statuses become ready."""
    rows = state.unionByName(updates).where("slug is not null and slug <> ''")
    rows = rows.groupBy("slug").agg(F.max_by(F.struct("status", "seq"), "seq").alias("r"))
    status = F.when(F.col("r.status").isin("ready", "converted", "failed"), F.col("r.status")).otherwise("ready")
    return rows.select("slug", status.alias("status"), F.col("r.seq").alias("seq"))


def index_status(meta: DataFrame) -> DataFrame:
    """Adds built (has chunks) to index facts, whose chunk_count counts 0 where it is null."""
    count = F.coalesce("chunk_count", F.lit(0)).cast("bigint")
    return meta.withColumn("chunk_count", count).withColumn("built", count > 0)


def skipped_documents(wanted: DataFrame, converted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that were asked for but not converted: reported, not dropped."""
    return wanted.join(converted.select(key), key, "left_anti")


def ordered_paths(files: DataFrame, by: str = "project", order: str = "path", locale: str | None = None) -> DataFrame:
    """Each row's place among those with the same ``by``, from 1, by code points of ``order``, or as a ``locale`` has it
    (a collation such as UNICODE or fr; equal ones by code points). Rows are sorted into ranges and numbered inside them;
    what earlier ranges hold is added, so that no project's rows meet in one task."""
    if locale:
        key = F.struct(F.collate(order, locale).alias("l"), F.col(order).alias("c"))
        return ordered_paths(files.withColumn("__locale", key), by, "__locale").drop("__locale")
    ranged = files.repartitionByRange(by, order).sortWithinPartitions(by, order).withColumn("__part", F.spark_partition_id())
    ranged = checkpointed(ranged)
    within = F.row_number().over(Window.partitionBy(by, "__part").orderBy(order))
    sizes = ranged.groupBy(by, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(by, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    numbered = ranged.withColumn("__within", within).alias("r").join(sizes.alias("s"), F.col(f"r.{by}").eqNullSafe(F.col(f"s.{by}")) & (F.col("r.__part") == F.col("s.__part")))
    return numbered.select("r.*", "__base").withColumn("place", (F.col("__base") + F.col("__within")).cast("bigint")).drop("__part", "__within", "__base")


def corpus_signature(files: DataFrame, by: str = "project", head: str | None = None) -> DataFrame:
    """(project, files, signature): changes when the set of paths does or the latest commit, which the column ``head``
    names; no order, so no sort of a project's paths. Two sums of 60 bits of each path's digest stand for the set."""
    lanes = [F.sum(F.conv(F.substring(F.md5("path"), at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 17)]
    commit = [F.coalesce(F.max(head), F.lit(""))] if head else []
    return files.groupBy(by).agg(F.count("*").alias("files"), F.md5(F.concat_ws(":", F.count("*"), *lanes, *commit)).alias("signature"))


def rebuild_flags(signatures: DataFrame, stored: DataFrame, by: str = "project") -> DataFrame:
    """``signatures`` (project, signature, ...) with rebuild: whether the stored signature (project, signature) of what
    was built from them differs or is lacking."""
    was = stored.select(F.col(by).alias("__by"), F.col("signature").alias("__was"))
    both = signatures.join(was, F.col(by).eqNullSafe(F.col("__by")), "left")
    return both.withColumn("rebuild", F.coalesce(F.col("__was") != F.col("signature"), F.lit(True))).drop("__by", "__was")


def doc_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, in_fence, is_fence) from (doc_id, text). A fence opens on three or more backticks or
    tildes and closes on the same character; this is a fold over one document's fence lines."""
    rows = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    mark = lambda line: F.regexp_extract(line, r"^\s*(```+|~~~+)", 1)

    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda marks: list(fenced_ranges(marks)))

    # only lines that open or close a fence enter the fold, as (place, character); it gives ranges of lines
    marks = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.left(mark(x), F.lit(1)).alias("c"))), lambda m: m["c"] != "")
    ranges = F.when(F.size(marks) > 0, F.pandas_udf(fold, "array<struct<start:int,stop:int>>")(marks)).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))
    each = rows.withColumn("ranges", ranges).select("doc_id", "ranges", F.posexplode("lines").alias("line_no", "line"))
    inside = F.when(F.size("ranges") > 0, F.exists("ranges", lambda r: (r["start"] < F.col("line_no")) & (F.col("line_no") <= r["stop"]))).otherwise(False)
    return each.select("doc_id", "line_no", "line", inside.alias("in_fence"), (mark(F.col("line")) != "").alias("is_fence"))


def fenced_ranges(marks: list[dict]) -> Iterator[dict]:
    """For fence marks (place i, character c) in order: the lines after each opening up to its closing."""
    opened = None
    for m in marks:
        if opened is None:
            opened = m
        elif opened["c"] == m["c"]:
            yield {"start": opened["i"], "stop": m["i"]}
            opened = None
    if opened is not None:
        yield {"start": opened["i"], "stop": (1 << 31) - 1}


def sections(lines: DataFrame) -> DataFrame:
    """(doc_id, section_no, heading_path, text) between headings of # to ###### outside fences; empty ones dropped.

    A heading of level k is live while it is newer than the last heading of every lower level, so six running
    maxima give the path without a stack.
    """
    is_heading = ~F.col("in_fence") & ~F.col("is_fence") & F.col("line").rlike(r"^#{1,6}\s+.+")
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    title = T.trimmed(F.regexp_extract("line", r"^#{1,6}\s+(.+?)\s*#*\s*$", 1))
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("level", F.when(is_heading, level)).withColumn("title", F.when(is_heading, title))
    rows = rows.withColumn("section_no", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(order))
    for k in range(1, 7):
        rows = rows.withColumn(f"h{k}", F.max(F.when(F.col("level") == k, F.struct("line_no", "title"))).over(order))
    live = [F.when(F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"h{j}.line_no"), F.lit(-1)) for j in range(1, k)]) < F.col(f"h{k}.line_no"), F.col(f"h{k}.title")) for k in range(1, 7)]
    rows = rows.withColumn("heading_path", F.concat_ws(" > ", *live))
    body = rows.where("level is null").groupBy("doc_id", "section_no").agg(F.max("heading_path").alias("heading_path"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    text = T.trimmed(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    return body.select("doc_id", "section_no", "heading_path", text.alias("text")).where("text <> ''")


def chunk_sections(parts: DataFrame, tokens: int = 300, overlap: int = 50, counter: Callable[[Column], Column] = T.estimate_tokens) -> DataFrame:
    """(doc_id, section_no, heading_path, k, text, tokens): each section's sentences filled into chunks. A sentence is
    never cut; on overflow the last ones, up to ``overlap`` tokens, begin the next chunk. ``counter`` gives the tokens of
    a text column. The fold runs over one section's token counts in Arrow batches; the texts themselves are put
    together by Spark."""
    units = parts.withColumn("units", T.sentences(F.col("text")))
    units = units.withColumn("sizes", F.transform("units", counter))

    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda sizes: chunk_ranges([int(n) for n in sizes], tokens, overlap))

    ranges = F.pandas_udf(fold, "array<struct<start:int,stop:int,tokens:bigint>>")
    cut = units.select("doc_id", "section_no", "heading_path", "units", F.posexplode(ranges("sizes")).alias("k", "r"))
    text = T.trimmed(F.array_join(F.slice("units", F.col("r.start") + 1, F.col("r.stop") - F.col("r.start")), " "))
    return cut.select("doc_id", "section_no", "heading_path", "k", text.alias("text"), F.col("r.tokens").alias("tokens")).where("text <> ''")


def number_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_index over the whole document and chunk_id doc#index."""
    order = Window.partitionBy("doc_id").orderBy("section_no", "k")
    rows = chunks.withColumn("chunk_index", F.row_number().over(order) - 1)
    return rows.withColumn("chunk_id", F.concat_ws("#", "doc_id", "chunk_index"))


def embed_input(heading_path: Column, text: Column) -> Column:
    return F.when(F.coalesce(heading_path, F.lit("")) != "", F.concat(heading_path, F.lit("\n\n"), text)).otherwise(text)


def tree_rollup(files: DataFrame, by: str = "project") -> DataFrame:
    """(project, dir, total, selected) for every directory above a file, the root included, from (project, path, selected)."""
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.select(by, "selected", F.explode(dirs).alias("dir")).groupBy(by, "dir").agg(F.count("*").alias("total"), F.sum(F.col("selected").cast("bigint")).alias("selected"))
