"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import checkpointed, running_sum, text_keys

#: The fractional part of the golden ratio: multiples of it, modulo 1, spread evenly at every length.
GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source with source_size, source_no and target, from rows (source, size).

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all sizes. A target stops
    at ``most`` times its source's size and the excess is shared again by weight until none is above: all others
    then get one common multiple of their weight, found from running sums in the order of size over weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    no = F.row_number().over(order) - 1
    per = per.select("source", "source_size", no.cast("bigint").alias("source_no"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weights_left)
    # the first source in this order that the common level does not fill up sets it for all that follow
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "source_no", "level"))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(free["level"] * F.col("weight"), F.col("cap")))
    return per.select("source", "source_no", "source_size", target.alias("target"))


def schedule(targets: DataFrame, block: int, slots: int, chunk: int = 4096, cells: int = 4096) -> DataFrame:
    """The order of the mix: rows (slot, source_no, rank), with rank counting a source's slots from 0.

    Slot i takes the point frac(i * golden ratio) through the cumulative shares of the targets. Slots beyond a
    source's need are left out, and the few that chance left it short follow at the end of the schedule.
    """
    spark = targets.sparkSession
    cum = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per source
    ranges = targets.where("target > 0").withColumn("hi", F.sum("target").over(cum))
    total = F.max("hi").over(Window.partitionBy())
    ranges = ranges.select("source_no", ((F.col("hi") - F.col("target")) / total).alias("lo"), F.when(F.col("hi") == total, 1.0).otherwise(F.col("hi") / total).alias("hi"), F.ceil(F.col("target") / block).alias("need"))
    # points and shares meet in a grid over [0, 1), so that each point sees only the few sources of its cell
    grid = F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))).alias("cell")
    points = spark.range(slots).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN - F.floor(F.col("id") * GOLDEN)).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * cells))
    taken = points.join(ranges.select("source_no", "lo", "hi", "need", grid), "cell").where("lo <= x and x < hi")
    taken = taken.select("slot", "source_no", "need", F.lit(1).alias("one"), F.expr(f"slot div {chunk}").alias("chunk"))
    ranked = running_sum(taken, ["source_no"], ["slot"], "one", "chunk", "rank")
    counts = taken.groupBy("source_no").agg(F.count("*").alias("have"))
    short = ranges.join(counts, "source_no", "left").where(F.col("need") > F.coalesce("have", F.lit(0)))
    tail = short.select("source_no", F.explode(F.sequence(F.coalesce("have", F.lit(0)), F.col("need") - 1)).alias("rank"))
    tail = tail.select((F.lit(slots) + F.col("rank")).alias("slot"), "source_no", "rank")
    return ranked.where("rank < need").select("slot", "source_no", "rank").unionByName(tail)


def _placed(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, most: float, slots: int, block_words: int, parts: int, keep: tuple[str, ...]
) -> tuple[DataFrame, DataFrame]:
    """Documents with their place (uid, source_no, begin, size) in their source's stream of words, and the mix: rows
    (slot, source_no, uid, lap, begin, end), words ``begin`` to ``end`` of a document in its stream's repeat ``lap``."""
    extra = [F.col(c).alias(f"__keep_{c}") for c in keep]
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64(F.col(id_col), *text_keys(F.col(text_col)), F.lit(5)).alias("h"), text_keys(F.col(text_col))[1].alias("tie"), *extra)
    sized = checkpointed(sized)  # later steps don't read the texts again
    targets = checkpointed(source_targets(sized, weights, share, most))
    mixed = targets.agg(F.sum("target")).first()[0] or 0.0
    slots = max(slots, math.ceil(mixed / block_words))
    block = max(1, round(mixed / slots))
    slots = max(1, math.ceil(mixed / block))  # blocks have whole words
    rows = sized.join(targets.withColumnRenamed("source", "__s"), sized["source"].eqNullSafe(F.col("__s"))).drop("__s")
    # a hash range of each source's stream: parts hold few rows, however large a source is
    cuts = max(parts, sized.count() // 10_000)
    rows = rows.withColumn("part", F.floor((F.col("h") / 2.0**64 + 0.5) * cuts)).withColumn("uid", F.monotonically_increasing_id())
    placed = checkpointed(running_sum(rows, ["source_no"], ["h", "tie", "doc_id", "uid"], "size", "part", "begin"))
    chosen = schedule(targets, block, slots)
    # blocks of the stream and of its repeats, with the words that the target still allows in each
    spans = chosen.join(targets.select("source_no", "source_size", "target"), "source_no")
    lo, hi = F.col("rank") * block, F.least((F.col("rank") + 1) * block, F.round("target").cast("bigint"))
    spans = spans.select("slot", "source_no", "source_size", lo.alias("lo"), hi.alias("hi")).where("lo < hi")
    # a block may run over the stream's end into its repeat: each pass is a span of its own, in stream words
    lap = F.explode(F.sequence(F.expr("lo div source_size"), F.expr("(hi - 1) div source_size"))).alias("lap")
    spans = spans.select("slot", "source_no", "source_size", "lo", "hi", lap)
    spans = spans.select("slot", "source_no", "lap", F.greatest(F.lit(0), F.col("lo") - F.col("lap") * F.col("source_size")).alias("lo"), F.least("source_size", F.col("hi") - F.col("lap") * F.col("source_size")).alias("hi"))
    # documents meet spans in the grid of blocks that both fall into; a span lies in at most two cells
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / block), F.floor((F.col(b) - 1) / block)))
    spans = spans.withColumn("cell", cells("lo", "hi"))
    words = placed.where("size > 0").select("uid", "source_no", F.col("begin").alias("at"), (F.col("begin") + F.col("size")).alias("to")).withColumn("cell", cells("at", "to"))
    # inside a cell, each side keeps its part of it
    clip = lambda a, b: (F.greatest(F.col(a), F.col("cell") * block), F.least(F.col(b), (F.col("cell") + 1) * block))
    (s0, s1), (w0, w1) = clip("lo", "hi"), clip("at", "to")
    spans = spans.select("slot", "source_no", "lap", "cell", s0.alias("lo"), s1.alias("hi"))
    words = words.select("uid", "source_no", "cell", F.col("at").alias("first"), w0.alias("at"), w1.alias("to"))
    both = words.join(spans, ["source_no", "cell"]).where("greatest(at, lo) < least(to, hi)")
    begin, end = F.greatest("at", "lo") - F.col("first"), F.least("to", "hi") - F.col("first")
    return placed, both.select("slot", "source_no", "uid", "lap", begin.alias("begin"), end.alias("end"))


def mixed_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    slots: int = 1 << 18,
    block_words: int = 1 << 16,
    parts: int = 256,
) -> DataFrame:
    """The mix itself, in the order of ``slot``: rows (slot, source, lap, doc_id, begin, end), where ``begin`` to
    ``end`` are words of a document and ``lap`` counts the repeats of its source's stream. Inside a slot, spans follow
    each other by lap and by the documents' place in the stream (``place``). Odd rows as in mix_documents."""
    placed, both = _placed(docs, id_col, text_col, source_col, weights, share, most, slots, block_words, parts, ())
    return both.join(placed.select("uid", "doc_id", "source", F.col("begin").alias("place")), "uid").select("slot", "source", "lap", "place", "doc_id", "begin", "end")


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    slots: int = 1 << 18,
    block_words: int = 1 << 16,
    parts: int = 256,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, size (words), source_size, target (its source's), taken (words of it in the mix,
    repeats counted) and slots (for each repeat of it the first slot that holds a part), with the columns named in
    ``keep``.

    Each source's documents stand in the order of a hash of id and text as one stream of words, whatever the order and
    partitions of ``docs``, cut into blocks of equal
    length, so many that the whole mix has about ``slots`` blocks, or more where those would be longer than
    ``block_words``. The schedule's rank r of a source takes its block r, and after the last block the stream repeats;
    the last block is cut at the target. So a source gives its target to within a word, and no document more than
    ``most`` times (rounded up) its size. What is taken is summed from the spans of mixed_spans.

    Null texts and texts without words have size 0 and give nothing; a null source is a source of its own;
    repeated rows share the stream like others; an empty table gives no rows. Other columns are not read. Sources are
    ordered in one task, a row for each: their number must stay in the millions.
    """
    placed, both = _placed(docs, id_col, text_col, source_col, weights, share, most, slots, block_words, parts, keep)
    laps = both.groupBy("uid", "lap").agg(F.sum(F.col("end") - F.col("begin")).alias("n"), F.min("slot").alias("slot"))
    taken = laps.groupBy("uid").agg(F.sum("n").alias("taken"), F.array_sort(F.collect_list("slot")).alias("slots"))
    out = placed.join(taken, "uid", "left")
    none = F.array().cast("array<bigint>")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), F.coalesce("slots", none).alias("slots"), *[F.col(f"__keep_{c}").alias(c) for c in keep])
