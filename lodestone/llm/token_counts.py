"""Token counts of documents in flat token files that have no index, from a scan for end-of-document ids."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import checkpoint_folder, checkpointed
from lodestone.llm.tokens import default_tokenizer, word_tokenizer

#: The end-of-document id of word_bpe_49k, which ordinary text never gives.
END = 49407
#: Tokens that a task reads and searches at once.
BLOCK = 1 << 20


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = END, width: int = 2) -> DataFrame:
    """Writes documents as flat files of ids of ``width`` bytes (2 or 4) below ``folder``, each document followed by ``end``, and returns
    which document went where: (path, file, ordinal, doc_id), checkpointed.

    There is one flat file for each split of an input file that Spark reads, and ``file`` names the split, so that
    names don't change from run to run as long as the splits don't; rows that don't come from a file are named by
    their partition. Each attempt of a task writes files of its own, and only those of the attempt that counts are in
    the result. ``folder`` is a URI that all executors reach (file, hdfs, s3).

    An id that ``width`` can't hold is an error. Null texts are empty documents; null ids stay null; repeated rows are
    documents of their own; an empty table writes nothing. Other columns are not read.
    """
    kind, most = f"<u{width}", 1 << 8 * width
    if end >= most:
        raise ValueError(f"id {end} needs more than {width} bytes")
    path, mark = tokenizer or default_tokenizer(), np.array(end, kind).tobytes()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        encode, task = word_tokenizer(path, True).ids, TaskContext.get()
        current, out, name, at = None, None, "", 0
        for batch in batches:
            rows = []
            for source, begin, doc_id, text in zip(batch["source"], batch["begin"], batch["doc_id"], batch["text"], strict=True):
                if (source, begin) != current:
                    if out:
                        out.close()
                    current, at = (source, begin), 0
                    name = f"{source.rsplit('/', 1)[-1]}@{begin}" if source else f"partition-{task.partitionId()}"
                    own = f"{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex}.bin"
                    out = store.open_output_stream(f"{base}/{own}")
                ids = np.frombuffer(encode(text or ""), "<u4")
                if len(ids) and ids.max() >= most:
                    raise ValueError(f"id {ids.max()} of document {doc_id} needs more than {width} bytes")
                out.write(ids.astype(kind).tobytes() + mark)
                rows.append((f"{folder}/{own}", name, at, doc_id))
                at += 1
            yield pd.DataFrame(rows, columns=["path", "file", "ordinal", "doc_id"]).astype({"doc_id": "Int64"})
        if out:
            out.close()

    rows = docs.select(F.input_file_name().alias("source"), F.input_file_block_start().alias("begin"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return checkpointed(rows.mapInPandas(write, "path string, file string, ordinal bigint, doc_id bigint"))


def list_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of all files below a folder; Spark lists them and reads none."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")


def read_token_files(files: DataFrame, block_tokens: int = BLOCK, width: int = 2) -> DataFrame:
    """Flat token files (path) as rows (file, block, data), file being the path. Their lengths are looked up, blocks of
    ``block_tokens`` ids are dealt out, and each task seeks and reads its own blocks, one at a time: neither a task
    nor a row ever holds a whole file. Files are URIs that pyarrow can open; an empty file has no block, repeated
    paths are read once, and null paths not at all."""
    size = block_tokens * width

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            lengths = []
            for path in batch["path"]:
                store, at = fs.FileSystem.from_uri(path)
                lengths.append(store.get_file_info(at).size)
            yield pd.DataFrame({"path": batch["path"], "n": lengths})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for path, block in zip(batch["path"], batch["block"], strict=True):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    f.seek(block * size)
                    yield pd.DataFrame({"file": [path], "block": [block], "data": [f.read(size)]})

    # file names alone are shuffled; Spark spells local ones file:/
    uri = F.regexp_replace("path", "^file:/(?=[^/])", "file:///")
    measured = files.select(uri.alias("path")).where("path is not null").distinct().mapInPandas(measure, "path string, n bigint")
    blocks = measured.where("n > 0").select("path", F.explode(F.expr(f"sequence(0L, (n - 1) div {size})")).alias("block"))
    return blocks.repartition("path", "block").mapInPandas(read, "file string, block bigint, data binary")


def count_tokens(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """Documents of flat token streams (file, block, data): file, ordinal, start, n_tokens (without the end id) and
    ended (whether an end id follows).

    Each block is searched on its own, all ids at once. What a document has in earlier blocks then comes from a
    scan over one small row per block: the tokens after a block's last end id, carried on through blocks without
    one. A stream's last document may lack its end id. Empty and null blocks add nothing, empty tables give no rows;
    a null file is a stream of its own. Blocks of a file must not repeat; other columns are not read.
    """
    kind = f"<u{width}"

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data in batch["data"]:
                ids = np.frombuffer(data or b"", kind)
                rows.append((len(ids), np.flatnonzero(ids == end).astype(np.int64)))
            yield batch.drop(columns=["data"]).assign(n=[n for n, _ in rows], ends=[e for _, e in rows])

    keep = "file " + dict(blocks.dtypes)["file"] + ", block bigint, n bigint, ends array<bigint>"
    found = checkpointed(blocks.select("file", F.col("block").cast("bigint").alias("block"), "data").mapInPandas(search, keep))
    # the prefix scan, over (file, block, n, number of ends, place of the last end) only
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    small = found.select("file", "block", "n", F.size("ends").alias("k"), F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1).alias("last_end"))
    small = small.select(
        "file",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("k").over(before), F.lit(0)).alias("docs_before"),
        F.col("last_end"),
        "n",
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("is_last"),
    )
    open_at = F.coalesce(F.last(F.col("base") + F.col("last_end") + 1, ignorenulls=True).over(before), F.lit(0))
    small = small.withColumn("open_at", open_at).drop("last_end", "n")
    at = found.alias("f").join(small.alias("s"), F.col("f.file").eqNullSafe(F.col("s.file")) & (F.col("f.block") == F.col("s.block")))
    # a stream's tail without an end id counts as a last document
    tail = F.when(F.col("is_last") & (F.coalesce(F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1), F.lit(-1)) < F.col("n") - 1), F.array(F.col("n"))).otherwise(F.array().cast("array<bigint>"))
    each = at.select("f.file", "base", "docs_before", "open_at", "ends", F.concat("ends", tail).alias("stops"))
    each = each.select("file", "base", "docs_before", "open_at", "ends", "stops", F.posexplode("stops").alias("i", "stop"))
    out = each.withColumn("start", F.when(F.col("i") == 0, F.col("open_at")).otherwise(F.col("base") + F.try_element_at("stops", F.col("i")) + 1))
    out = out.withColumn("n_tokens", F.col("base") + F.col("stop") - F.col("start"))
    return out.where("i < size(ends) or n_tokens > 0").select("file", (F.col("docs_before") + F.col("i")).alias("ordinal"), "start", "n_tokens", (F.col("i") < F.size("ends")).alias("ended"))


def document_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, block_tokens: int = BLOCK, width: int = 2) -> DataFrame:
    """doc_id, file, ordinal, start and n_tokens of every row of ``docs``: its texts are written as flat token files in
    the shared folder, and counted from those files alone; what the writer knows is only used to name the documents
    by their place in a file. Odd rows as in write_token_files."""
    folder = f"{checkpoint_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    folder = f"file://{folder}" if folder.startswith("/") else folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    written = write_token_files(docs, folder, id_col, text_col, tokenizer, width=width)
    counted = count_tokens(read_token_files(written.select("path"), block_tokens, width), width=width).withColumnRenamed("file", "path")
    return counted.join(written, ["path", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
