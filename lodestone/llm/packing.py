"""Best-fit packing of tokenised documents into fixed-length sequences, with a bounded number of open bins."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tokens import default_tokenizer, word_tokenizer

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
COLUMNS = [c.split()[0] for c in PIECES.split(", ")]


class OpenBins:
    """Online best fit over a fixed number of open bins.

    ``bits`` has bit f set when some open bin has f free places, so the tightest bin for an item is the lowest
    set bit at or above its length. When all bins are open and none fits, the fullest (lowest bit) closes.
    """

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.bits, self.open, self.by_free, self.made = 0, 0, {}, 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        at = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return at

    def add(self, length: int) -> tuple[int, int]:
        """The bin and the place in it of an item."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            at = self._take(free)
        else:
            if self.open >= self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)
            at, free = self.made, self.capacity
            self.made += 1
        if left := free - length:  # a full bin is closed
            self.by_free.setdefault(left, []).append(at)
            self.bits |= 1 << left
            self.open += 1
        return at, self.capacity - free


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Each document (doc_id, text) as pieces of at most ``capacity`` ids; an id ``end_id`` follows its own ids. ``copy``
    numbers pieces of a batch that are equal in all."""
    path, end = tokenizer or default_tokenizer(), end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(path).ids
        for batch in (whole.slice(lo, 1024) for whole in batches for lo in range(0, whole.num_rows, 1024)):
            out, seen = [], Counter()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))
                    out.append((*row, seen[row]))
                    seen[row] += 1
            kinds = [pa.int32() if c == "piece" else pa.int64() for c in (*COLUMNS, "copy")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[*COLUMNS, "copy"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES + ", copy bigint")


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    most_open: int = 4096,
    window: int = 4096,
    shard_chars: int = 64_000_000,
    tokenizer: str | None = None,
) -> DataFrame:
    """Packs all documents; returns doc_id, piece, start, length, ids_crc32, sequence_id and offset for each piece.

    Pieces are dealt to shards of about ``shard_chars`` characters of text by a hash of all they have, and each shard
    packs on its own. The input partition and, for every 64 equal pieces of a batch, their number are hashed too, so
    that no number of equal rows or null ids fills a shard. In a shard, pieces come in the order of a second hash, ``window`` at a time with the
    longest first, which lets short pieces fill what long ones leave while at most ``most_open`` bins are open.
    The number of shards follows the text's length, so a shard's work does not grow with the input; its unfilled
    bins cost less than one part in a thousand.

    Null texts are empty and still hold their end id; an empty table gives no rows; repeated rows are packed as
    often as they occur; a null doc_id stays null. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    chars = docs.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    shards = -(-chars // shard_chars) or 1
    dealt = pieces(docs, capacity, tokenizer).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id(), F.floor(F.col("copy") / 64), F.lit(11)), F.lit(shards)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(order=pd.util.hash_pandas_object(group[["doc_id", "piece", "ids_crc32"]], index=False).to_numpy())
        group = group.sort_values(["order", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        group = group.assign(turn=group.index // window).sort_values(["turn", "length"], ascending=[True, False], kind="stable")
        bins = OpenBins(capacity, most_open)
        places = [bins.add(n) for n in group["length"].tolist()]
        group["sequence_id"] = [(int(s) << 32) + b for s, (b, _) in zip(group["shard"], places, strict=True)]
        group["offset"] = [o for _, o in places]
        return group[[*COLUMNS, "sequence_id", "offset"]]

    return dealt.groupBy("shard").applyInPandas(pack, PIECES + ", sequence_id bigint, offset bigint")
