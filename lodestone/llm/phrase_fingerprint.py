"""Fingerprints of documents from their Lempel-Ziv phrases; how alike two are says how well one compresses the other."""

from __future__ import annotations

import base64
import gc
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import text_keys
from lodestone.llm.text_arrays import mix, powers

#: Hashes in a fingerprint: likeness has a standard error of at most 0.5 / sqrt(KEPT); smaller phrase sets are whole.
KEPT = 128


#: Mixed values of the code points of the basic plane.
_POINT = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1))


def parse(text: str, node: dict, root: dict, at: int = 0, log: list | None = None) -> tuple[list[int], dict]:
    """Where phrases of ``text`` end (from ``at`` on): each is the shortest piece that isn't a path from ``root``, to
    which it is added. Begins inside a phrase at ``node`` and gives the node where the text's end leaves it. ``log``
    takes what is added, as node and character."""
    ends = []
    for at, c in enumerate(text, at + 1):  # noqa: B020
        if c in node:
            node = node[c]
        else:
            node[c] = {}
            if log is not None:
                log.append((node, c))
            node = root
            ends.append(at)
    return ends, node


def phrase_hashes(text: str, ends: list[int], start: int = 0) -> np.ndarray:
    """A hash of each phrase of ``text``, which ``ends`` cut from ``start`` on."""
    if not ends:
        return np.zeros(0, np.uint32)
    points = np.frombuffer(text[start:].encode("utf-32-le"), "<u4")
    value = _POINT[points] if text.isascii() or not len(points) or points.max() < len(_POINT) else mix(points.astype(np.uint64) + np.uint64(1))
    stop = np.array(ends) - start
    first = np.empty_like(stop)
    first[0], first[1:] = 0, stop[:-1]
    size = stop - first
    place = np.arange(stop[-1]) - np.repeat(first, size)
    summed = np.add.reduceat(value[: stop[-1]] * powers(int(size.max()))[place], first)
    return (mix(summed ^ size.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def least_hashes(hashes: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """The signature: the least of different hashes, ascending."""
    hashes = np.sort(hashes)
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    return hashes[new][:kept]


def likeness_of(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """The share of phrases that two documents have in common, from their signatures: of the least hashes of both
    together those that both have. Without phrases on either side 1."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    again = both[1:] == both[:-1]
    least = both[np.append(True, ~again)][:kept]
    return int(np.count_nonzero(again & (both[1:] <= least[-1]))) / len(least)


def written(sign: np.ndarray) -> str:
    return base64.b64encode(sign.astype(">u4").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u4").astype(np.uint32)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, n_phrases and fingerprint, the least hashes of its phrases in
    base64. Null texts are empty and have the empty fingerprint; equal texts have equal ones; repeated rows give
    repeated results; null ids stay null; an empty table gives no rows. Other columns are not read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text or ""
                own = Parsed(doc_id, text)
                rows.append((doc_id, len(text), len(own.ends), written(own.sign)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_chars", "n_phrases", "fingerprint"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id bigint, n_chars bigint, n_phrases bigint, fingerprint string")


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, from 0 to 1; null if either is null."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else likeness_of(read(x), read(y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def spliced(text: str, other: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``other``, or by all of it."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + other[:quarter]


class Parsed:
    """A document and its phrases; a text that differs in the last quarter alone takes over those before it."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text, self.root = doc_id, text, {}
        self.cut = len(text) - len(text) // 4
        self.head, self.node = parse(text[: self.cut], self.root, self.root)
        self.log: list[tuple[dict, str]] = []
        self.ends = self._ended(self.head + self._tail(text), text)
        self.hashes = phrase_hashes(text, self.ends)
        self.sign = least_hashes(self.hashes)

    def _tail(self, text: str) -> list[int]:
        return parse(text[self.cut :], self.node, self.root, self.cut, self.log)[0]

    @staticmethod
    def _ended(ends: list[int], text: str) -> list[int]:
        """The last phrase may be one that is known."""
        return ends if not text or ends and ends[-1] == len(text) else [*ends, len(text)]

    def edited(self, other: str) -> tuple[str, np.ndarray]:
        """The text with another's beginning as its last quarter, and its signature; what the own tail had added to the
        phrases is taken back first."""
        text, at = spliced(self.text, other), self.head[-1] if self.head else 0
        for node, c in reversed(self.log):
            del node[c]
        self.log = []
        ends = self._ended(self.head + self._tail(text), text)
        if self.cut == len(self.text):
            return text, self.sign
        fresh = phrase_hashes(text, ends[len(self.head) :], at)
        return text, least_hashes(np.concatenate((self.hashes[: len(self.head)], fresh)))


EDITED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of its text with the last quarter replaced by the beginning of
    the next document (by ascending id, after the last the first), and how alike it is to that text and to the next
    document.

    Documents are dealt to ``parts`` ranges of ids (four for each shuffle partition if not given) and stream in their
    order through tasks that hold two at a time; each range also gets the first document of the next one. Only the
    ranges' bounds, a row of numbers for each, reach the driver, and texts are shuffled once.

    Null texts are empty; null ids come last; rows that repeat an id follow each other by hashes of their texts, and
    equal rows in any order, which their results don't show; a single row follows itself; an empty table gives no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.col("doc_id").isNull().cast("int").alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), *text_keys(F.col("text")))
    # equal rows, however many, are dealt to several ranges too
    rows = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    key = ["last", "id", "h1", "h2", "salt"]
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = rows.select(*key).repartitionByRange(parts, *key).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*key)).alias("k")).collect()
    bounds = sorted(tuple(r["k"]) for r in least)
    firsts: dict[tuple, list[int]] = {}
    for n, b in enumerate(bounds):
        firsts.setdefault(b[:4], []).append(n)

    def deal(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        """The range of each row, then those before it if it is the first of its own."""
        given = set()
        for columns in batches:
            out = []
            for k in zip(*(c.tolist() for c in columns), strict=True):
                own = [max(0, bisect_right(bounds, k) - 1)]
                if k[:4] in firsts and k[:4] not in given:
                    given.add(k[:4])
                    own += [(n - 1) % len(bounds) for n in firsts[k[:4]]]
                out.append(own)
            yield pd.Series(out)

    dealt = rows.withColumn("parts", F.pandas_udf(deal, "array<int>")(*key))
    dealt = dealt.select("doc_id", "text", *key[:4], F.posexplode("parts").alias("guest", "part"))
    dealt = dealt.select("part", F.least("guest", F.lit(1)).alias("guest"), *key[:4], "doc_id", "text")
    dealt = dealt.repartition("part").sortWithinPartitions("part", "guest", *key[:4]).select("part", "guest", "doc_id", "text")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in EDITED.split(", ")]
        part, own = None, None
        gc.disable()  # phrases hold no cycles, but so many dictionaries that looking for them takes half the time
        for batch in batches:
            out = []
            for p, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None and guest:
                    continue  # several rows may have been taken for the first of the next range
                new = Parsed(doc_id, text)
                if own is not None and p == part:
                    edited, sign = own.edited(text)
                    digest = hashlib.sha256(edited.encode()).hexdigest()
                    out.append((own.doc_id, len(own.text), digest, written(own.sign), written(sign), likeness_of(own.sign, sign), likeness_of(own.sign, new.sign)))
                part, own = p, None if guest else new
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return dealt.mapInArrow(follow, EDITED)
