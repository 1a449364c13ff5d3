"""Spelling variants: words one edit apart, found through an index of grams of variable length."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import checkpointed
from lodestone.llm.text_arrays import mix

#: Grams have so many characters; words are padded with two marks at each end, so that first and last grams say so.
SHORTEST, LONGEST, PAD = 2, 5, 2
#: With padding, a word of so many characters always has two grams that no one edit reaches both of.
LEAST_CHARS = 7
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _without(run: str, at: int) -> str:
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_times: int = 2, mistype: int = 31, most_held: int = 200_000) -> DataFrame:
    """(word, n) of the words of at least ``least_chars`` letters that occur ``least_times`` or more. Words are maximal
    runs of ASCII letters and of U+00C0 to U+00FF, with A to Z in lower case. One run in ``mistype`` of a document,
    chosen by a checksum of id and run, loses a letter first; 0: none does.

    A task holds at most ``most_held`` different words and passes on counts. Null texts have no words; a null id counts
    as an empty one; an empty table gives no rows. Other columns are not read.
    """
    find = re.compile(f"[A-Za-zÀ-ÿ]{{{least_chars},}}").findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in held], pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
                for run in find(text or ""):
                    word = run.encode().lower()
                    if mistype and (h := zlib.crc32(word, base)) % mistype == 0:
                        if len(run) == least_chars:
                            continue
                        word = _without(word.decode(), h % len(run)).encode()
                    held[word] = held.get(word, 0) + 1
                if len(held) > most_held:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times)


def _classes(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Words by length: the length, their places in ``words``, and their padded code points side by side."""
    sizes = np.array(list(map(len, words)), np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        points = np.frombuffer("".join(words[k] for k in at).encode("utf-32-le"), "<u4").reshape(len(at), size)
        yield int(size), at, np.pad(points, ((0, 0), (PAD, PAD)), constant_values=((0, 0), (0, 1)))


def _gram_hashes(points: np.ndarray) -> dict[int, np.ndarray]:
    """For each gram length, a hash of the gram at every place."""
    value, out = mix(points.astype(np.uint64) + np.uint64(1)), {}
    h = value
    for size in range(2, LONGEST + 1):
        h = h[:, :-1] * _STEP + value[:, size - 1 :]
        out[size] = mix(h)
    return out


@dataclass
class GramDictionary:
    """The grams that more than ``limit`` words have, by hash, and how many have them. A gram that is rarer is never
    extended: its list is short enough."""

    hashes: np.ndarray
    counts: np.ndarray
    limit: int

    def count(self, h: np.ndarray) -> np.ndarray:
        """In how many places words have a gram; ``limit`` for all that are rare."""
        if not len(self.hashes):
            return np.full(h.shape, self.limit)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.counts[at], self.limit)


def gram_dictionary(words: DataFrame, most: int = 1 << 18, least: int = 32) -> GramDictionary:
    """The dictionary for words (word). The limit grows with the words, so that no more than ``most`` grams can be
    frequent, which is what is sent to the executors; below ``least`` none is."""
    places = words.agg(F.sum(F.length("word") + 2 * PAD)).first()[0] or 0
    limit = max(least, math.ceil((LONGEST - SHORTEST + 1) * places / most))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [h.ravel() for _, _, points in _classes(batch.column("word").to_pylist()) for h in _gram_hashes(points).values()]
            h, n = np.unique(np.concatenate(every), return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "n": pa.array(n)})

    grams = words.select("word").mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    got = grams.where(F.col("n") > limit).toPandas()
    h = got["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return GramDictionary(h[order], got["n"].to_numpy(np.int64)[order], limit)


def decompose(points: np.ndarray, grams: GramDictionary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of padded words of one length, for each place but the last: the length of the gram there (0 where an earlier one
    covers it), its hash, and how many words have it. A gram grows while it is frequent and the word goes on."""
    m, n = points.shape
    hashes = _gram_hashes(points)
    size = np.full((m, n - 1), SHORTEST)
    h = hashes[SHORTEST].copy()
    for k in range(SHORTEST, LONGEST):
        grow = (size[:, : n - k] == k) & (grams.count(h[:, : n - k]) > grams.limit)
        size[:, : n - k][grow] += 1
        h[:, : n - k] = np.where(grow, hashes[k + 1], h[:, : n - k])
    end = np.arange(n - 1) + size
    covered = np.zeros((m, n - 1), bool)
    covered[:, 1:] = np.maximum.accumulate(end, axis=1)[:, :-1] >= end[:, 1:]
    return np.where(covered, 0, size), h, grams.count(h)


def merged_lists(size: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word, places of the two grams with the shortest lists of which one edit reaches at most one.

    An edit from place e on leaves a gram that ends at e as it is, and at its place. An edit before e leaves a gram that
    begins at e or later as it is, and at its place from the word's end, unless a longer gram can newly cover it, which
    would begin at the edit or before: it can't if the gram has full length or ends ``LONGEST`` or more behind e.
    """
    m, n = size.shape
    n += 1  # characters
    never = np.iinfo(np.int64).max // 4
    cost = np.where(size > 0, cost, never)
    # the cheapest gram of full length that begins at a place or later, and the cheapest other that ends there or later
    begins, begins_at = np.full((m, n + LONGEST + 1), never), np.zeros((m, n + LONGEST + 1), np.int64)
    ends, ends_at = begins.copy(), begins_at.copy()
    for p in range(n - 2, -1, -1):
        full = np.where(size[:, p] == LONGEST, cost[:, p], never)
        better = full < begins[:, p + 1]
        begins[:, p] = np.where(better, full, begins[:, p + 1])
        begins_at[:, p] = np.where(better, p, begins_at[:, p + 1])
    for e in range(n, 0, -1):
        ends[:, e], ends_at[:, e] = ends[:, e + 1], ends_at[:, e + 1]
        for k in range(SHORTEST, LONGEST):
            if 0 <= e - k < n - 1:
                here = np.where(size[:, e - k] == k, cost[:, e - k], never)
                better = here < ends[:, e]
                ends[:, e] = np.where(better, here, ends[:, e])
                ends_at[:, e] = np.where(better, e - k, ends_at[:, e])
    best, left, right = np.full(m, 2 * never), np.zeros(m, np.int64), np.zeros(m, np.int64)
    rows = np.arange(m)
    for p in range(n - 1):
        e = p + size[:, p]
        one, other = begins[rows, e], ends[rows, np.minimum(e + LONGEST, n + LONGEST)]
        total = cost[:, p] + np.minimum(one, other)
        better = (size[:, p] > 0) & (total < best)
        best = np.where(better, total, best)
        left = np.where(better, p, left)
        right = np.where(better, np.where(one <= other, begins_at[rows, e], ends_at[rows, np.minimum(e + LONGEST, n + LONGEST)]), right)
    return left, right


def _key(h: np.ndarray, place: np.ndarray | int, length: int) -> np.ndarray:
    """Stands for a gram at a place of words of a length."""
    return mix(h ^ (np.asarray(place).astype(np.uint64) << np.uint64(32)) ^ np.uint64(length)).view(np.int64)


def _emit(words: DataFrame, make: Callable[[int, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]], names: tuple[str, str]) -> DataFrame:
    """(key, word, n) under other names: for each class of words ``make`` gives keys and whose they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, keys, rows = batch.column("word").to_pylist(), [], []
            for length, at, points in _classes(column):
                for key, row in make(length, points):
                    keys.append(key)
                    rows.append(at[row])
            if keys:
                own = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column("word").take(own), batch.column("n").take(own)], names=["key", *names])

    return words.select("word", "n").mapInArrow(run, f"key bigint, {names[0]} string, {names[1]} bigint")


def near_pairs(words: DataFrame, grams: GramDictionary) -> DataFrame:
    """(word, n, near, near_n): every pair of words (word, n; at least ``LEAST_CHARS`` characters, each once) that one
    inserted, deleted or replaced character makes equal, once, from the shorter or lesser word.

    All grams of each word are indexed under their place and the word's length. For each word the lists of two grams
    are merged, those that merged_lists picks: one of them is in every near word, before the edit at its own place, or
    behind it at its own place from the end. What meets is compared at once, inside the join.
    """

    def index(length: int, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size, h, _ = decompose(points, grams)
        row, place = np.nonzero(size)
        yield _key(h[row, place], place, length), row

    def ask(length: int, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size, h, count = decompose(points, grams)
        left, right = merged_lists(size, count)
        rows = np.arange(len(points))
        for place, grown in ((left, 0), (right, 1)):
            own = h[rows, place]
            yield _key(own, place, length), rows
            yield _key(own, place + grown, length + 1), rows

    have, asked = _emit(words, index, ("near", "near_n")), _emit(words, ask, ("word", "n"))
    longer = (F.length("near") > F.length("word")) | (F.col("near") > F.col("word"))
    near = have.join(asked, (have["key"] == asked["key"]) & longer & (F.levenshtein(F.col("word"), F.col("near"), 1) == 1))
    return near.select("word", "n", "near", "near_n").distinct()


def variants(words: DataFrame, times: int = 10, most_grams: int = 1 << 18, least_list: int = 32) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words (word, n), each once. Its form is the near word that occurs most
    (ties: the first by code points), if it occurs ``times`` as often or more; its root is where following forms ends.

    Words shorter than ``LEAST_CHARS`` are refused, since the index doesn't find all their neighbours; a null word or
    count is left out; an empty table gives no rows. Other columns are not read.
    """
    words = checkpointed(words.where("word is not null and n is not null").select("word", "n"))
    short = F.coalesce(F.min(F.length("word")), F.lit(LEAST_CHARS))
    least, most = words.agg(short, F.coalesce(F.max("n"), F.lit(0))).first()
    if least < LEAST_CHARS:
        raise ValueError(f"words must have {LEAST_CHARS} characters or more")
    pairs = checkpointed(near_pairs(words, gram_dictionary(words, most_grams, least_list)))
    both = pairs.select("word", "near", "near_n").unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b"))
    rows = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("b.less") >= times * F.col("n"), -F.col("b.less")))
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("b.near")).alias("form"), "form_n")
    rows = checkpointed(rows)
    # forms occur ``times`` as often at each step, so chains are short; each round doubles the steps that are known
    links = rows.where("form is not null").select("word", F.col("form").alias("root"))
    steps, deep = 1, math.floor(math.log(max(most, 1), times)) + 1 if times > 1 else most
    while steps < deep:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        links = checkpointed(links.join(onward, "root", "left").select("word", F.coalesce("far", "root").alias("root")))
        steps *= 2
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spelling variants among the words of whole texts: word_counts, then variants. Odd rows as in word_counts."""
    return variants(word_counts(docs, id_col, text_col))
