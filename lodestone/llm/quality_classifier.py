"""Quality by co-training: one classifier sees a page's text, the other its metadata; each teaches the other."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.quality_rules import Texts, texts_of
from lodestone.llm.shared import checkpointed
from lodestone.llm.text_arrays import byte_set

GRAMS, SHAPES = 256, 10
LANGS, SOURCES, SIZES, LAYOUT = 16, 64, 16, 5
TEXT, META = SHAPES + GRAMS, LANGS + SOURCES + SIZES + LAYOUT
DIGITS, PUNCTUATION = byte_set(b"0123456789"), byte_set(b".,;:!?'\"()-")
ENDS = byte_set(b".!?:;\"')")


def text_view(t: Texts) -> np.ndarray:
    """Shape of each whole text, and how often its byte triples fall into hash buckets."""
    n = len(t)
    size, words = np.maximum(1, np.diff(t.bounds)), np.maximum(1, t.n_words)
    letters = np.maximum(1, t.n_upper + t.n_lower)
    distinct = np.unique(t.words.hash ^ (t.words.row.astype(np.uint64) << np.uint64(40)), return_index=True)[1]
    shapes = [
        np.log1p(t.n_words),
        t.word_chars / words,
        np.minimum(3, t.n_symbols / words),
        t.n_upper / letters,
        t.n_dup_lines / np.maximum(1, t.n_lines),
        t.n_repeat_words / words,
        t.per_row(DIGITS[t.raw]) / size,
        t.per_row(PUNCTUATION[t.raw]) / size,
        t.per_row(t.raw > 127) / size,
        np.bincount(t.words.row[distinct], minlength=n) / words,
    ]
    grams = np.zeros((n, GRAMS))
    if len(t.raw) > 2:
        r = t.raw.astype(np.uint32)
        bucket = ((r[:-2] * np.uint32(0x9E3779B1) ^ r[1:-1] * np.uint32(0x85EBCA6B) ^ r[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)) >> np.uint32(24)
        row = np.repeat(np.arange(n), np.diff(t.bounds))[2:]
        whole = np.repeat(np.arange(n), np.diff(t.bounds))[:-2] == row  # triples within one text
        grams = np.bincount(row[whole] * GRAMS + bucket[whole], minlength=n * GRAMS).reshape(n, GRAMS) / size[:, None]
    return np.hstack([np.column_stack(shapes), np.sqrt(grams)])


def meta_view(t: Texts, lang: list, source: list, n_chars: list) -> np.ndarray:
    """Language, source and stated length as hash buckets (nulls have buckets of their own), and the page's layout:
    lines, their mean length, how many repeat, are blank, or end like a sentence. No word of it is looked at."""
    out = np.zeros((len(lang), META))
    for i, (a, b, c) in enumerate(zip(lang, source, n_chars, strict=True)):
        out[i, xxhash.xxh32_intdigest(a or "") % LANGS] = 1
        out[i, LANGS + xxhash.xxh32_intdigest(b or "", 1) % SOURCES] = 1
        out[i, LANGS + SOURCES + (0 if c is None else min(SIZES - 1, 1 + int(math.log2(max(1, c)) / 1.5)))] = 1
    breaks = t.raw == 10
    before = np.concatenate(([False], ENDS[t.raw[:-1]])) if len(t.raw) else np.zeros(0, bool)
    n = 1 + t.per_row(breaks)
    layout = [np.log1p(n), np.log1p(np.diff(t.bounds) / n), t.n_dup_lines / np.maximum(1, t.n_lines), 1 - t.n_lines / n, t.per_row(breaks & before) / n]
    out[:, -LAYOUT:] = np.column_stack(layout)
    return out


@dataclass
class View:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.raw(x) + self.shift)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Pull:
    """What pseudo-labelled rows ask of a view: gradient and bound on the Hessian of their loss at ``at``, for
    standardised rows."""

    at: np.ndarray
    gradient: np.ndarray
    hessian: np.ndarray


def logistic(x: np.ndarray, y: np.ndarray, l2: float, pull: Pull | None = None, steps: int = 40) -> np.ndarray:
    """Weights, the last one constant, by Newton's method; ``pull`` counts as much as all rows together."""
    x = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, l2), 1e-6]
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient, hessian = x.T @ (p - y) / len(y) + ridge * w, (x * (p * (1 - p) + 1e-6)[:, None]).T @ x / len(y) + np.diag(ridge)
        if pull:
            gradient, hessian = gradient + pull.gradient + pull.hessian @ (w - pull.at), hessian + pull.hessian
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, pull: Pull | None = None) -> View:
    """A view whose probabilities are calibrated on predictions of halves that it was not fitted to."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    half = np.arange(len(y)) % 2 == 0
    out = np.zeros(len(y))
    for part in (half, ~half):
        out[part] = np.c_[z[part], np.ones(part.sum())] @ logistic(z[~part], y[~part], l2, pull)
    slope, shift = logistic(out[:, None], y, 1e-3)
    return View(mean, scale, logistic(z, y, l2, pull), float(max(0.0, slope)), float(shift))


@dataclass
class Model:
    text: View | None
    meta: View | None
    prior: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) by text, by metadata, and by both: their log odds, with the prior counted once."""
        if self.text is None:
            same = np.full(len(text), self.prior)
            return same, same, same
        a, b = self.text.probability(text), self.meta.probability(meta)
        odds = lambda p: np.log(np.clip(p, 1e-9, 1) / np.clip(1 - p, 1e-9, 1))
        return a, b, sigmoid(odds(a) + odds(b) - odds(np.array([self.prior])))


Statistics = dict[tuple[str, int], tuple[float, np.ndarray, np.ndarray]]


def statistics(views: dict[str, View], text: np.ndarray, meta: np.ndarray, sure: float) -> Statistics:
    """For either view, and rows that the other view is sure are poor (0) or good (1): how many there are, and the sums
    of their loss's gradient at the view's weights and of its curvature's upper bound, a quarter for each row, so that
    a step can't overshoot."""
    out = {}
    for pupil, teacher, x, seen in (("text", "meta", text, meta), ("meta", "text", meta, text)):
        view, p = views[pupil], views[teacher].probability(seen)
        for label, chosen in ((0, p <= 1 - sure), (1, p >= sure)):
            z = np.c_[(x[chosen] - view.mean) / view.scale, np.ones(int(chosen.sum()))]
            q = sigmoid(z @ view.weights)
            out[pupil, label] = (float(len(z)), z.T @ (q - label), z.T @ z / 4)
    return out


def pull_of(view: View, name: str, got: Statistics, share: float) -> Pull | None:
    """Statistics of all pseudo-labelled rows as one pull, in which good ones weigh ``share``, as they do among the
    labelled rows."""
    parts = [(w / got[name, label][0], *got[name, label][1:]) for label, w in ((0, 1 - share), (1, share)) if got[name, label][0]]
    if not parts:
        return None
    return Pull(view.weights, sum(w * g for w, g, _ in parts), sum(w * h for w, _, h in parts))


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, gather: Callable[[dict[str, View]], Statistics], rounds: int = 2) -> Model:
    """Views of the labelled rows, and ``gather``, which gives the statistics of all rows under given views.
    In each round either classifier labels the rows of which it is sure, and the other one is fitted again to the
    labelled rows and to them, half and half.

    With labels of one kind only, or fewer than four of one, the share of good ones is the score of all.
    """
    prior = float(y.mean()) if len(y) else 1.0
    if len(y) == 0 or min(y.sum(), len(y) - y.sum()) < 4:
        return Model(None, None, prior)
    views = {"text": fit(text, y), "meta": fit(meta, y)}
    for _ in range(rounds):
        got = gather(views)
        views = {name: fit(x, y, pull=pull_of(views[name], name, got, prior)) for name, x in (("text", text), ("meta", meta))}
    return Model(views["text"], views["meta"], min(max(prior, 1e-3), 1 - 1e-3))


_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each part of a batch with its rows' two views, rounded as they are stored."""
    for batch in batches:
        for lo, hi, texts in texts_of(batch, "text"):
            part = batch.slice(lo, hi - lo)
            meta = meta_view(texts, *(part.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
            yield part, text_view(texts).astype("<f2").astype(float), meta.astype("<f2").astype(float)


def _standard(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), "text", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("bigint"))


def _pack(text: np.ndarray, meta: np.ndarray) -> list[bytes]:
    """Both views of each row as bytes: 16-bit floats, and the buckets as bits."""
    floats = np.hstack([text, meta[:, -LAYOUT:]]).astype("<f2")
    bits = np.packbits(meta[:, :-LAYOUT] > 0, axis=1)
    return [a.tobytes() + b.tobytes() for a, b in zip(floats, bits, strict=True)]


def _unpack(stored: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    wide = 2 * (TEXT + LAYOUT)
    raw = np.frombuffer(b"".join(stored), np.uint8).reshape(len(stored), wide + -(-(META - LAYOUT) // 8))
    floats = np.ascontiguousarray(raw[:, :wide]).view("<f2").astype(float)
    bits = np.unpackbits(raw[:, wide:], axis=1)[:, : META - LAYOUT].astype(float)
    return floats[:, :TEXT], np.hstack([bits, floats[:, TEXT:]])


def view_table(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, x) of every row of ``docs``: both its views in little more than half a kilobyte."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, a, b in _views(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "x": pa.array(_pack(a, b), pa.binary())})

    return _standard(docs, id_col).mapInArrow(extract, "doc_id bigint, x binary")


def labelled_sample(rows: DataFrame, labels: DataFrame, most: int, id_col: str = "doc_id") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text view, metadata view and label of at most ``most`` different rows (doc_id, x), in the order of a hash of
    their ids. An id that is labelled both ways, or by null, is left out."""
    known = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    # ids alone are joined; the chosen ones, few by their limit, then meet the views
    ids = rows.select("doc_id").distinct().join(known, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(most)
    chosen = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "x", "y").distinct().orderBy(F.xxhash64("doc_id", F.lit(3)), "x").limit(most)
    got = chosen.toPandas()
    return *_unpack(list(map(bytes, got["x"]))), got["y"].to_numpy(float)


def gather_statistics(rows: DataFrame, views: dict[str, View], sure: float, chunk: int = 4096, rows_at_once: int = 512, fan_in: int = 32) -> Statistics:
    """``statistics`` over all rows (x), summed by Spark in chunks, ``fan_in`` partial sums of a chunk at a time, in as
    many levels as it takes; the sums, as many as the views have pairs of features, come to the driver, however many
    rows and partitions there are."""
    sizes = {"text": TEXT + 1, "meta": META + 1}
    keys = [(name, label) for name in sizes for label in (0, 1)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: [0.0, np.zeros(sizes[k[0]]), np.zeros((sizes[k[0]],) * 2)] for k in keys}
        for batch in batches:
            for lo in range(0, batch.num_rows, rows_at_once):
                for k, parts in statistics(views, *_unpack(batch.column("x").slice(lo, rows_at_once).to_pylist()), sure).items():
                    total[k] = [a + b for a, b in zip(total[k], parts, strict=True)]
        out = []
        for no, (n, g, h) in enumerate(total.values()):
            flat = np.concatenate(([n], g, h[np.triu_indices(len(g))]))
            out += [(no, at, flat[at : at + chunk].tobytes()) for at in range(0, len(flat), chunk) if n]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"k": pa.array([r[0] for r in out], pa.int32()), "at": pa.array([r[1] for r in out], pa.int32()), "part": pa.array([part] * len(out), pa.int64()), "v": pa.array([r[2] for r in out], pa.binary())})

    def total(group: pd.DataFrame) -> pd.DataFrame:
        parts = sorted(map(bytes, group["v"]))  # in an order that doesn't change from run to run
        return group[["k", "at", "part"]].head(1).assign(v=[np.sum([np.frombuffer(v) for v in parts], axis=0).tobytes()])

    kinds, parts = "k int, at int, part bigint, v binary", rows.rdd.getNumPartitions()
    sums = rows.select("x").mapInArrow(add, kinds)
    while parts > 1:
        sums = sums.withColumn("part", F.expr(f"part div {fan_in}")).groupBy("k", "at", "part").applyInPandas(total, kinds)
        parts = -(-parts // fan_in)
    got = sums.toPandas().sort_values(["k", "at"])
    out = {}
    for no, key in enumerate(keys):
        size = sizes[key[0]]
        flat = np.frombuffer(b"".join(map(bytes, got[got["k"] == no]["v"])))
        flat = flat if len(flat) else np.zeros(1 + size + size * (size + 1) // 2)
        h = np.zeros((size, size))
        h[np.triu_indices(size)] = flat[1 + size :]
        out[key] = (flat[0], flat[1 : 1 + size], h + np.triu(h, 1).T)
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", most_labelled: int = 6000, rounds: int = 2, sure: float = 0.97) -> Model:
    """Trains on at most ``most_labelled`` labelled rows, in the order of a hash of their ids, and on all rows: each
    round labels every row of which a view is at least ``sure``, and only sums of what they ask for leave the
    executors. Both views of all rows are computed once and kept in the shared folder.

    Null texts are empty and null metadata is a value of its own. Rows without an id are unlabelled; rows that repeat
    an id and its text are one labelled row; an id labelled both ways is unlabelled. Without documents, or with labels
    of one kind, all score alike. Other columns are not read.
    """
    rows = checkpointed(view_table(docs, id_col))
    return co_train(*labelled_sample(rows, labels, most_labelled, id_col), lambda views: gather_statistics(rows, views, sure), rounds)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, p_text, p_meta, score and kept (score >= ``threshold``), from whole texts.

    Null texts are empty; null metadata is a value of its own; repeated rows give repeated results; an empty table
    gives none. Other columns are not read.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, a, b in _views(batches):
            p, q, s = model.scores(a, b)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "p_text": pa.array(p), "p_meta": pa.array(q), "score": pa.array(s), "kept": pa.array(s >= threshold)})

    return _standard(docs, id_col).mapInArrow(score, "doc_id bigint, p_text double, p_meta double, score double, kept boolean")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns. Nulls and repeated rows as in
    score_quality; an empty table stays empty; other columns pass through unread."""
    at = {c: docs.columns.index(c) for c in _COLUMNS}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column(k) for k in at.values()], names=list(at))
            lo = 0
            for part, a, b in _views(iter([own])):
                good = np.flatnonzero(model.scores(a, b)[2] >= threshold)
                if len(good):
                    yield batch.slice(lo, part.num_rows).take(pa.array(good))
                lo += part.num_rows

    return docs.mapInArrow(keep, docs.schema)
