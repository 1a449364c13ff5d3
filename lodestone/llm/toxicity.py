"""Toxicity by compression distance: one zstandard dictionary for toxic text, one for ordinary text.

A text is compressed in overlapping windows of running bytes, each once with the dictionary of ordinary text and
nothing behind it, and once with the toxic dictionary there. What a window gains is the difference of the two lengths:
all that the ordinary dictionary has costs the same either way. How many windows gain how much is calibrated to a
probability on texts that the dictionaries were not trained on.

Both dictionaries are trained by zstandard, and two things are kept from the ordinary one: passages that stand in several
texts, and windows that hold what is typical of toxic text. Typical are runs of bytes that toxic texts have more often
than chance explains; the toxic dictionary is trained on the stretches that they cover.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WHITE = re.compile(rb"[\x00-\x20]+")
#: Bytes of a window, and from one to the next; anything of up to ``WINDOW - STEP`` bytes is whole in one of them.
WINDOW, STEP = 48, 36
#: Sizes of the dictionaries in bytes.
ORDINARY, TOXIC = 65_536, 4096
#: A window that shares so many bytes in a row with another text is a repeated passage and trains nothing.
PASSAGE = 20
#: Lengths of runs that are compared, and how many times a text counts that has one more often.
RUNS, CAPPED = (5, 6, 8), 4
#: A run is typical if ``LEAST`` toxic texts or more have it, if the log-likelihood ratio of its share of texts is at
#: least ``SURE``, and that of its counts at least ``FLOOR`` and ``SHARE`` of what the strongest runs have.
LEAST, SURE, FLOOR, SHARE = 4, 16, 30, 0.05
#: Gains that are counted, one count for each.
LEVELS = (1, 2, 3, 4, 5, 6, 8)
FEATURES = len(LEVELS) + 5


def plain(text: str | None) -> bytes:
    """Lower-case bytes with single blanks, one at either end."""
    return b" " + _WHITE.sub(b" ", (text or "").lower().encode()).strip() + b" "


def windows(raw: bytes) -> list[bytes]:
    """Overlapping windows that together hold every byte."""
    return [raw[i : i + WINDOW] for i in range(0, max(1, len(raw) - WINDOW + STEP), STEP)]


def _runs(raw: bytes, n: int) -> np.ndarray:
    """A 32-bit hash of each run of ``n`` bytes."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    out = np.zeros(max(0, len(b) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + b[k : k + len(out)]
    return (((out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)


def _counts(runs: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of all texts, in order, how many texts have each, and how often, a text counting ``CAPPED`` times at
    most."""
    packed = []
    for own in runs:
        values, n = np.unique(own, return_counts=True)
        packed.append(values.astype(np.uint64) << np.uint64(4) | np.minimum(n, CAPPED).astype(np.uint64))
    every = np.concatenate(packed) if packed else np.zeros(0, np.uint64)
    every.sort()
    values = (every >> np.uint64(4)).astype(np.uint32)
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    if not len(first):
        return values, first, first
    times = np.add.reduceat((every & np.uint64(15)).astype(np.uint8), first, dtype=np.int64)
    return values[first], np.diff(np.append(first, len(values))), times


def surprise(a: np.ndarray, b: np.ndarray, of_a: int, of_b: int) -> np.ndarray:
    """The log-likelihood ratio of ``a`` out of ``of_a`` and ``b`` out of ``of_b`` against one share for both; 0 where
    the first share isn't the larger."""
    part = lambda k, n, share: k * np.log(np.maximum(share, 1e-300)) + (n - k) * np.log(np.maximum(1 - share, 1e-300))
    both = (a + b) / (of_a + of_b)
    ratio = 2 * (part(a, of_a, a / of_a) + part(b, of_b, b / of_b) - part(a, of_a, both) - part(b, of_b, both))
    return np.where(a * of_b > b * of_a, ratio, 0.0)


def _look_up(values: np.ndarray, ordered: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[at] == values, counts[at], 0)


class Sample:
    """Training texts as plain bytes, and where they repeat another text's passages."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        # passages are compared where words begin
        begins = [np.flatnonzero(np.frombuffer(t, np.uint8)[: max(0, len(t) - PASSAGE + 1)] == 32) for t in texts]
        long = [_runs(t, PASSAGE)[at] for t, at in zip(texts, begins, strict=True)]
        ordered, counts, _ = _counts(long)
        ordered, counts = ordered[counts > 1], counts[counts > 1]  # few, so that looking them up is fast
        self.repeated = []  # for each text: how many passages that another text has too begin before each byte
        for t, at, own in zip(texts, begins, long, strict=True):
            bad = np.zeros(len(t) + 1, np.int32)
            bad[at + 1] = _look_up(own, ordered, counts) > 0
            self.repeated.append(np.cumsum(bad, dtype=np.int32))

    def _fresh(self, k: int, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Whether stretches of text ``k`` share no PASSAGE bytes in a row with another text."""
        bad = self.repeated[k]
        return bad[np.minimum(stop, len(bad) - 1)] == bad[np.maximum(0, first - PASSAGE + 1)]

    def typical(self, toxic: list[int], ordinary: list[int]) -> dict[int, np.ndarray]:
        """The runs, by length, that are typical of toxic texts."""
        found = {}
        for n in RUNS:
            known, others, of_others = _counts(_runs(self.texts[k], n) for k in ordinary)
            seen, own, of_own = _counts(_runs(self.texts[k], n) for k in toxic)
            others, of_others = _look_up(seen, known, others), _look_up(seen, known, of_others)
            often = surprise(of_own, of_others, CAPPED * len(toxic), CAPPED * len(ordinary))
            good = (own >= LEAST) & (surprise(own, others, len(toxic), len(ordinary)) >= SURE)
            found[n] = seen[good], often[good]
        top = max((np.sort(often)[-20:].mean() for _, often in found.values() if len(often)), default=0.0)
        return {n: seen[often >= max(FLOOR, SHARE * top)] for n, (seen, often) in found.items()}

    def covered(self, k: int, typical: dict[int, np.ndarray]) -> np.ndarray:
        """Which bytes of text ``k`` typical runs cover."""
        change = np.zeros(len(self.texts[k]) + 1, np.int32)
        for n, runs in typical.items():
            at = np.flatnonzero(_look_up(_runs(self.texts[k], n), runs, np.ones(len(runs), np.int64)))
            change[at] += 1
            change[at + n] -= 1
        return np.cumsum(change)[:-1] > 0

    def dictionaries(self, toxic: list[int], ordinary: list[int]) -> tuple[bytes, bytes]:
        """The toxic dictionary, of the stretches that typical runs cover, and the ordinary one, of windows without any."""
        if not toxic or not ordinary:
            return b"", b""
        typical, stretches, plain_windows = self.typical(toxic, ordinary), [], []
        for k in toxic:
            edges = np.flatnonzero(np.diff(np.concatenate(([False], self.covered(k, typical), [False]))))
            stretches += [self.texts[k][a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
        for k in ordinary:
            own, held = windows(self.texts[k]), np.concatenate(([0], np.cumsum(self.covered(k, typical))))
            first = np.arange(len(own)) * STEP
            stop = np.minimum(first + WINDOW, len(held) - 1)
            good = self._fresh(k, first, first + WINDOW) & (held[stop] == held[first])
            plain_windows += [own[i] for i in np.flatnonzero(good)]
        return trained(TOXIC, stretches), trained(ORDINARY, plain_windows)


#: What stands before the content of a dictionary that zstandard trains: its mark, and its last three offsets.
MAGIC, OFFSETS = b"\x37\xa4\x30\xec", b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def trained(size: int, samples: list[bytes]) -> bytes:
    """The content, without header and tables, of a dictionary that zstandard trains on the samples; where they are too
    few for that, the last of them."""
    import zstandard as z

    try:
        made = z.train_dictionary(size, [s for s in samples if len(s) >= 8], k=16, d=6).as_bytes()
    except (z.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]
    at = made.find(OFFSETS)
    return made[at + len(OFFSETS) :] if made.startswith(MAGIC) and at > 0 else made


class Gains:
    """The gains of a text's windows: compressed length with the ordinary dictionary and as many zero bytes, less that
    with the toxic one in their place, so that whatever the ordinary one has is as far away in both. Matches have five
    bytes or more, and no entropy coding blurs the lengths of such short windows."""

    def __init__(self, content: tuple[bytes, bytes]):
        import zstandard as z

        toxic, ordinary = content
        params = z.ZstdCompressionParameters(strategy=z.STRATEGY_LAZY2, min_match=5, hash_log=15, chain_log=15, search_log=6, target_length=64, window_log=17, write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS)
        self.sides = []
        for held in (ordinary + bytes(len(toxic)), ordinary + toxic):
            held = z.ZstdCompressionDict(held.rjust(16), dict_type=z.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            self.sides.append(z.ZstdCompressor(dict_data=held, compression_params=params).compress)

    def __call__(self, text: str | None) -> list[int]:
        ordinary, toxic = self.sides
        return [len(ordinary(w)) - len(toxic(w)) for w in windows(plain(text))]

    def features(self, text: str | None) -> list[float]:
        """The three largest gains, how many windows gain at least each of LEVELS, how many there are, and the largest
        share of LEVELS' middle."""
        gains = np.array(self(text))
        top = np.sort(gains)[::-1][:3].clip(-4, 16)
        top = [*top.tolist(), *[-4] * (3 - len(top))]
        counts = [int((gains >= k).sum()) for k in LEVELS]
        return [*map(float, top), *(math.log1p(n) for n in counts), math.log1p(len(gains)), counts[3] / len(gains)]


@dataclass
class Model:
    content: tuple[bytes, bytes]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, features: np.ndarray) -> np.ndarray:
        x = np.c_[(features - self.mean) / self.scale, np.ones(len(features))]
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (the last one constant) by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, l2), 1e-9]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if abs(step).max() < 1e-9:
            break
    return w


def train(toxic: list[str], ordinary: list[str], folds: int = 4) -> Model:
    """Dictionaries from all texts; the calibration from gains of each fold under dictionaries of the others.

    Without texts of both kinds the score is the share of toxic ones.
    """
    texts, label = [*toxic, *ordinary], np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))]
    sample, fold = Sample([plain(t) for t in texts]), np.arange(len(texts)) % folds
    both = lambda use: [np.flatnonzero(use & (label == v)).tolist() for v in (1, 0)]
    rows = np.zeros((len(texts), FEATURES))
    for k in range(folds):
        gains = Gains(sample.dictionaries(*both(fold != k)))
        for i in np.flatnonzero(fold == k):
            rows[i] = gains.features(texts[i])
    content = sample.dictionaries(*both(fold >= 0))
    if not len(label) or label.min() == label.max():
        share = float(label.mean()) if len(label) else 0.0
        odds = math.log((share + 1e-6) / (1 - share + 1e-6))
        return Model(content, np.zeros(FEATURES), np.ones(FEATURES), np.r_[np.zeros(FEATURES), odds])
    mean, scale = rows.mean(0), rows.std(0) + 1e-6
    return Model(content, mean, scale, logistic((rows - mean) / scale, label))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: tuple[int, int], longest: int) -> tuple[list[str], list[str]]:
    """At most ``most`` toxic and ordinary texts of up to ``longest`` characters, in the order of a hash of their text."""
    # only ids and hashes are joined and sorted; the chosen rows, few by their limits, then meet the texts
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.length(text_col).alias("n")).where(F.col("n") <= longest)
    rows = own.join(labels, "doc_id").groupBy("toxic", "h").agg(F.min("doc_id").alias("doc_id"))
    pick = lambda t, n: rows.where(F.col("toxic") == t).orderBy("h").limit(n)
    chosen = F.broadcast(pick(1, most[0]).unionByName(pick(0, most[1])))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).join(chosen, ["doc_id", "h"])
    got = texts.select("toxic", "h", "text").distinct().collect()
    by = lambda t: [r["text"] for r in sorted(got, key=lambda r: (r["h"], r["text"])) if r["toxic"] == t]
    return by(1), by(0)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: tuple[int, int] = (1500, 3000), longest: int = 20_000) -> Model:
    """Trains on a bounded sample (``most``, ``longest``) of the labelled rows whose crc32 of the id's text leaves
    a remainder other than 1 when divided by 3; the other third is never looked at.

    Null ids, labels and texts are left out, and so is an id that is labelled both ways. Rows that repeat an id with
    different texts all take its label, equal texts count once. No labels, or no documents, make a model that scores
    all alike. Other columns are not read.
    """
    usable = labels.select(F.col(id_col).alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null")
    usable = usable.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    usable = usable.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    return train(*labelled_sample(docs, usable, id_col, text_col, most, longest))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``, from its whole text.

    Null texts count as empty ones, which have one blank window; repeated rows give repeated results; an empty table
    gives none. No column but the text enters the score.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gains = Gains(model.content)
        for batch in batches:
            x = np.array([gains.features(t) for t in batch["text"]]).reshape(len(batch), FEATURES)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": model.probability(x)})

    scored = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(score, "doc_id bigint, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
