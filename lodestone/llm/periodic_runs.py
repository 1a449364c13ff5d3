"""Periodic runs of words, found on a harmonic grid by longest common extensions over difference-cover samples."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import slices

#: A difference cover modulo 7: any two positions have a shift below 7 that puts both on it.
MODULUS, COVER = 7, (1, 2, 4)
_SLOT = np.full(MODULUS, -1)
_SLOT[list(COVER)] = range(len(COVER))
_SHIFT = np.array([[min(d for d in range(MODULUS) if (i + d) % MODULUS in COVER and (j + d) % MODULUS in COVER) for j in range(MODULUS)] for i in range(MODULUS)])


class Extensions:
    """Longest common extensions of positions of ``word`` (numbers from 0).

    Only suffixes that begin on the cover are sorted: by their first ``MODULUS`` words, then by twice as many in each
    round, until all differ. Two positions are compared word by word until a shift puts both on the cover, which is less
    than ``MODULUS`` words away; what they then share is a minimum over the prefixes that neighbours in the order have
    in common. No two positions may share all that follows them: texts end in words of their own.
    """

    def __init__(self, word: np.ndarray):
        n = -(-len(word) // MODULUS) * MODULUS + MODULUS
        top = int(word.max(initial=0)) + 1
        # positions behind the end are words of their own
        self.word = np.concatenate((word, np.arange(top, top + n - len(word)), np.zeros(MODULUS, np.int64)))
        at = np.flatnonzero(_SLOT[np.arange(n) % MODULUS] >= 0)
        self.levels = self._sort(at, top + n)
        self.table = self._minima(self._neighbours(at))

    def _sort(self, at: np.ndarray, top: int) -> list[np.ndarray]:
        """The order of the sampled suffixes; their ranks by 7, 14, 28, ... words, each the place of its first equal."""
        m, bits = len(at), top.bit_length()
        keys, held = [], 63
        for k in range(MODULUS):  # words packed into as few numbers as hold them
            if held + bits > 63:
                keys.append(np.zeros(m, np.int64))
                held = 0
            keys[-1] = (keys[-1] << bits) | self.word[at + k]
            held += bits
        self.order = np.lexsort(keys[::-1])
        new = np.ones(m, bool)
        new[1:] = np.any([k[self.order[1:]] != k[self.order[:-1]] for k in keys], axis=0)
        place = np.arange(m)
        ranks, step = [], len(COVER)
        while True:
            rank = np.zeros(m + 1, np.int64)
            rank[self.order] = np.maximum.accumulate(np.where(new, place, 0)) + 1
            ranks.append(rank)  # the last entry, 0, stands for all behind the end
            alone = new & np.append(new[1:], True)
            if alone.all():
                return ranks
            open_ = np.flatnonzero(~alone)
            own = self.order[open_]
            following = rank[np.minimum(own + step, m)]
            resorted = np.lexsort((following, rank[own]))
            own, following = own[resorted], following[resorted]
            self.order[open_] = own
            new[open_[1:]] |= (rank[own[1:]] != rank[own[:-1]]) | (following[1:] != following[:-1])
            step *= 2

    def _neighbours(self, at: np.ndarray) -> np.ndarray:
        """How many words each sampled suffix shares with the one before it in the order."""
        m = len(at)
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        shared = np.zeros(m - 1, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            same = (rank[np.minimum(a, m)] == rank[np.minimum(b, m)]) & (np.maximum(a, b) < m)
            a, b = a + same * (len(COVER) << k), b + same * (len(COVER) << k)
            shared += same * (MODULUS << k)
        p, q = at[self.order[:-1]] + shared, at[self.order[1:]] + shared
        alive = np.ones(m - 1, bool)
        for _ in range(MODULUS - 1):
            alive &= self.word[np.minimum(p, len(self.word) - 1)] == self.word[np.minimum(q, len(self.word) - 1)]
            p, q, shared = p + alive, q + alive, shared + alive
        return np.concatenate(([0], shared))

    @staticmethod
    def _minima(shared: np.ndarray) -> list[np.ndarray]:
        """Minima over 1, 2, 4, ... entries from each place on."""
        table, wide = [shared.astype(np.int32)], 1
        while 2 * wide <= len(shared):
            last = table[-1]
            table.append(np.minimum(last[:-wide], last[wide:]))
            wide *= 2
        return table

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words the positions i and j, which differ, share from there on."""
        shift = _SHIFT[i % MODULUS, j % MODULUS]
        out = np.zeros(len(i), np.int64)
        alive = np.ones(len(i), bool)
        for k in range(MODULUS - 1):
            alive &= (k >= shift) | (self.word[i + k] == self.word[j + k])
            out += alive & (k < shift)
        x, y = i[alive] + shift[alive], j[alive] + shift[alive]
        rank = self.levels[-1]
        x, y = (rank[len(COVER) * (v // MODULUS) + _SLOT[v % MODULUS]] - 1 for v in (x, y))
        lo, hi = np.minimum(x, y) + 1, np.maximum(x, y) + 1  # the entries between them, the last one in
        level = np.frexp((hi - lo).astype(float))[1] - 1
        least = np.zeros(len(lo), np.int64)
        for k in np.unique(level):
            at = level == k
            least[at] = np.minimum(self.table[k][lo[at]], self.table[k][hi[at] - (1 << int(k))])
        out[alive] += least
        return out


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts (numbers from 0) as one sequence, in which no two share a number and each ends in one of its own, and
    where each begins."""
    out, at, base = [], np.zeros(len(texts) + 1, np.int64), 0
    for k, t in enumerate(texts):
        top = int(t.max(initial=-1)) + 1
        out += [t + base, np.array([base + top])]
        base += top + 1
        at[k + 1] = at[k] + len(t) + 1
    return np.concatenate(out) if out else np.zeros(0, np.int64), at


def find_runs(texts: list[np.ndarray], least_words: int = 6, least_times: int = 4) -> list[np.ndarray]:
    """(start, length, period) rows by start and period: of each text (word numbers from 0) every run, a stretch of its
    words with smallest period q and at least max(``least_words``, ``least_times`` * q) words that no neighbouring word
    extends keeping that period.

    Words q apart agree at least (``least_times`` - 1) * q times in a row in such a run, so one of the grid's points,
    that many apart, is among them, and so is a point beside it. Where both agree, extensions to both sides give the
    run. All periods together look at n log n points.
    """
    step = least_times - 1
    if step < 1 or least_words < least_times + 2:
        raise ValueError("runs repeat twice at least, and a period of one word must agree three times in a row")
    word, at = _joined(texts)
    points, periods = [], []
    for q in range(1, max(map(len, texts), default=0) // least_times + 1):
        i = np.flatnonzero(word[: -q : step * q] == word[q :: step * q]) * (step * q)
        if step * q > 1 and len(i):
            left, right = np.maximum(i - 1, 0), np.minimum(i + 1, len(word) - q - 1)
            i = i[((i > 0) & (word[left] == word[left + q])) | ((i + q + 1 < len(word)) & (word[right] == word[right + q]))]
        if len(i):
            points.append(i)
            periods.append(np.full(len(i), q))
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(texts)
    if not points:
        return out
    i, q = np.concatenate(points), np.concatenate(periods)
    # only texts with such points are sorted
    text = np.searchsorted(at, i, "right") - 1
    held = np.unique(text)
    word, new = _joined([texts[k] for k in held])
    own = np.searchsorted(held, text)
    i = i - at[text] + new[own]
    ahead, back = Extensions(word), Extensions(word[::-1].copy())
    n = len(word)
    stop = i + q + ahead.common(i, i + q)
    # in the other direction, the words before both positions; at the first word there are none
    start = i.copy()
    inner = i > 0
    start[inner] -= back.common(n - i[inner], n - i[inner] - q[inner])
    long = stop - start >= np.maximum(least_words, least_times * q)
    start, stop, q, own = start[long], stop[long], q[long], own[long]
    order = np.lexsort((q, stop, start))
    start, stop, q, own = start[order], stop[order], q[order], own[order]
    first = np.ones(len(start), bool)  # a stretch counts with its smallest period
    first[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, q, own = start[first], stop[first], q[first], own[first]
    found = np.column_stack([start - new[own], stop - start, q])[np.lexsort((q, start))]
    own = own[np.lexsort((q, start))]
    cuts = np.searchsorted(own, np.arange(len(held) + 1))
    for k, text_no in enumerate(held):
        out[text_no] = found[cuts[k] : cuts[k + 1]]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: all but those of a run behind its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def numbered(words: list[bytes]) -> np.ndarray:
    """Numbers from 0 for words, in first-seen order."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def rehearsed(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words that a rehearsal puts in place of n words, by number: for one document in ten, chosen by a checksum of
    its id, all from some word on repeat a first few. None for the others and for a null id."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _documents(batch: pa.RecordBatch, rehearse: bool) -> Iterator[tuple[list, list[list[bytes]], list[np.ndarray]]]:
    """Ids, words and runs of a batch (doc_id, text), a slice of bounded text at a time."""
    texts = batch.column("text").cast(pa.large_string()).fill_null("")
    sizes = np.array([len(t) for t in texts.to_pylist()], np.int64)
    for lo, hi in slices(np.concatenate(([0], np.cumsum(sizes)))):
        ids = batch.column("doc_id").slice(lo, hi - lo).to_pylist()
        words = [t.encode().split() for t in texts.slice(lo, hi - lo).to_pylist()]
        if rehearse:
            for k, (doc_id, w) in enumerate(zip(ids, words, strict=True)):
                if (new := rehearsed(doc_id, len(w))) is not None:
                    words[k] = [w[i] for i in new.tolist()]
        yield ids, words, find_runs([numbered(w) for w in words])


def _standard(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (an array of start, length and period, in words between white
    space, by start and period) and collapsed, the words that stay when each run keeps its first period alone, joined
    by single spaces. Texts are read whole, one slice of about a million characters at a time.

    Null texts are empty, and without words there are no runs; repeated rows give repeated results; null ids stay null;
    an empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, runs in _documents(batch, False):
                rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own.tolist()] for own in runs]
                texts = [b" ".join(compress(w, kept_words(len(w), own))).decode() for w, own in zip(words, runs, strict=True)]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(list(map(len, words)), pa.int64()), "runs": pa.array(rows, kind), "collapsed": pa.array(texts, pa.string())})

    return _standard(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


DIGESTS = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` after the rehearsal (see ``rehearsed``): how many runs, the one that repeats its
    period most often (ties: the first, then the shortest period), and digests of all runs and of the collapsed text.
    Odd rows as in periodic_runs; without a run, four nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, runs in _documents(batch, True):
                rows = []
                for doc_id, w, own in zip(ids, words, runs, strict=True):
                    found, best = own.tolist(), None
                    for s, n, q in found:  # in the order that ties want
                        if best is None or n * best[2] > best[1] * q:
                            best = (s, n, q)
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                    kept = w if not found else compress(w, kept_words(len(w), own))
                    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
                    rows.append((doc_id, len(found), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
                names = [c.split()[0] for c in DIGESTS.split(", ")]
                kinds = [pa.string() if c.endswith("string") else pa.int64() for c in DIGESTS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _standard(docs, id_col, text_col).mapInArrow(run, DIGESTS)
