"""Quality rules as a short-circuit cascade: the rules that reject most for their cost run first."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import slices, utf8
from lodestone.llm.text_arrays import WHITE, Runs, byte_set, runs, windows

SYMBOLS = byte_set(b"#*$%&|<>")
NEWLINE = byte_set(b"\n")
UPPER, LOWER = byte_set(bytes(range(65, 91))), byte_set(bytes(range(97, 123)))


class Texts:
    """Some texts and their features. A feature is computed when first asked for and then kept; a selection of the
    texts takes along what is already known, and copies their bytes only when they are asked for."""

    def __init__(self, raw: np.ndarray | None, bounds: np.ndarray, whole: Texts | None = None, keep: np.ndarray | None = None):
        self._raw, self.bounds, self.whole, self.keep, self.known, self.spent = raw, bounds, whole, keep, {}, {}

    @property
    def raw(self) -> np.ndarray:
        if self._raw is None:
            self._raw = self.whole.raw[np.repeat(self.keep, np.diff(self.whole.bounds))]
        return self._raw

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def __getattr__(self, name: str) -> np.ndarray:
        if name not in FEATURES:
            raise AttributeError(name)
        if name not in self.known:
            for other in FEATURES[name][0]:
                getattr(self, other)
            began = time.thread_time()
            self.known[name] = FEATURES[name][1](self)
            self.spent[name] = time.thread_time() - began
        return self.known[name]

    def take(self, keep: np.ndarray) -> Texts:
        some = Texts(None, np.concatenate(([0], np.cumsum(np.diff(self.bounds)[keep]))), self, keep)
        some.known = {k: v[keep] for k, v in self.known.items() if k != "words"}
        return some

    def find_words(self) -> Runs:
        """Runs between white space, or those of the whole that this is a selection of."""
        if self.whole is None or "words" not in self.whole.known:
            return runs(self.raw, self.bounds, WHITE)
        w, keep, sizes = self.whole.known["words"], self.keep, np.diff(self.whole.bounds)
        kept, new_row = keep[w.row], np.cumsum(keep) - 1
        gone = np.where(keep, 0, sizes).cumsum() - np.where(keep, 0, sizes)  # bytes of texts before that aren't kept
        row = w.row[kept]
        return Runs(new_row[row], w.start[kept] - gone[row], w.size[kept], w.hash[kept], w.inside[np.repeat(keep, sizes)])

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """How many of the marked bytes each text has."""
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def _lines(t: Texts) -> np.ndarray:
    """Lines with a word, and those of them equal to an earlier line, side by side."""
    lines = runs(t.raw, t.bounds, NEWLINE)
    inside = np.concatenate(([0], np.cumsum(t.words.inside, dtype=np.int64)))
    worded = inside[lines.start + lines.size] > inside[lines.start]
    row, h = lines.row[worded], lines.hash[worded]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    again = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
    return np.column_stack([np.bincount(row, minlength=len(t)), np.bincount(row[1:][again], minlength=len(t))])


def _repeat_words(t: Texts) -> np.ndarray:
    """Words in three-word windows that a text has twice or more."""
    w = t.words
    h, first = windows(w.row, w.hash, 3)
    row = w.row[first]
    order = np.lexsort((h, row))
    same = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(w.row), bool)
    for k in range(3):
        covered[first[twice] + k] = True
    return np.bincount(w.row[covered], minlength=len(t))


#: Features by name: those that it is made from, and how.
FEATURES: dict[str, tuple[tuple[str, ...], Callable[[Texts], np.ndarray]]] = {
    "words": ((), lambda t: t.find_words()),
    "n_words": (("words",), lambda t: np.bincount(t.words.row, minlength=len(t))),
    "word_chars": (("words",), lambda t: t.per_row(t.words.inside & (t.raw & 0xC0 != 0x80))),
    "n_symbols": ((), lambda t: t.per_row(SYMBOLS[t.raw])),
    "n_upper": ((), lambda t: t.per_row(UPPER[t.raw])),
    "n_lower": ((), lambda t: t.per_row(LOWER[t.raw])),
    "lines": (("words",), _lines),
    "n_lines": (("lines",), lambda t: t.lines[:, 0]),
    "n_dup_lines": (("lines",), lambda t: t.lines[:, 1]),
    "n_repeat_words": (("words",), _repeat_words),
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` marks the texts that fail, from the features named in ``needs``."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Texts], np.ndarray]
    base: bool = False


RULES = (
    Rule("few words", ("n_words",), lambda t: t.n_words < 50, True),
    Rule("repeated windows", ("n_words", "n_repeat_words"), lambda t: 100 * t.n_repeat_words > 50 * t.n_words, True),
    Rule("symbols", ("n_words", "n_symbols"), lambda t: 10 * t.n_symbols > t.n_words),
    Rule("repeated lines", ("n_lines", "n_dup_lines"), lambda t: 2 * t.n_dup_lines > t.n_lines),
    Rule("capitals", ("n_upper", "n_lower"), lambda t: t.n_upper > t.n_lower),
    Rule("word length", ("n_words", "word_chars"), lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 20 * t.n_words)),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, Texts]]:
    raw, bounds = utf8(batch.column(column))
    for lo, hi in slices(bounds):
        yield lo, hi, Texts(raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])


def cascade(texts: Texts, rules: tuple[Rule, ...]) -> np.ndarray:
    """The places of the texts that pass all rules; each rule sees only what the rules before it let through."""
    alive = np.arange(len(texts))
    for rule in rules:
        if not len(alive):
            break
        passed = ~rule.rejects(texts)
        if not passed.all():
            alive, texts = alive[passed], texts.take(passed)
    return alive


def _closure(names: tuple[str, ...]) -> set[str]:
    """The features named and all that they are made from."""
    return set(names).union(*(_closure(FEATURES[n][0]) for n in names))


def greedy_order(rules: tuple[Rule, ...], patterns: dict[int, int], cost: dict[str, float], known: frozenset[str] = frozenset(), compare: float = 1e-6) -> tuple[Rule, ...]:
    """The rule first that rejects most per second, then the one that rejects most per second of what that one lets
    through, and so on. ``patterns`` has how many rows each set of rules (as bits) rejects, ``cost`` the seconds of
    each feature; features that earlier rules asked for, or that are ``known`` anyway, cost nothing more."""
    left, have, out = list(range(len(rules))), set(known), []
    while left:

        def worth(k: int) -> float:
            hits = sum(n for p, n in patterns.items() if p >> k & 1)
            return hits / (compare + sum(cost.get(f, 0.0) for f in _closure(rules[k].needs) - have))  # noqa: B023

        best = max(left, key=lambda k: (worth(k), -k))
        left.remove(best)
        out.append(rules[best])
        have |= _closure(rules[best].needs)
        patterns = {p: n for p, n in patterns.items() if not p >> best & 1}
    return tuple(out)


def order_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, seed: int = 17, known: frozenset[str] = frozenset()) -> tuple[Rule, ...]:
    """The rules in the order of greedy_order, from a sample of about ``sample_rows`` rows: Spark tasks measure which
    rules reject each row and the CPU seconds of each feature; sums per set of rules and per feature come back. The
    order changes how long a cascade takes, never what it keeps. (Parquet counts its rows without reading them.)"""
    n = docs.count()
    if not n:
        return rules
    sample = docs.select(F.col(text_col).alias("text")).sample(min(1.0, sample_rows / n), seed)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, spent = Counter(), Counter()
        for batch in batches:
            for _, _, texts in texts_of(batch, "text"):
                bits = sum(rule.rejects(texts).astype(np.int64) << k for k, rule in enumerate(rules))
                seen.update(bits.tolist())
                spent.update(texts.spent)
        kind, value = [*["rules"] * len(seen), *spent], [*seen, *[0] * len(spent)]
        yield pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.string()), "bits": pa.array(value, pa.int64()), "n": pa.array([*map(float, seen.values()), *spent.values()], pa.float64())})

    got = sample.mapInArrow(measure, "kind string, bits bigint, n double").groupBy("kind", "bits").agg(F.sum("n").alias("n")).collect()  # at most 2^rules rows
    patterns = {r["bits"]: r["n"] for r in got if r["kind"] == "rules" and r["bits"]}
    return greedy_order(rules, patterns, {r["kind"]: r["n"] for r in got if r["kind"] != "rules"}, known)


def filter_documents(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose whole text passes every rule.

    Null texts are empty and fail the rule on few words; repeated rows fare alike; an empty table stays empty;
    other columns, whatever they hold, pass through unread.
    """
    ordered = order_rules(docs, text_col, rules)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = utf8(batch.column(at))
            for lo, hi in slices(bounds):
                texts = Texts(raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                kept = cascade(texts, ordered)
                if len(kept):
                    yield batch.slice(lo, hi - lo).take(pa.array(kept))

    return docs.mapInArrow(keep, docs.schema)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: the counts of its whole text, base_failed and kept.

    All counts are in the result and so are computed for every text. The cascade runs over them as they are; what
    else its rules ask for is computed for those texts alone that the rules before let through. Nulls, repeated rows
    and empty tables as in filter_documents.
    """
    ordered = order_rules(docs, text_col, rules, known=frozenset(_closure(COUNTS)))
    base = [r for r in rules if r.base]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in texts_of(batch, "text"):
                counts = {c: pa.array(getattr(texts, c), pa.int64()) for c in COUNTS}
                failed = np.any([r.rejects(texts) for r in base], axis=0) if base else np.zeros(hi - lo, bool)
                kept = np.zeros(hi - lo, bool)
                kept[cascade(texts, ordered)] = True
                columns = {"doc_id": batch.column("doc_id").slice(lo, hi - lo), **counts}
                yield pa.RecordBatch.from_pydict(columns | {"base_failed": pa.array(failed), "kept": pa.array(kept)})

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean")


ORACLE = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM worded))),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n > 1) GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
    length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS n_lower
  FROM worded LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT 10 * n_symbols > n_words AND NOT 2 * n_dup_lines > n_lines AND NOT n_upper > n_lower
  AND NOT (word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM judged
"""
