"""Periodic runs, phrase fingerprints and spelling variants against brute force and on odd rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import periodic_runs, phrase_fingerprint, spelling_variants
from lodestone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# periodic runs


def plain_runs(words, least=6, times=4):
    """Every period compared at every place."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids, found = np.array([number[w] for w in words], np.int64), {}
    for q in range(1, len(words) // times + 1):
        same = np.concatenate(([False], ids[:-q] == ids[q:], [False])).astype(int)
        edge = np.diff(same)
        for start, stop in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if stop + q - start >= max(least, times * q):
                found.setdefault((start, stop + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_by_plain_search():
    rng = random.Random(1)
    for _ in range(200):
        batch = []
        for _ in range(rng.randint(0, 5)):
            n, k = rng.choice([0, 1, 3, 6, 7, 10, 30, 80, 200]), rng.choice([1, 2, 3, 5])
            t = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 4))
                t = [x if i < a else t[a + (i - a) % p] for i, x in enumerate(t)]
            batch.append(t)
        got = periodic_runs.find_runs([np.array(t, np.int64) for t in batch])
        assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(t) for t in batch]


def test_extensions_by_plain_comparison():
    rng = np.random.default_rng(2)
    for n, k in ((1, 1), (5, 2), (40, 1), (300, 2), (500, 9)):
        word = np.append(rng.integers(0, k, n), k)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
        i, j = i[i != j], j[i != j]
        want = []
        for a, b in zip(i, j, strict=True):
            m = 0
            while a + m <= n and b + m <= n and word[a + m] == word[b + m]:
                m += 1
            want.append(m)
        assert periodic_runs.Extensions(word).common(i, j).tolist() == want


def test_op12_by_plain_search(spark, texts):
    got = sorted(tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SF).collect())
    assert got == sorted(plain_digest(i, t) for i, t in texts.items())
    assert sum(r[1] > 0 for r in got) > 5


def test_runs_on_odd_rows(spark, odd_documents, no_documents):
    got = collections.Counter(tuple(r) for r in periodic_runs.run_digests(odd_documents).collect())
    assert got == collections.Counter(plain_digest(r.doc_id, r.text) for r in odd_documents.collect())
    assert periodic_runs.run_digests(no_documents).count() == periodic_runs.periodic_runs(no_documents).count() == 0
    rows = spark.createDataFrame([(1, "x a b a b a b a b c"), (2, "k " * 9 + "end"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(rows).collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 8, 2)] and got[1].collapsed == "x a b c"
    assert [tuple(r) for r in got[2].runs] == [(0, 9, 1)] and got[2].collapsed == "k end"
    assert (got[3].n_words, got[3].runs, got[3].collapsed) == (0, [], "")


# phrase fingerprints


def plain_phrases(text):
    seen, at = set(), 0
    for stop in range(1, len(text) + 1):
        if text[at:stop] not in seen:
            seen.add(text[at:stop])
            at = stop
    return seen | ({text[at:]} - {""})


def plain_likeness(a, b):
    """Exact, of phrase sets small enough to be kept whole."""
    a, b = plain_phrases(a), plain_phrases(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def test_phrases_by_plain_parse():
    rng = random.Random(3)
    some = lambda k, n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyé😀"[-k:]) for _ in range(n))
    for _ in range(400):
        k = rng.choice([1, 2, 4, 26])
        text, other = some(k, rng.choice([0, 1, 3, 4, 5, 9, 40, 300])), some(k, rng.choice([0, 1, 5, 200]))
        own = phrase_fingerprint.Parsed(1, text)
        pieces = {text[a:b] for a, b in itertools.pairwise([0, *own.ends])}
        assert pieces == plain_phrases(text)
        edited, sign = own.edited(other)
        assert edited == phrase_fingerprint.spliced(text, other)
        again = phrase_fingerprint.Parsed(1, edited)
        assert np.array_equal(sign, again.sign)
        if len(plain_phrases(text) | plain_phrases(edited)) <= phrase_fingerprint.KEPT:
            assert phrase_fingerprint.likeness_of(own.sign, sign) == pytest.approx(plain_likeness(text, edited))


def plain_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = {}
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        one, two, three = (phrase_fingerprint.Parsed(None, t).sign for t in (text, edited, after))
        w = phrase_fingerprint.written
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), w(one), w(two), phrase_fingerprint.likeness_of(one, two), phrase_fingerprint.likeness_of(one, three))
    return out


def test_op11_by_plain_order(spark, texts):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_phrase_fingerprint"](spark, SF).collect()}
    assert got == plain_edits(list(texts.items()))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_fingerprints_on_odd_rows(spark, odd_documents, no_documents, parts):
    got = phrase_fingerprint.edited_likeness(odd_documents.repartition(3), parts=parts).collect()
    assert len(got) == odd_documents.count()
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    want = plain_edits([r for r in rows if r[0] != 1] + [r for r in rows if r[0] == 1][:1])
    plain = {r.doc_id: tuple(r)[1:] for r in got if r.doc_id != 1}
    assert plain == {k: v for k, v in want.items() if k != 1}
    # of two equal rows one is followed by the other
    twice = [tuple(r)[1:] for r in got if r.doc_id == 1]
    assert want[1] in twice and any(r[-1] == 1.0 for r in twice)
    assert phrase_fingerprint.edited_likeness(no_documents).count() == 0


def test_many_equal_rows_and_null_ids_spread(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, 7).alias("doc_id"), F.when(F.col("id") < 2000, F.lit("the same words")).otherwise(F.concat(F.lit("own text "), "id")).alias("text"))
    got = phrase_fingerprint.edited_likeness(rows, parts=16)
    assert got.count() == 3000
    assert got.where("doc_id = 7 and near_next = 1").count() == 1499  # all but the last, which a null id follows
    one = phrase_fingerprint.edited_likeness(rows.limit(1), parts=4).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprint_columns(spark, odd_documents):
    prints = phrase_fingerprint.fingerprints(odd_documents)
    near = prints.select("doc_id", "n_phrases", phrase_fingerprint.likeness(F.col("fingerprint"), F.lit("")).alias("empty"), phrase_fingerprint.likeness(F.col("fingerprint"), F.col("fingerprint")).alias("own"))
    for r in near.collect():
        assert r.own == 1.0 and r.empty == (1.0 if r.n_phrases == 0 else 0.0)


def test_copies_are_nearer_than_others(spark, texts):
    got = [r for r in QUERIES["op11_phrase_fingerprint"](spark, SF).collect() if r.n_chars > 200]
    assert sum(r.near_edited > r.near_next for r in got) > 0.97 * len(got)


# spelling variants


def plain_words(rows):
    count = collections.Counter()
    for doc_id, text in rows:
        for run in LETTERS.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def plain_variants(words):
    groups = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            groups[w[:i] + "*" + w[i + 1 :]].add(w)
    near = collections.defaultdict(set)
    for g in groups.values():
        for w in g:
            near[w] |= g - {w}
    for w in words:
        for i in range(len(w)):
            if (d := w[:i] + w[i + 1 :]) in words:
                near[w].add(d)
                near[d].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_op13_by_plain_search(spark, texts):
    got = QUERIES["op13_spelling_variants"](spark, SF).collect()
    want = plain_variants(plain_words(texts.items()))
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(r.n_near > 0 for r in got) > 100 and any(r.form for r in got)


@pytest.mark.parametrize(("letters", "least", "most"), [("abé", 1, 1 << 18), ("abcdef", 2, 64), ("ab", 1000, 1 << 18)])
def test_variants_of_dense_words(spark, letters, least, most):
    """Words so alike that lists are long, under dictionaries from empty to full."""
    rng = random.Random(7)
    words = {"".join(rng.choice(letters) for _ in range(rng.choice([7, 8, 9, 12]))): 2 * 7 ** rng.randrange(6) for _ in range(500)}
    words["x" * 3000] = 5
    words["x" * 3001] = 500
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling_variants.variants(df, most_grams=most, least_list=least).collect()
    assert {tuple(r) for r in got} == plain_variants(words) and len(got) == len(words)


def test_variant_chains_end_at_the_root(spark):
    words = [("abcdefgh", 2), ("abcdefghi", 20), ("abcdefghij", 200), ("abcdefghijk", 2000), ("abcdefghijkl", 20_000), ("zzzzzzz", 9)]
    got = {r.word: r for r in spelling_variants.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert {r.root for w, r in got.items() if w != "zzzzzzz"} == {"abcdefghijkl"} and got["zzzzzzz"].root == "zzzzzzz"
    assert (got["abcdefgh"].form, got["abcdefgh"].form_n, got["abcdefgh"].n_near) == ("abcdefghi", 20, 1)
    with pytest.raises(ValueError):
        spelling_variants.variants(spark.createDataFrame([("short", 3)], "word string, n long"))


def test_variants_on_odd_rows(spark, odd_documents, no_documents):
    got = {tuple(r) for r in spelling_variants.document_variants(odd_documents).collect()}
    assert got == plain_variants(plain_words([(r.doc_id, r.text) for r in odd_documents.collect()]))
    assert spelling_variants.document_variants(no_documents).count() == 0
    small = spelling_variants.word_counts(odd_documents, most_held=1)  # counts passed on after each document
    assert {tuple(r) for r in small.collect()} == set(plain_words([(r.doc_id, r.text) for r in odd_documents.collect()]).items())
    nulls = spark.createDataFrame([(None, 3), ("abcdefg", None), ("abcdefg", 4)], "word string, n long")
    assert [tuple(r) for r in spelling_variants.variants(nulls).collect()] == [("abcdefg", None, "abcdefg", 4, 0, None)]
