"""The first ten operators on odd inputs and against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, license_scan, media_audio, mixing, ngram_join, packing, quality_classifier, quality_rules, shared, token_counts, tokens, toxicity

SF = "/root/testdata/sf0.001"
WHITE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def encode(text, special_as_text=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    t.encode_special_tokens = special_as_text
    return t.encode(text, add_special_tokens=False).ids


# 1: media


def test_media_round_trip(odd_documents, no_documents):
    got = media_audio.media_digests(odd_documents).collect()
    texts = [r.text or "" for r in odd_documents.collect()]
    want = collections.Counter()
    for t in texts:
        raw = t.encode()
        raw += bytes(-len(raw) % 64 or (0 if raw else 64))
        want[len(t.encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:])] += 1
    assert collections.Counter((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert all("bad_crc=0;junk=0" in r.feature and "table=ok" in r.feature for r in got)
    assert media_audio.media_digests(no_documents).count() == 0


def test_reader_finds_frames_again():
    good = media_audio.write_mpeg(bytes(range(256)) * 40)
    at = media_audio.read_mpeg(good)["frame_offsets"]
    junk = good[: at[2]] + b"\xff\xfbnot a frame\xff" * 3 + good[at[2] :]
    read = media_audio.read_mpeg(junk)
    assert read["frames"] == len(at) and read["junk_bytes"] == 42 and not read["seek_ok"]
    assert read["payload"] == bytes(range(256)) * 40
    flipped = bytearray(good)
    flipped[at[1] + 6] ^= 1
    assert media_audio.read_mpeg(bytes(flipped))["bad_crc"] == 1
    cut = media_audio.read_mpeg(good[: at[-1] + 50])
    assert cut["frames"] == len(at) - 1 and cut["junk_bytes"] == 50
    tagged = media_audio.read_mpeg(good + b"TAG" + bytes(125))
    assert tagged["frames"] == len(at) and tagged["tag_bytes"] == media_audio.read_mpeg(good)["tag_bytes"] + 128
    assert media_audio.read_mpeg(b"")["frames"] == 0 and media_audio.read_mpeg(b"\xff" * 100)["frames"] == 0


def test_reader_knows_other_streams():
    """Layer II without CRC, and a VBRI table."""
    head = bytes((0xFF, 0xFD, 0x10, 0x00))
    size, samples, rate, *_ = media_audio.header(head)
    stream = (head + bytes(size - 4)) * 5
    read = media_audio.read_mpeg(stream)
    assert (read["frames"], read["samples"], read["rate"], read["duration_us"]) == (5, 5 * samples, rate, 5 * samples * 10**6 // rate)
    head = bytes((0xFF, 0xFB, 0x10, 0xC0))
    size = media_audio.header(head)[0]
    first = head + bytes(17) + b"VBRI" + struct.pack(">HHHII", 1, 0, 0, 4 * size, 3)
    read = media_audio.read_mpeg(first.ljust(size, b"\0") + (head + bytes(size - 4)) * 3)
    assert read["vbr"] == "VBRI" and read["frames"] == 3 and read["seek_ok"]


def test_tag_letters_inside_a_payload():
    for n in (64, 65, 96, 128, 1500):
        for i in range(n - 2):
            raw = media_audio.padded((b"x" * i + b"TAG").ljust(n, b"x"))
            read = media_audio.read_mpeg(media_audio.write_mpeg(raw))
            assert read["payload"] == raw and read["junk_bytes"] == 0 and read["seek_ok"], (n, i)


def test_tags_and_headers_after_junk():
    good = media_audio.write_mpeg(bytes(range(256)) * 40)
    plain = media_audio.read_mpeg(good)
    read = media_audio.read_mpeg(good + b"junk" + b"TAG" + bytes(125))
    assert (read["frames"], read["junk_bytes"], read["tag_bytes"]) == (plain["frames"], 4, plain["tag_bytes"] + 128)
    head = bytes((0xFF, 0xFB, 0x10, 0xC0))  # no CRC
    size = media_audio.header(head)[0]
    one = head + bytes(size - 4)
    false = b"##" + head + bytes(50)  # a header that nothing follows
    read = media_audio.read_mpeg(one * 3 + false + one * 3)
    assert read["frames"] == 6 and read["junk_bytes"] == len(false)
    tagged = media_audio.read_mpeg(one + b"TAG" + bytes(125))
    assert tagged["frames"] == 1 and tagged["tag_bytes"] == 128 and tagged["junk_bytes"] == 0
    table = (head + bytes(32) + b"VBRI" + struct.pack(">HHHII", 1, 0, 0, 4 * size, 3)).ljust(size, b"\0")
    read = media_audio.read_mpeg(table + one * 3)
    assert read["vbr"] == "VBRI" and read["frames"] == 3 and read["seek_ok"]


def test_fields_delays_and_seek_points(spark):
    good = media_audio.write_mpeg(bytes(5000))
    text = lambda name, enc, body: name + media_audio._syncsafe(len(body) + 1) + b"\0\0" + bytes([enc]) + body
    frames = text(b"TIT2", 3, "Título".encode()) + text(b"TPE1", 1, "Ann".encode("utf-16")) + text(b"TXXX", 0, b"mood\0calm") + b"APIC" + media_audio._syncsafe(3) + b"\0\0abc"
    tag = b"ID3\x04\0\0" + media_audio._syncsafe(len(frames) + 20) + frames + bytes(20)
    old = b"TAG" + b"Old title".ljust(30, b"\0") + b"Bob".ljust(30, b"\0") + b"Songs".ljust(30) + b"1999" + bytes(31)
    read = media_audio.read_mpeg(tag + good + old)
    assert read["tags"] == {"TIT2": "Título", "TPE1": "Ann", "mood": "calm", "payload": "5000", "TALB": "Songs", "TYER": "1999"}
    assert read["payload"] == bytes(5000) and read["junk_bytes"] == 0
    head = bytes((0xFF, 0xFB, 0x90, 0xC0))
    size, samples, rate, *_ = media_audio.header(head)
    one = head + bytes(size - 4)
    lame = head + bytes(17) + b"Info" + struct.pack(">III", 3, 6, 7 * size) + b"LAME3.100".ljust(21, b"\0") + (576 << 12 | 1000).to_bytes(3, "big")
    read = media_audio.read_mpeg(lame.ljust(size, b"\0") + one * 6)
    assert (read["frames"], read["samples"], read["skipped_samples"]) == (6, 6 * samples, 1576) and read["seek_ok"]
    assert read["duration_us"] == (6 * samples - 1576) * 10**6 // rate

    def vbri(points):
        table = struct.pack(f">HHHH{len(points)}H", len(points), 1, 2, 2, *points)
        return (head + bytes(32) + b"VBRI" + struct.pack(">HHHII", 1, 0, 0, 7 * size, 6) + table).ljust(size, b"\0") + one * 6

    assert media_audio.read_mpeg(vbri([2 * size] * 3))["seek_ok"] and not media_audio.read_mpeg(vbri([2 * size, size, size]))["seek_ok"]
    df = spark.createDataFrame([(bytearray(tag + good),), (None,), (bytearray(b"ID3\x04\0\0\0\0\0\x7fT"),)], "media binary")
    got = [r.p for r in df.select(media_audio.probe_mpeg(F.col("media")).alias("p")).collect()]
    assert got[0].tags["TIT2"] == "Título" and got[1].frames == 0 and got[2].frames == 0


# 2: n-gram Jaccard join


def grams(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_links(rows):
    sets, parent, links = [grams(t) for t in rows], list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return links, [find(x) for x in range(len(rows))]


def near_copies(n, seed):
    """A text's copies with a few words changed, so that some are linked only through others."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [256, 16])
def test_near_duplicates_against_all_pairs(spark, texts, block, monkeypatch):
    rows = list(texts.values()) + near_copies(120, 1) + near_copies(40, 2) * 2 + ["a b c", "A  B c", "", " ", "a b"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    real = ngram_join.verified_links
    monkeypatch.setattr(ngram_join, "verified_links", lambda *a: real(*a, block=block))
    got = sorted(ngram_join.near_duplicates(df).collect())
    links, roots = brute_links(rows)
    assert [r.n_links for r in got] == links
    assert [r.class_id for r in got] == roots
    kept = sorted(r.doc_id for r in ngram_join.keep_one_of_each(df).collect())
    assert kept == sorted(set(roots))


def test_near_duplicates_of_odd_rows(odd_documents, no_documents):
    got = ngram_join.near_duplicates(odd_documents).collect()
    by = collections.Counter((r.doc_id, r.class_id, r.n_links) for r in got)
    assert by[1, 1, 1] == 2 and by[2, 2, 2] == by[3, 2, 2] == by[5, 2, 2] == 1 and by[None, None, 0] == 1
    kept = ngram_join.keep_one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 6, 7]
    assert ngram_join.near_duplicates(no_documents).count() == 0 and ngram_join.keep_one_of_each(no_documents).count() == 0


def test_near_duplicates_do_not_depend_on_partitions(spark, documents):
    twice = documents.union(documents)
    for df in (documents, twice):
        a, b = df.repartition(6), df.repartitionByRange(3, "text")
        assert sorted(ngram_join.near_duplicates(a).collect()) == sorted(ngram_join.near_duplicates(b).collect())
        kept = [sorted(r.doc_id for r in ngram_join.keep_one_of_each(x).collect()) for x in (a, b)]
        assert kept[0] == kept[1] and len(set(kept[0])) == len(kept[0])
    rows = [(1, "same words here and there", n) for n in ("x", "y", "z")]
    one = [ngram_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(n)).collect() for n in (1, 3)]
    assert one[0] == one[1] and len(one[0]) == 1


def test_bitmap_never_loses_a_row(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("a"), F.concat(F.lit("k"), F.col("id") % 11).alias("b"))
    wanted = rows.where("a % 50 = 3 or a is null")
    for bits in (1 << 26, 8192):
        got = shared.may_hold(rows, wanted, ["a", "b"], "m", bits).collect()
        assert len(got) == 3000 and all(r.m for r in got if r.a is None or r.a % 50 == 3)
    assert sum(r.m for r in shared.may_hold(rows, wanted, ["a", "b"], "m").collect()) <= wanted.count() + 5
    assert not any(r.m for r in shared.may_hold(rows, wanted.limit(0), ["a", "b"], "m").collect())


def test_bands_reach_their_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999


# 3: packing


def check_packing(got, rows, capacity=2048):
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    want = collections.Counter()
    for doc_id, text in rows:
        ids = [*encode(text or ""), 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    return len(places), sum(r.length for r in got)


def test_packing(documents, texts, odd_documents, no_documents):
    used, total = check_packing(packing.pack_documents(documents).collect(), texts.items())
    assert used <= 1.02 * math.ceil(total / 2048)
    check_packing(packing.pack_documents(odd_documents).collect(), [(r.doc_id, r.text) for r in odd_documents.collect()])
    assert packing.pack_documents(no_documents).count() == 0


@pytest.mark.parametrize("text", ["'one text'", "concat('text ', id)"])
def test_equal_rows_and_null_ids_fill_no_shard(spark, text):
    rows = spark.range(0, 2000, 1, 1).select(F.lit(None).cast("long").alias("doc_id"), F.expr(text).alias("text"))
    got = packing.pack_documents(rows, shard_chars=500).collect()
    assert all(r.doc_id is None and r.piece == r.start == 0 for r in got)
    shards = collections.Counter(r.sequence_id >> 32 for r in got)
    assert len(got) == 2000 and len(shards) > 10 and max(shards.values()) <= 400


def test_open_bins_stay_bounded_and_choose_the_tightest():
    rng, bins = random.Random(3), packing.OpenBins(100, 8)
    free = {}
    for _ in range(2000):
        n = rng.randrange(1, 101)
        fitting = [f for f in free.values() if f >= n]
        at, offset = bins.add(n)
        if fitting:
            assert free[at] == min(fitting) and offset == 100 - free[at]
        elif len(free) == 8:
            del free[min(free, key=lambda k: (free[k], -k))]
        free[at] = free.get(at, 100) - n
        if not free[at]:
            del free[at]
        assert bins.open == sum(map(len, bins.by_free.values())) <= 8
        free = {b: f for f, bs in bins.by_free.items() for b in bs}


@pytest.mark.parametrize("text", ["", "a.b,c..", "É. é. x", "H̱ a", "İstanbul ΣΑΣ σας", "don't it's I'll", "<|endoftext|> hi", "a b\x1cc\x0bd", "12.5, x2 ²", "ﬁ. ǅ", "wow!. x", "á é. x", "x" * 5000])
def test_cached_ids_equal_the_tokenizers(text):
    for special in (False, True):
        assert np.frombuffer(tokens.word_tokenizer(tokens.default_tokenizer(), special).ids(text), "<u4").tolist() == encode(text, special)


def test_plain_words_need_only_the_tokenizers_model(monkeypatch):
    monkeypatch.setattr(tokens._Words, "whole", lambda *_: pytest.fail("a plain word went to the whole tokenizer"))
    text = "l'été, ÉCOLE!!! don't (988) 555-2485 a.b@c7.example.com x_y=\x07 où\x0bça 'really' ''ll **[grüße]**\x7f"
    for _ in range(3):
        got = tokens.WordTokenizer(tokens.default_tokenizer()).ids(text)
        assert np.frombuffer(got, "<u4").tolist() == encode(text)


def test_words_met_once_are_not_kept_and_kept_ones_are_bounded(monkeypatch):
    tokenizer = tokens.WordTokenizer(tokens.default_tokenizer())
    text = " ".join(f"{a}{b}{c}{d}" for a in "bcdf" for b in "aeiouy" for c in "ghjklmnp" for d in "aeiou")
    assert np.frombuffer(tokenizer.ids(text), "<u4").tolist() == encode(text)
    assert len(tokenizer.words) < 50  # of 960; two with one remainder may be kept
    monkeypatch.setattr(tokens, "CACHE_WORDS", 500)
    for _ in range(2):
        assert np.frombuffer(tokenizer.ids(text), "<u4").tolist() == encode(text)
    assert len(tokenizer.words) == 500


def test_long_words_are_not_kept():
    tokenizer = tokens.WordTokenizer(tokens.default_tokenizer())
    for _ in range(3):
        assert np.frombuffer(tokenizer.ids("x" * 5000), "<u4").tolist() == encode("x" * 5000)
    assert sum(map(len, tokenizer.words)) < 5000


# 4: mixing


def brute_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in free}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    return out


@pytest.mark.parametrize("slots", [1 << 14, 300])
def test_mixing(documents, odd_documents, no_documents, slots):
    for df in (documents, odd_documents):
        got = mixing.mix_documents(df, slots=slots, keep=("source",)).collect()
        rows = df.select("doc_id", "text", "source").collect()
        size = lambda r: len(WHITE.findall(r.text or ""))
        assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((r.doc_id, size(r)) for r in rows)
        sizes = collections.Counter()
        for r in rows:
            sizes[r.source] += size(r)
        targets, taken = brute_targets(dict(sizes)), collections.Counter()
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6 * max(1, r.target) and 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
        assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
        assert sorted(got, key=str) == sorted(mixing.mix_documents(df, slots=slots, keep=("source",)).collect(), key=str)
        spans = sorted(mixing.mixed_spans(df, slots=slots).collect(), key=lambda r: (r.slot, r.lap, r.place))
        given = collections.Counter()
        for r in spans:
            given[r.doc_id] += r.end - r.begin
        assert given == +sum((collections.Counter({r.doc_id: r.taken}) for r in got), collections.Counter())
        # at every length of the mix, each source has about its share
        total, seen, block = sum(taken.values()), collections.Counter(), max(1, round(sum(targets.values()) / slots))
        for n, r in enumerate(spans):
            seen[r.source] += r.end - r.begin
            if n % 500 == 499:
                assert all(abs(seen[s] - sum(seen.values()) * targets[s] / total) <= 8 * block for s in sizes)
    assert mixing.mix_documents(no_documents).count() == 0


def test_token_ids_that_dont_fit_are_refused(spark, documents):
    few = documents.where("doc_id < 5")
    two, four = (sorted(map(tuple, token_counts.document_tokens(few, width=w).select("doc_id", "n_tokens").collect())) for w in (2, 4))
    assert two == four
    with pytest.raises(ValueError, match="70000"):
        token_counts.write_token_files(few, "file:///tmp/never", end=70_000)
    with pytest.raises(Exception, match="needs more than 1 bytes"):
        token_counts.write_token_files(few, f"{shared.checkpoint_folder(spark)}/narrow", end=200, width=1)


def test_mixing_does_not_depend_on_the_layout(spark, documents):
    """Ids with several texts, in other orders and partitions."""
    more = [(5, "w " * n, "s1") for n in (50, 400, 7, 90)] + [(None, "x y z", "s1"), (None, "x y", "s1"), (5, "w " * 7, "s1")]
    rows = documents.select("doc_id", "text", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"))
    seen = [sorted(map(str, mixing.mix_documents(df, slots=3000, keep=("source",)).collect())) for df in (rows, rows.repartition(7), rows.orderBy(F.col("text").desc()).coalesce(1))]
    assert seen[0] == seen[1] == seen[2]


def test_schedule_is_even_at_every_length(spark):
    targets = spark.createDataFrame([("a", 0, 100, 150.0), ("b", 1, 50, 50.0), (None, 2, 70, 100.0)], "source string, source_no long, source_size long, target double")
    got = mixing.schedule(targets, 1, 300, chunk=16, cells=8).orderBy("slot").collect()
    seen = collections.Counter()
    for i, r in enumerate(got, 1):
        assert r["rank"] == seen[r.source_no]
        seen[r.source_no] += 1
        assert all(abs(seen[k] - i * t / 300) <= 4 for k, t in ((0, 150), (1, 50), (2, 100)))
    assert seen == {0: 150, 1: 50, 2: 100}


# 5: token counts


@pytest.mark.parametrize("block_tokens", [7, 1000, 1 << 20])
def test_token_counts(documents, odd_documents, no_documents, block_tokens, tmp_path):
    few = documents.limit(5) if block_tokens == 7 else documents
    got = token_counts.document_tokens(few, block_tokens=block_tokens).collect()
    want = {r.doc_id: len(encode(r.text, True)) for r in few.collect()}
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)
    for _, rows in itertools.groupby(sorted(got, key=lambda r: (r.file, r.ordinal)), key=lambda r: r.file):
        at = 0
        for k, r in enumerate(rows):
            assert (r.ordinal, r.start) == (k, at)
            at += r.n_tokens + 1
    assert sorted(got) == sorted(token_counts.document_tokens(few, block_tokens=block_tokens).collect())
    odd = token_counts.document_tokens(odd_documents, block_tokens=50).collect()
    assert sorted(r.n_tokens for r in odd) == sorted(len(encode(r.text or "", True)) for r in odd_documents.collect())
    assert token_counts.document_tokens(no_documents).count() == 0


def test_counts_from_files_on_disk(spark, tmp_path):
    rng, want = np.random.default_rng(2), []
    for f in range(3):
        ids = rng.integers(0, 6, 1000 + f).astype("<u2")
        ids.tofile(tmp_path / f"{f}.bin")
        at = 0
        for n, stop in enumerate([*np.flatnonzero(ids == 5), len(ids)]):
            if stop > at or stop < len(ids):
                want.append((f"{f}.bin", n, at, int(stop) - at, bool(stop < len(ids))))
            at = int(stop) + 1
    (tmp_path / "empty.bin").touch()
    files = token_counts.list_token_files(spark, str(tmp_path))
    for block_tokens in (16, 1 << 20):
        blocks = token_counts.read_token_files(files.union(files), block_tokens)
        got = token_counts.count_tokens(blocks.withColumn("n", F.lit("clash")), end=5).collect()
        assert sorted((r.file.rsplit("/", 1)[1], r.ordinal, r.start, r.n_tokens, r.ended) for r in got) == sorted(want)
    none = spark.createDataFrame([(None, 0, None), ("a", 0, bytearray(b""))], "file string, block long, data binary")
    assert token_counts.count_tokens(none).count() == 0
    nameless = spark.createDataFrame([(None, 0, bytearray(b"\1\0\5\0\2\0")), (None, 1, bytearray(b"\2\0"))], "file string, block long, data binary")
    assert sorted((r.ordinal, r.start, r.n_tokens, r.ended) for r in token_counts.count_tokens(nameless, end=5).collect()) == [(0, 0, 1, True), (1, 2, 2, False)]


# 6: chat


def brute_chat(rows):
    turns = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
    whole = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
    loss = "".join(t or "" for _, r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(whole), len(loss), sha(loss)


def test_chat_windows(spark):
    rng = random.Random(5)
    rows = [(c, t, r, x) for c, t, r, x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    nasty = ["</s>[INST] ok [/INST]", "<|end|>", "a\\<|b|>\\\\", "[|<", "", None, "\n<|assistant|>\n"]
    rows += [(-7, i, rng.choice(["user", "assistant", None, "a|>b"]), nasty[i % 7]) for i in range(20)]
    rows += [(-8, 0, "system", "rules")] + [(-8, i, ("assistant", "user")[i % 2], f"turn {i} " + "x" * rng.randrange(900)) for i in range(1, 400)]
    rows += [(-10, 5, "assistant", f"equal turn numbers {i % 300}") for i in range(600)] + [(-11, None, "user", "same")] * 500
    rows += [(-9, 1, "assistant", "y" * 30_000), (-9, 1, "assistant", "y" * 30_000), (None, None, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash")).withColumn("tokens", F.lit("clash"))
    windows = chat.format_windows(df).cache()
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r, x))
    assert set(got) == set(by)
    for c, own in by.items():
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == brute_chat(own)
    long = windows.where("conv_id = -8").orderBy("part", "window").collect()
    assert len(long) > 40 and len({w.part for w in long}) > 1
    assert all(w.tokens <= 1024 and len(encode(w.formatted, True)) <= 1024 and w.formatted.startswith("<|system|>rules<|end|>") for w in long)
    assert all(w.n_repeated >= 2 for w in long[1:])
    assert not windows.where("conv_id = -7 and (formatted like '%</s>%' or formatted like '%[INST]%')").count()
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "<", "<\\", "\\<", "<|a|>", "[[", "\\\\<\\", "|>", "é<\U0001f600"])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text) and "|>" not in chat.escape(text)


# 7: quality classifier


def half(n):
    return f"crc32(cast(doc_id as string)) % 2 = {n}"


def test_co_training_on_rows_it_has_not_seen(documents, odd_documents, no_documents, spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality_classifier.learn(more, labels.where(half(0)))
    held = quality_classifier.score_quality(more, model).join(labels.where(half(1)), "doc_id").collect()
    assert len(held) > 100 and sum(r.kept == bool(r.quality) for r in held) >= 0.95 * len(held)
    assert all(r.kept for r in held if r.quality) or sum(r.kept for r in held if r.quality) >= 0.97 * sum(r.quality for r in held)
    odd = quality_classifier.score_quality(odd_documents, model).collect()
    assert len(odd) == 9 and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if r.doc_id == 1}) == 1
    kept = quality_classifier.keep_good(odd_documents, model)
    assert kept.columns == odd_documents.columns and kept.count() == sum(r.kept for r in odd)
    assert quality_classifier.score_quality(no_documents, model).count() == 0 and quality_classifier.keep_good(no_documents, model).count() == 0
    one_kind = quality_classifier.learn(more, labels.where("quality = 1"))
    assert {r.score for r in quality_classifier.score_quality(documents.limit(5), one_kind).collect()} == {1.0}
    # what the views tell each other changes the result, and partitions don't
    alone = quality_classifier.learn(more, labels.where(half(0)), rounds=0)
    again = quality_classifier.learn(more.repartition(5), labels.where(half(0)).repartition(3))
    assert abs(alone.text.weights - model.text.weights).max() > 1e-3 and abs(alone.meta.weights - model.meta.weights).max() > 1e-3
    assert abs(again.text.weights - model.text.weights).max() < 1e-6


def test_scores_against_a_plain_reading(documents, spark):
    """Scores of the registered table from the views of single texts and the model's numbers."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality_classifier.learn(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    got = {r.doc_id: r for r in quality_classifier.score_quality(documents, model).collect()}
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    for r in documents.collect():
        raw = r.text.encode()
        one = quality_rules.Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        p = []
        for view, x in ((model.text, quality_classifier.text_view(one)), (model.meta, quality_classifier.meta_view(one, [r.lang], [r.source], [r.n_chars]))):
            x = x[0].astype("<f2").astype(float)
            z = sum((a - m) / s * w for a, m, s, w in zip(x, view.mean, view.scale, view.weights, strict=False)) + view.weights[-1]
            p.append(min(max(sigmoid(view.slope * z + view.shift), 1e-9), 1 - 1e-9))
        odds = lambda q: math.log(q / (1 - q))
        assert abs(got[r.doc_id].score - sigmoid(min(30, max(-30, odds(p[0]) + odds(p[1]) - odds(model.prior))))) < 1e-6


def test_statistics_of_all_rows_by_spark(spark, documents):
    rng = np.random.default_rng(4)
    view = lambda n: quality_classifier.View(rng.normal(0, 0.1, n), np.ones(n), rng.normal(0, 0.3, n + 1))
    views = {"text": view(quality_classifier.TEXT), "meta": view(quality_classifier.META)}
    rows = quality_classifier.view_table(documents)
    got = quality_classifier.gather_statistics(rows.repartition(5), views, 0.7, fan_in=2)
    text, meta = quality_classifier._unpack([r.x for r in rows.collect()])
    for key, (n, g, h) in quality_classifier.statistics(views, text, meta, 0.7).items():
        assert got[key][0] == n and abs(got[key][1] - g).max() < 1e-6 and abs(got[key][2] - h).max() < 1e-6


def test_labels_that_repeat_or_conflict(spark, documents, no_documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    first = labels.first().doc_id
    odd = spark.createDataFrame([(first, 1 - labels.first().quality), (None, 1), (10**9, None)], labels.schema)
    known = {r.doc_id: r.quality for r in labels.collect()}
    sixty = documents.where(f"doc_id = {first}").crossJoin(spark.range(60)).drop("id")
    rows = quality_classifier.view_table(documents.union(sixty))
    sample = lambda given, most=10**6: quality_classifier.labelled_sample(rows, given, most)
    assert sorted(sample(labels.union(labels))[2]) == sorted(known.values())
    assert len(sample(labels.union(odd))[2]) == len(known) - 1 and len(sample(labels, 7)[2]) == 7
    again = spark.createDataFrame([(first, "another text", "en", "a", 12)], "doc_id long, text string, lang string, source string, n_chars long")
    two = quality_classifier.view_table(documents.unionByName(again))
    assert len(quality_classifier.labelled_sample(two, labels, 10**6)[2]) == len(known) + 1 and len(quality_classifier.labelled_sample(two, labels, 5)[2]) == 5
    assert quality_classifier.learn(no_documents, labels).text is None


def test_views_teach_each_other():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 600).astype(float)
    text, meta = y[:, None] + rng.normal(0, 0.4, (600, 3)), y[:, None] + rng.normal(0, 0.4, (600, 2))
    model = quality_classifier.co_train(text[:40], meta[:40], y[:40], lambda views: quality_classifier.statistics(views, text[40:300], meta[40:300], 0.97))
    a, b, both = model.scores(text[300:], meta[300:])
    right = lambda p: ((p >= 0.5) == y[300:]).mean()
    assert right(both) >= max(right(a), right(b)) - 0.01 and right(both) > 0.95


# 8: licenses


def brute_licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    hits = [(k, label) for phrase, label in license_scan.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_licenses(spark, documents, odd_documents, no_documents):
    made = ["MIT License. mit license CC-BY CC by 4.0", "GNU General  Public\nLicense, GNU General Public", "KİT MITK license", "mit", "cc by cc by", "gnu gnu general public license license"]
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(made)], "doc_id long, text string")
    for df in (documents.select("doc_id", "text"), extra, odd_documents):
        got = license_scan.scan_licenses(df).collect()
        want = collections.Counter((r.doc_id, *brute_licenses(r.text)) for r in df.collect())
        assert collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
        assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)
    assert license_scan.scan_licenses(no_documents).count() == 0
    passage = "Permission is hereby granted, totally free of charge, to any person obtaining a copy of the software"
    found = license_scan.scan_licenses(spark.createDataFrame([(1, passage)], "doc_id long, text string")).first()
    assert found.n_base == 0 and found.labels == "mit" and 0.6 <= found.score < 1


def brute_spans(text, k=3, drift=3, least=0.6):
    """For each passage that stands in a text, the best share of its words that follow each other in a band."""
    w, out = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()), []
    for phrase, label in license_scan.PASSAGES:
        t = [x for x in re.split(license_scan.BETWEEN, phrase.lower()) if x]
        n = min(k, len(t))
        votes = [(at - p, p) for at in range(len(w) - n + 1) for p in range(len(t) - n + 1) if w[at : at + n] == t[p : p + n]]
        for d in {d for d, _ in votes}:
            last, words = -1, set()
            for p in sorted({p for _, p in votes}):
                here = min((e for e, q in votes if q == p and d <= e <= d + drift), default=None)
                if here is not None and here + p > last:
                    last = here + p
                    words |= set(range(p, p + n))
            if len(words) >= least * len(t):
                out.append((len(words) / len(t), label))
    return out


def test_license_spans_are_verified(spark):
    mit, bsd = license_scan.PASSAGES[10][0], license_scan.PASSAGES[11][0]
    words_of = lambda t: [x for x in re.split(license_scan.BETWEEN, t.lower()) if x]
    own = words_of(mit)
    scattered = " ".join(" ".join(own[i : i + 3]) + " filler" * (1 + i) for i in range(40))
    swapped = " ".join(own[80:] + own[:80])
    some = " ".join(x for i, x in enumerate(own) if i % 17 != 3)
    texts = [scattered, " ".join(reversed(own)), swapped, some, "x " * 500 + mit, mit + "\n\n" + bsd, "all rights reserved", "reserved rights all", " ".join(own[:60]), mit * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t)
        assert got[i].labels == ",".join(sorted({x for _, x in want})) and abs(got[i].score - max([s for s, _ in want], default=0)) < 1e-9, i
    assert got[0].labels == got[1].labels == "" and got[0].score == 0 and "mit" in got[3].labels and got[5].labels == "bsd,mit"
    spans = {(r.doc_id, r.template): r for r in license_scan.license_spans(df).where("doc_id in (4, 5)").collect()}
    assert (spans[4, 14].first_word, spans[4, 14].last_word, spans[4, 14].share) == (500, 499 + len(own), 1.0)
    assert spans[5, 15].first_word == len(own)
    assert license_scan.license_spans(df.where("doc_id = 9 ")).where("template = 14").count() == 2


def test_licenses_do_not_depend_on_partitions(documents):
    a, b = (sorted(license_scan.scan_licenses(documents.union(documents).repartition(n)).collect(), key=str) for n in (2, 7))
    assert a == b and len(a) == 2 * documents.count()


def test_license_scan_has_no_python_in_its_plan(documents):
    for df in (license_scan.scan_licenses(documents), mixing.mix_documents(documents)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# 9: quality rules


def brute_rules(text):
    text = text or ""
    w = WHITE.findall(text)
    seen = collections.defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    repeated = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if WHITE.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_rule_counts(documents, odd_documents, no_documents, spark):
    made = ["a a a a", "x y z\nx y z\n x y z\nx y z", "é é ### |\n\n###", "w " * 60, "one\ntwo\none\r\none\r", "a b c a b c a b"]
    extra = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for df in (documents, extra, odd_documents):
        got = quality_rules.score_documents(df).collect()
        assert collections.Counter((r.doc_id, *[r[c] for c in quality_rules.COUNTS]) for r in got) == collections.Counter((r.doc_id, *brute_rules(r.text)) for r in df.collect())
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality_rules.score_documents(no_documents).count() == 0 and quality_rules.filter_documents(no_documents).count() == 0


def test_cascade_does_not_depend_on_order(documents):
    kept = sorted(r.doc_id for r in quality_rules.score_documents(documents).where("kept").collect())
    assert kept == sorted(r.doc_id for r in quality_rules.filter_documents(documents).collect())
    assert kept == sorted(r.doc_id for r in quality_rules.filter_documents(documents, rules=quality_rules.RULES[::-1]).collect())
    assert set(quality_rules.order_rules(documents)) == set(quality_rules.RULES)


def test_rules_by_rejections_per_cost():
    a, b, c = (quality_rules.Rule(n, needs, None) for n, needs in (("a", ("n_words",)), ("b", ("n_repeat_words",)), ("c", ("n_symbols",))))
    cost = {"words": 4.0, "n_words": 0.0, "n_repeat_words": 6.0, "n_symbols": 1.0}
    # c is cheap; what a rejects, c has mostly rejected before; b shares the words with a
    order = quality_rules.greedy_order((a, b, c), {0b001: 1, 0b101: 40, 0b100: 10, 0b010: 30}, cost)
    assert [r.name for r in order] == ["c", "b", "a"]
    assert [r.name for r in quality_rules.greedy_order((a, b, c), {0b001: 1, 0b101: 40, 0b100: 10, 0b010: 30}, cost, frozenset(["words", "n_words", "n_repeat_words"]))][0] == "a"


def test_selected_texts_take_along_what_is_known(texts):
    raws = [t.encode() for t in texts.values()] + [b"", b"  ", b"a\na\na"]
    make = lambda rows: quality_rules.Texts(np.frombuffer(b"".join(rows), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64))
    keep = np.arange(len(raws)) % 3 != 1
    for asked in ((), ("words",), ("n_words", "n_symbols")):
        whole, want = make(raws), make([r for r, k in zip(raws, keep, strict=True) if k][::2])
        for name in asked:
            getattr(whole, name)
        got = whole.take(keep).take(np.arange(keep.sum()) % 2 == 0)
        for name in quality_rules.FEATURES:
            a, b = getattr(got, name), getattr(want, name)
            same = all((getattr(a, f) == getattr(b, f)).all() for f in ("row", "start", "size", "hash", "inside")) if name == "words" else (a == b).all()
            assert same, name


# 10: toxicity


def test_toxicity_finds_words_it_was_shown(spark, no_documents):
    rng = random.Random(9)
    syllables = ["ta", "lo", "mi", "ren", "sto", "vel", "qua", "ish", "or", "en", "dra", "pu"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    bad = ["zorgwat", "blexit", "hyfnuk", "grizzok"]

    def text(toxic):
        w = [word() for _ in range(rng.randrange(80, 200))]
        for k in range(5 if toxic else 0):
            w.insert(rng.randrange(len(w)), bad[k % 4])
        return " ".join(w)

    rows = [(i, text(i % 4 == 0), i % 4 == 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(b)) for i, _, b in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    held = [(got[i].predicted, int(b)) for i, _, b in rows if got[i].held_out]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    # labels of the held-out third change nothing
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.learn(docs, turned)).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_toxicity_reads_every_byte(spark):
    rng = random.Random(5)
    syllables = ["ta", "lo", "mi", "ren", "sto", "vel", "qua", "ish", "or", "en", "dra", "pu"]
    fill = lambda n: ["".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5))) for _ in range(n)]
    bad = lambda: " ".join(x for w in fill(20) for x in (w, rng.choice(["zorgwat", "grizzok"])))
    model = toxicity.train([bad() for _ in range(80)], [" ".join(fill(40)) for _ in range(160)])
    shapes = ("vel-{}", "vel/{}", "vel'{}", "quaishor{}", "quaishorenta{}tadra")
    rows = [(k, " ".join(x for w in fill(20) for x in (w, shape.format("zorgwat")))) for k, shape in enumerate(shapes)]
    rows += [(10, "".join(x for w in fill(20) for x in (w, "zorgwat"))), (11, "".join(fill(40))), (12, " ".join(fill(40)))]  # 10, 11: no blanks
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(got[k] > 0.5 for k in range(len(shapes))) and got[10] > 0.5 > max(got[11], got[12])


@pytest.mark.parametrize("text", ["abcdefghijklmnop qrs", "a b " * 99, "\u6c49\u5b57\u6ca1\u6709\u7a7a\u683c\u7684\u53e5\u5b50" * 9, "x", ""])
def test_toxicity_windows_overlap_and_cover(text):
    raw, whole = toxicity.plain(text), b""
    for k, w in enumerate(toxicity.windows(raw)):
        assert len(whole) >= k * toxicity.STEP and len(w) <= toxicity.WINDOW
        whole = whole[: k * toxicity.STEP] + w
    assert whole == raw
    for i in range(len(raw) - 12):
        assert any(raw[i : i + 12] in w for w in toxicity.windows(raw))


def test_toxicity_scores_against_brute_force(spark):
    """Lengths, gains, features and scores of a registered table, by zstandard's own function on each window."""
    import zstandard as z

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    params = z.ZstdCompressionParameters(strategy=z.STRATEGY_LAZY2, min_match=5, hash_log=15, chain_log=15, search_log=6, target_length=64, window_log=17, write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS)
    toxic, ordinary = model.content
    length = lambda w, held: len(z.ZstdCompressor(dict_data=held, compression_params=params).compress(w))
    sides = [z.ZstdCompressionDict(c, dict_type=z.DICT_TYPE_RAWCONTENT) for c in (ordinary + bytes(len(toxic)), ordinary + toxic)]
    rows = [r for r in docs.collect() if len(r.text) < 1500][:60]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    for r in rows:
        raw = b" " + b" ".join(re.split(rb"[\x00-\x20]+", r.text.lower().encode().strip(bytes(range(33))))) + b" "
        gains = [length(raw[i : i + 48], sides[0]) - length(raw[i : i + 48], sides[1]) for i in range(0, max(1, len(raw) - 12), 36)]
        top = [min(16, max(-4, g)) for g in (sorted(gains, reverse=True) + [-4] * 3)[:3]]
        counts = [sum(g >= k for g in gains) for k in (1, 2, 3, 4, 5, 6, 8)]
        x = [*top, *map(math.log1p, counts), math.log1p(len(gains)), counts[3] / len(gains)]
        z_ = sum((v - m) / s * w for v, m, s, w in zip(x, model.mean, model.scale, model.weights, strict=False)) + model.weights[-1]
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-z_))) < 1e-9


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    held = toxicity.score_toxicity(docs, model).where("held_out").join(labels, "doc_id").collect()
    toxic = [r.predicted for r in held if r.toxic]
    assert sum(toxic) >= 0.3 * len(toxic) and sum(r.predicted for r in held if not r.toxic) <= 0.02 * (len(held) - len(toxic))
    assert toxicity.learn(docs.repartition(7), labels.repartition(3)).content == model.content


def test_toxicity_labels_that_repeat_or_conflict(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 5) for i in range(40)] + [(0, "text 0 " * 5), (1, "another text"), (None, "x"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (None, 1), (4, None), (5, 1)], "doc_id long, toxic int")
    usable = labels.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("m")).where("toxic = m and doc_id is not null").drop("m")
    toxic, ordinary = toxicity.labelled_sample(docs, usable, "doc_id", "text", (50, 50), 1000)
    assert len(toxic) == len(set(toxic)) == 20 and "another text" in toxic and not any("text 3 " in t for t in toxic + ordinary)
    assert len(toxicity.labelled_sample(docs, usable, "doc_id", "text", (3, 2), 1000)[0]) == 3


def test_toxicity_of_odd_rows(odd_documents, no_documents, spark):
    model = toxicity.train(["you idiot " * 30] * 3, ["a fine day " * 30] * 3)
    got = toxicity.score_toxicity(odd_documents, model).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(no_documents, model).count() == 0
    none = toxicity.learn(odd_documents, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < 1e-5 for r in toxicity.score_toxicity(odd_documents, none).collect())
