"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide, components give classes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import checkpointed, may_hold, slices, text_keys, utf8
from lodestone.llm.text_arrays import WHITE, mix, runs, windows

#: What a row is known by: its id and two hashes of its text.
ROW = ("doc_id", "h1", "h2")


def _same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.h1") == F.col(f"{b}.h1")) & (F.col(f"{a}.h2") == F.col(f"{b}.h2"))


def choose_bands(threshold: float, recall: float = 0.9999, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): of the layouts that find a pair at ``threshold`` with probability ``recall`` and need at most
    ``most_hashes`` hashes, the one with the most rows, which has the fewest false candidates."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, most_hashes):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def gram_sets(raw: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words and their rows, in row order; a shorter text has one gram of all its words."""
    w = runs(raw, bounds, WHITE)
    grams, first = windows(w.row, w.hash, n)
    rows = w.row[first]
    count = np.bincount(w.row, minlength=len(bounds) - 1)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        at = np.concatenate(([0], np.cumsum(count)))
        extra = [mix(np.array([np.bitwise_xor.reduce(mix(w.hash[at[r] : at[r + 1]] + np.arange(count[r], dtype=np.uint64)))], np.uint64))[0] for r in short]
        grams, rows = np.concatenate((grams, np.array(extra, np.uint64))), np.concatenate((rows, short))
        order = np.argsort(rows, kind="stable")
        grams, rows = grams[order], rows[order]
    return grams, rows


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its sorted set of gram hashes) of a batch's ``text``."""
    raw, bounds = utf8(batch.column("text"))
    for lo, hi in slices(bounds):
        grams, rows = gram_sets(raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], n)
        cuts = np.searchsorted(rows, np.arange(hi - lo + 1))
        for r in range(hi - lo):
            yield lo + r, np.unique(grams[cuts[r] : cuts[r + 1]])


def _key(grams: np.ndarray) -> bytes:
    """Stands for a set: equal sets have equal keys."""
    return xxhash.xxh128_digest(grams.astype("<u8").tobytes())


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, h1, h2, key, size (of the gram set) and band hashes of every row (doc_id, h1, h2, text)."""
    rng = np.random.default_rng(43)
    mult = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, 512) for whole in batches for lo in range(0, whole.num_rows, 512)):
            keys, sizes, found = [], [], []
            for _, g in _sets(batch, n):
                keys.append(_key(g))
                sizes.append(len(g))
                if not len(g):
                    found.append([])
                    continue
                least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(g), 4096):
                    part = g[at : at + 4096]
                    least = np.minimum(least, ((part[None, :] ^ plus[:, None]) * mult[:, None]).min(1))
                found.append(least)
            out = [x if len(x) == 0 else _band_hashes(x, bands, rows, salt) for x in found]
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ROW}, "key": pa.array(keys, pa.binary()), "size": pa.array(sizes, pa.int32()), "bands": pa.array([x.tolist() if len(x) else [] for x in out], pa.list_(pa.int64()))})

    return docs.mapInArrow(sign, "doc_id bigint, h1 bigint, h2 bigint, key binary, size int, bands array<bigint>")


def _band_hashes(least: np.ndarray, bands: int, rows: int, salt: np.ndarray) -> np.ndarray:
    h = salt.copy()
    for k in range(rows):
        h = mix(h ^ mix(least.reshape(bands, rows)[:, k] + np.uint64(k)))
    return h.view(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable from each node of the undirected edges (a, b).

    Alternates two star steps: every node's larger neighbours join its least neighbour, then its smaller ones do.
    The edges shrink towards stars; each round is checkpointed and only its number of changes reaches the driver.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    state = mark(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.where("u <> v").distinct())
        before, state = state, mark(edges)
        if state == before:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, through the grams that both lists have."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(np.unique(flat_a), np.unique(flat_b))
    out = np.zeros((len(a), len(b)), np.float32)
    row_a, row_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    at_a, at_b = np.searchsorted(shared, flat_a), np.searchsorted(shared, flat_b)
    in_a = (at_a < len(shared)) & (shared[np.minimum(at_a, max(0, len(shared) - 1))] == flat_a) if len(shared) else np.zeros(len(flat_a), bool)
    in_b = (at_b < len(shared)) & (shared[np.minimum(at_b, max(0, len(shared) - 1))] == flat_b) if len(shared) else np.zeros(len(flat_b), bool)
    for lo in range(0, len(shared), 2048):
        pa_, pb_ = in_a & (at_a >= lo) & (at_a < lo + 2048), in_b & (at_b >= lo) & (at_b < lo + 2048)
        ma, mb = np.zeros((len(a), 2048), np.float32), np.zeros((len(b), 2048), np.float32)
        ma[row_a[pa_], at_a[pa_] - lo] = 1
        mb[row_b[pb_], at_b[pb_] - lo] = 1
        out += ma @ mb.T
    return out


def verified_links(sigs: DataFrame, docs: DataFrame, n: int, percent: int, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """Links between different gram sets: (key, links) with each partner counted as often as documents have it,
    and edges (a, b) of keys that connect all linked ones.

    Sets that share a band meet at the band's least key, the hub, once per hub however many bands they share. A
    hub's sets are dealt to blocks while they are keys only; the sets themselves, those of texts that met others and
    no more, are then sent to pairs of blocks. Each pair is one group of bounded size that compares full sets all at
    once and passes on counts and one edge per set, never the pairs. A pair that shares several hubs is counted at
    the least of them.
    """
    reps = sigs.groupBy("key").agg(F.count("*").alias("copies"), F.min(F.struct(*ROW)).alias("row"), F.first("bands").alias("bands"))
    bands = reps.select("key", F.explode("bands").alias("band"))
    hubs = bands.groupBy("band").agg(F.min("key").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub")
    met = checkpointed(bands.join(hubs, "band").select("hub", "key").distinct())
    mine = met.groupBy("key").agg(F.array_sort(F.collect_set("hub")).alias("hubs"))  # at most one per band
    wanted = checkpointed(reps.select("key", "row", "copies").join(mine, "key").select("key", "copies", "hubs", "row.*"))
    # the texts of wanted rows; a bitmap keeps nearly all others from the shuffle
    near = may_hold(docs.select(*ROW, "text"), wanted, list(ROW), "maybe").where("maybe").drop("maybe")
    texts = near.alias("d").join(wanted.alias("w"), _same_row("d", "w")).select("key", "copies", "hubs", "text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):  # few at once, since sets are larger than their texts
                batch = whole.slice(lo, 256)
                sets = [g.astype("<u8").tobytes() for _, g in _sets(batch, n)]
                yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "copies": batch.column("copies"), "hubs": batch.column("hubs"), "grams": pa.array(sets, pa.binary())})

    sets = texts.mapInArrow(full, "key binary, copies bigint, hubs array<binary>, grams binary")
    # rows that repeat an id and its text give their set as often
    sets = sets.groupBy("key").agg(*[F.first(c).alias(c) for c in ("copies", "hubs", "grams")])
    # written first, so that the join below is of plain tables and Spark can split a large hub
    sizes = checkpointed(met.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    # block i meets every block j; the pair (i, j) is one group
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = met.join(sizes, "hub").withColumn("mine", F.pmod(F.xxhash64("key", "hub"), F.col("blocks")).cast("int")).select("hub", "key", "mine", other)
    dealt = dealt.select("hub", "key", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    spread = dealt.join(sets, "key").select("hub", "key", "copies", "hubs", "grams", "mine", "i", "j")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        hub, i, j = group["hub"].iloc[0], group["i"].iloc[0], group["j"].iloc[0]
        group = group.sort_values("key").reset_index(drop=True)
        left = group[group["mine"] == i].reset_index(drop=True)
        right = left if i == j else group[group["mine"] == j].reset_index(drop=True)
        if not len(left) or not len(right):
            return pd.DataFrame({"key": [], "links": [], "to": []})
        a = [np.frombuffer(x, "<u8") for x in left["grams"]]
        b = a if i == j else [np.frombuffer(x, "<u8") for x in right["grams"]]
        both = _intersections(a, b)
        total = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - both
        linked = 100 * both >= percent * total
        if i == j:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return pd.DataFrame({"key": [], "links": [], "to": []})
        # pairs that also meet at a lesser hub are counted there
        lesser = sorted({h for hs in (*left["hubs"], *right["hubs"]) for h in hs if h < hub})
        at = {h: k for k, h in enumerate(lesser)}
        marks = []
        for side in (left, right):
            m = np.zeros((len(side), max(1, len(lesser))), np.float32)
            for r, hs in enumerate(side["hubs"]):
                m[r, [at[h] for h in hs if h in at]] = 1
            marks.append(m)
        linked &= (marks[0] @ marks[1].T) == 0
        root_left, root_right = _roots(left["key"], right["key"], linked)
        out = [_tally(left, right, linked, root_left)] + ([_tally(right, left, linked.T, root_right)] if i != j else [])
        return pd.concat(out)

    counted = spread.groupBy("hub", "i", "j").applyInPandas(compare, "key binary, links bigint, to binary")
    counted = checkpointed(counted)
    links = counted.groupBy("key").agg(F.sum("links").alias("links"))
    return links, counted.select(F.col("key").alias("a"), F.col("to").alias("b"))


def _roots(left: pd.Series, right: pd.Series, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least key that each set of two blocks can reach by links between them."""
    names = np.array(sorted({*left, *right}), dtype=object)
    rank = {k: r for r, k in enumerate(names)}
    a, b = np.array([rank[k] for k in left]), np.array([rank[k] for k in right])
    while True:
        a2 = np.minimum(a, np.where(linked, b[None, :], len(names)).min(1))
        b2 = np.minimum(b, np.where(linked, a2[:, None], len(names)).min(0))
        if (a2 == a).all() and (b2 == b).all():
            return names[a], names[b]
        a, b = a2, b2


def _tally(own: pd.DataFrame, others: pd.DataFrame, linked: np.ndarray, roots: np.ndarray) -> pd.DataFrame:
    """For each set with a link: its partners' documents, and the least key that it reaches."""
    rows = np.flatnonzero(linked.any(1))
    counts = linked[rows].astype(np.int64) @ others["copies"].to_numpy()
    return pd.DataFrame({"key": own["key"].to_numpy()[rows], "links": counts, "to": roots[rows]})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, recall: float = 0.9999) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, n_grams.

    Two documents are linked when the Jaccard similarity of their sets of ``n`` consecutive lower-case words is at
    least ``percent`` per cent; a text of fewer words has one gram of all its words. Equal sets are always linked,
    texts without words with each other alone. A class is a component of links, named by its least doc_id;
    ``n_links`` counts the other documents that a document is linked with.

    Null texts are empty; repeated rows are documents of their own; null ids come back null, and a class of such
    rows alone has a null class_id; an empty table gives no rows. Other columns are not read.
    """
    keyed, classes = _classes(_standard(docs, id_col, text_col), n, percent, recall)
    classes = checkpointed(classes)
    named = checkpointed(classes.groupBy("root").agg(F.min("least").alias("class_id")))  # so that a large class can be split
    classes = classes.join(named, "root").select("key", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return keyed.join(classes, "key").select("doc_id", "class_id", "n_links", F.col("n_grams").cast("bigint").alias("n_grams"))


def _standard(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *text_keys(F.col(text_col)), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))


def _classes(docs: DataFrame, n: int, percent: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h1, h2, key, n_grams), and one row per key: copies, least doc_id, its component's root, links."""
    bands, rows = choose_bands(percent / 100, recall)
    sigs = checkpointed(signatures(docs, n, bands, rows))
    links, edges = verified_links(sigs, docs, n, percent)
    roots = components(edges)
    keyed = sigs.select(*ROW, "key", F.col("size").alias("n_grams"))
    per = keyed.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    per = per.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")).join(links, "key", "left")
    return keyed, per


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, recall: float = 0.9999) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one of each class of near_duplicates: the row
    with the least id (null last), of several texts with that id the one with the least hash, and of rows that
    repeat both, which may differ in other columns, the one with the least hash of all columns. What stays doesn't
    depend on the order or the partitions of ``docs``. Maps can't be hashed: ``docs`` must have no such column.

    Null texts are empty, and one row without words stays; an empty table stays empty.
    """
    keyed, per = _classes(_standard(docs, id_col, text_col), n, percent, recall)
    # what is joined below is written first, so that Spark can split a large class
    per = checkpointed(per)
    several = checkpointed(per.groupBy("root").agg(F.sum("copies").alias("rows")).where("rows > 1").select("root"))
    grouped = per.join(several, "root").select("key", "root")
    members = keyed.join(grouped, "key").groupBy("root", *ROW).agg(F.count("*").alias("times"))
    members = checkpointed(members.withColumn("rank", F.struct(F.col("doc_id").isNull(), *ROW)))
    best = checkpointed(members.groupBy("root").agg(F.min("rank").alias("best")))
    # whatever is a member goes, but for the best, of which one row stays
    verdict = members.join(best, "root").select(*ROW, "times", F.col("rank").eqNullSafe(F.col("best")).alias("stays"))
    verdict = checkpointed(verdict.where("not stays or times > 1"))
    keys = text_keys(F.col(text_col))
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), *keys)
    marked = may_hold(marked, verdict, list(ROW), "maybe")
    out = marked.where("not maybe").select("row")
    met = marked.where("maybe").alias("d").join(verdict.alias("v"), _same_row("d", "v"), "left").select("row", "d.doc_id", "d.h1", "d.h2", "stays")
    out = out.unionByName(met.where("stays is null").select("row"))
    one = met.where("stays").groupBy(*ROW).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return out.unionByName(one.select("row")).select("row.*")


#: The same rows by a plain join on all n-grams, for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS l FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(l) >= 5 THEN array_to_string(l[i : i + 4], ' ') ELSE array_to_string(l, ' ') END AS gram
  FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 3, 2))) AS i FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c) UNION ALL
  SELECT a.doc_id, b.doc_id FROM w a JOIN w b ON a.doc_id < b.doc_id AND len(a.l) = 0 AND len(b.l) = 0),
near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT x, b FROM reach JOIN near ON y = a),
classes AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x),
counts AS (SELECT a AS doc_id, count(*)::BIGINT AS n_links FROM near GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n, 0)::BIGINT AS n_grams
FROM classes LEFT JOIN counts USING (doc_id) LEFT JOIN n USING (doc_id)
"""
