"""A stored inverted index for BM25: postings in blocks by term, with what a block can add to a score at most."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.search import B, BODY, K1, PATH, STEM_WEIGHT, SYMBOL, topk
from lodestone.sources.files import checkpointed
from lodestone.sources.store import latest, new_version, publish

#: Documents of a shard, whose postings of a term are one row, and of a block inside it, whose maxima are kept.
SHARD, BLOCK = 2048, 256

POSTINGS = "token string, shard bigint, locals array<int>, weights array<float>, lens array<int>, blocks array<int>, most array<float>, least_len array<int>, paths array<string>"


@dataclass
class SearchIndex:
    """postings: (token, shard, locals, weights, lens; blocks, most, least_len) in folders by ``bucket``; words: (token,
    stem, df); docs: (shard, paths, lens); n documents of ``avg_len`` words. Reading it reads no text."""

    spark: SparkSession
    path: str
    n: int
    avg_len: float
    buckets: int

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def _invert(batches: Iterator[pa.RecordBatch], shard_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows of POSTINGS from documents (path, body, path_tokens, symbols): for each shard of consecutive documents a row
    for each of its words, and one without a word that holds paths and lengths in the order of the paths."""
    from pyspark import TaskContext

    names = [c.split()[0] for c in POSTINGS.split(", ")]
    number = TaskContext.get().partitionId() << 32

    def lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))

    def shard_of(table: pa.Table, number: int) -> pa.RecordBatch:
        paths = np.array(table.column("path").to_pylist(), object)
        order = np.argsort(paths, kind="stable")
        local = np.empty(len(order), np.int64)
        local[order] = np.arange(len(order))
        sizes, rows, weights, values = {}, [], [], []
        for name, weight in (("body", BODY), ("path_tokens", PATH), ("symbols", SYMBOL)):
            column = table.column(name).combine_chunks()
            sizes[name] = np.diff(column.offsets.to_numpy())
            rows.append(np.repeat(local, sizes[name]))
            weights.append(np.full(len(rows[-1]), weight))
            values.append(column.flatten())
        length = np.empty(len(order), np.int64)
        length[local] = sizes["body"] + 2 * sizes["path_tokens"]
        coded = pa.concat_arrays(values).dictionary_encode()
        code, row, weight = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(rows), np.concatenate(weights)
        key, at = np.unique(code * len(order) + row, return_inverse=True)
        weight = np.bincount(at, weight, len(key))
        code, row = key // len(order), key % len(order)
        # postings by word, and inside them by block
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else code
        cut = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] // BLOCK != row[:-1] // BLOCK))) if len(code) else code
        most, least = (np.maximum.reduceat(weight, cut), np.minimum.reduceat(length[row], cut)) if len(cut) else (weight, weight)
        in_blocks = np.searchsorted(cut, first)
        own = [
            coded.dictionary.cast(pa.string()).take(pa.array(code[first])),
            lists(row, first, pa.int32()),
            lists(weight, first, pa.float32()),
            lists(length[row], first, pa.int32()),
            lists(row[cut] // BLOCK, in_blocks, pa.int32()),
            lists(most, in_blocks, pa.float32()),
            lists(least, in_blocks, pa.int32()),
        ]
        own.insert(1, pa.array(np.full(len(first), number), pa.int64()))
        words = pa.RecordBatch.from_arrays([*own, pa.nulls(len(first), pa.list_(pa.string()))], names=names)
        none = {n: pa.nulls(1, words.schema.field(n).type) for n in names}
        none |= {"shard": pa.array([number], pa.int64()), "lens": lists(length, np.array([0]), pa.int32()), "paths": pa.array([paths[order].tolist()], pa.list_(pa.string()))}
        return pa.concat_batches([words, pa.RecordBatch.from_pydict(none)])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(batch.num_rows - at, shard_docs - sum(b.num_rows for b in held))
            held.append(batch.slice(at, take))
            at += take
            if sum(b.num_rows for b in held) == shard_docs:
                yield shard_of(pa.Table.from_batches(held), number)
                held, number = [], number + 1
    if held:
        yield shard_of(pa.Table.from_batches(held), number)


def build_index(docs: DataFrame, folder: str, signature: str = "", shard_docs: int = SHARD, buckets: int | None = None) -> SearchIndex:
    """Writes an index of documents (path, body, path_tokens, symbols: distinct tokens) as a new version below ``folder``.

    Documents stay in the tasks that read them, a shard at a time; only postings are shuffled, into ``buckets`` by a hash
    of their word (one for each shuffle partition if not given). Paths must be distinct and not null; null channels are
    empty; an empty table gives an empty index.
    """
    spark, path = docs.sparkSession, new_version(folder)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = F.array().cast("array<string>")
    rows = docs.select("path", *[F.coalesce(c, none).alias(c) for c in ("body", "path_tokens", "symbols")])
    made = rows.mapInArrow(lambda batches: _invert(batches, shard_docs), POSTINGS)
    # shards without a word come to a bucket of their own
    bucket = F.when(F.col("token").isNull(), -1).otherwise(F.pmod(F.xxhash64("token"), F.lit(buckets))).cast("int")
    made = made.withColumn("bucket", bucket).repartition(buckets, "bucket", F.when(F.col("token").isNull(), F.col("shard"))).sortWithinPartitions("bucket", "token", "shard")
    made.write.partitionBy("bucket").parquet(f"{path}/all")
    every = spark.read.schema(f"{POSTINGS}, bucket int").parquet(f"{path}/all")
    facts = every.where("bucket = -1").select(F.size("paths").alias("n"), F.aggregate("lens", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("len"))
    n, total = facts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("len"), F.lit(0))).first()
    words = every.where("bucket >= 0").groupBy("token").agg(F.sum(F.size("locals")).alias("df")).withColumn("stem", T.stem(F.col("token")))
    words.repartition(F.pmod(F.xxhash64("stem"), F.lit(buckets))).sortWithinPartitions("stem").write.parquet(f"{path}/words")
    publish(spark, folder, path, signature, n=str(n), avg_len=repr(total / n if n else 0.0), buckets=str(buckets))
    return SearchIndex(spark, path, n, total / n if n else 0.0, buckets)


def open_index(spark: SparkSession, folder: str, signature: str, make: Callable[[], DataFrame], rebuild: bool = False) -> SearchIndex:
    """The stored index with that signature; one is built from the documents that ``make`` gives where there is none,
    or where ``rebuild`` asks for it. With a stored one, ``make`` isn't called and no text is read."""
    found = None if rebuild else latest(spark, folder, signature)
    if found is None:
        return build_index(make(), folder, signature)
    facts = found["facts"]
    return SearchIndex(spark, found["path"], int(facts["n"]), float(facts["avg_len"]), int(facts["buckets"]))


def best_in_shard(use: np.ndarray, idf: np.ndarray, rows: list[tuple], avg_len: float, k: int | None, stems: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, document, score) of a shard's documents, of each query its ``k`` best (ties: the first document), and how
    many pairs of query and block were scored.

    ``use`` says which queries (rows) have which terms; ``rows`` are postings (term, exact, locals, weights, lens, blocks,
    most, least_len). A block is scored for a query only if the most that its terms can add there reaches the query's
    k-th best score so far; blocks with most to give come first.
    """
    term = np.array([r[0] for r in rows])
    exact = np.array([r[1] for r in rows])
    spread = lambda of: np.concatenate([r[of] for r in rows])
    avg = avg_len or 1.0
    gain = lambda tf, length: tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg))
    sizes, parts = np.array([len(r[2]) for r in rows]), np.array([len(r[5]) for r in rows])
    local, weight, length = spread(2).astype(np.int64), spread(3).astype(float), spread(4).astype(float)
    n = int(local.max()) + 1
    key, at = np.unique(np.repeat(term, sizes) * n + local, return_inverse=True)
    own = np.bincount(at, weight * np.repeat(exact, sizes), len(key))
    tf = np.where(own > 0, own, STEM_WEIGHT * np.bincount(at, weight, len(key)) if stems else 0.0)
    lengths = np.zeros(len(key))
    lengths[at] = length
    value = np.where(tf > 0, idf[key // n] * gain(tf, lengths), 0.0)
    of_term, doc = key // n, key % n
    # the most that each block adds: gains grow slower than weights, so that of several words together add up to more
    blocks = -(-n // BLOCK)
    most = np.zeros((len(idf), blocks))
    np.add.at(most, (np.repeat(term, parts), spread(5)), np.repeat(idf[term], parts) * gain(spread(6).astype(float), spread(7).astype(float)))
    bound = use @ most
    by_block = np.argsort(doc // BLOCK, kind="stable")
    of_term, doc, value = of_term[by_block], doc[by_block], value[by_block]
    cuts = np.searchsorted(doc // BLOCK, np.arange(blocks + 1))
    scores = np.zeros((len(use), n))
    last, scored = np.full(len(use), 0.0), 0
    for b in np.argsort(-bound.max(0), kind="stable"):
        # a little less counts as reached, since sums in another order differ in their last digits
        live = np.flatnonzero((bound[:, b] > 0) & (bound[:, b] * (1 + 1e-9) >= last))
        if not len(live):
            continue
        scored += len(live)
        lo, hi = cuts[b], cuts[b + 1]
        width = min(BLOCK, n - b * BLOCK)
        terms, inner = np.unique(of_term[lo:hi], return_inverse=True)
        dense = np.zeros((len(terms), width))
        dense[inner, doc[lo:hi] - b * BLOCK] = value[lo:hi]
        scores[live, b * BLOCK : b * BLOCK + width] = use[np.ix_(live, terms)] @ dense
        if k is not None and k < n:
            last[live] = np.partition(scores[live], n - k, axis=1)[:, n - k]
    if k is None or k >= n:
        q, d = np.nonzero(scores > 0)
        return q, d, scores[q, d], scored
    near = np.round(scores, 9)
    q, d = np.nonzero((near >= np.round(last, 9)[:, None]) & (scores > 0))
    order = np.lexsort((d, -near[q, d], q))
    q, d = q[order], d[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], d[place < k], scores[q, d][place < k], scored


def _found(index: SearchIndex, queries: DataFrame, k: int | None, stems: bool, block: int, total: bool = False, most_sent: int = 500_000) -> DataFrame:
    """(query_id, shard, local, score): of each query the ``k`` best documents of each shard, or all with a score; with
    ``total`` only (query_id, hits, total) of each shard. Words of up to ``most_sent`` pairs with queries are sent to all
    tasks, so that postings stay where they are read and only those of these words travel."""
    kind = dict(queries.dtypes)["query_id"]
    asked = queries.select("query_id", F.explode_outer("terms").alias("term")).where("term is not null").distinct()
    asked = checkpointed(asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // block))))))
    terms = asked.select("term").distinct().withColumn("stem", T.stem(F.col("term")))
    words = index.table("words")
    met = words.join(terms, "stem") if stems else words.join(terms, words["token"] == terms["term"]).drop(terms["stem"])
    met = checkpointed(met.select("token", "term", "df", F.pmod(F.xxhash64("token"), F.lit(index.buckets)).cast("int").alias("bucket")))
    postings = index.spark.read.schema(f"{POSTINGS}, bucket int").parquet(f"{index.path}/all")
    sent = lambda df, n: F.broadcast(df) if n <= most_sent else df
    own = met.where("token = term").select("term", "df")
    # a term that no document has counts the documents with its stem, several words of which may be in one
    lacking = met.join(own, "term", "left_anti").select("term", "token", "bucket")
    by_stem = postings.select("bucket", "token", "shard", "locals").join(sent(lacking, met.count()), ["bucket", "token"]).select("term", "shard", F.explode("locals").alias("doc")).distinct().groupBy("term").agg(F.count("*").alias("df"))
    df = own.unionByName(by_stem)
    idf = df.select("term", F.log1p((index.n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    used = asked.groupBy("part", "term").agg(F.array_sort(F.collect_list("query_id")).alias("queries"))
    wanted = checkpointed(met.select("token", "term", "bucket").join(idf, "term").join(used, "term"))
    pairs = wanted.agg(F.coalesce(F.sum(F.size("queries")), F.lit(0))).first()[0]
    rows = postings.drop("paths").join(sent(wanted, pairs), ["bucket", "token"]).withColumn("exact", F.col("token") == F.col("term")).drop("bucket", "token")

    avg_len = index.avg_len  # the index itself stays on the driver

    def score(group: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(group["term"])
        ids = sorted({q for qs in group["queries"] for q in qs})
        place = {q: n for n, q in enumerate(ids)}
        use, weights = np.zeros((len(ids), len(names))), np.zeros(len(names))
        for t, qs, i in zip(codes, group["queries"], group["idf"], strict=True):
            use[[place[q] for q in qs], t] = 1
            weights[t] = i
        columns = ("exact", "locals", "weights", "lens", "blocks", "most", "least_len")
        q, d, s, _ = best_in_shard(use, weights, list(zip(codes, *(group[c] for c in columns), strict=True)), avg_len, k, stems)
        if total:
            hits = np.bincount(q, minlength=len(ids))
            return pd.DataFrame({"query_id": ids, "hits": hits, "total": np.bincount(q, s, len(ids))})[hits > 0]
        return pd.DataFrame({"query_id": [ids[x] for x in q], "shard": group["shard"].iloc[0], "local": d.astype("int32"), "score": s})

    gives = "hits bigint, total double" if total else "shard bigint, local int, score double"
    return rows.groupBy("shard", "part").applyInPandas(score, f"query_id {kind}, {gives}")


def _paths(index: SearchIndex) -> DataFrame:
    docs = index.spark.read.schema(f"{POSTINGS}, bucket int").parquet(f"{index.path}/all").where("bucket = -1")
    return docs.select("shard", F.posexplode("paths").alias("local", "path"))


def index_scores(index: SearchIndex, queries: DataFrame, with_stems: bool = True, block: int = 256) -> DataFrame:
    """(query_id, path, score) of every document with a term of a query (query_id, terms), from a stored index.

    Where a document lacks a term, 0.8 times its weight for the term's stem counts instead. A term's document frequency
    is that of the term itself if any document has it, else of its stem. Queries meet each shard in parts of about
    ``block``; repeated terms of a query count once; null terms and queries without terms give no rows.
    """
    return _found(index, queries, None, with_stems, block).join(_paths(index), ["shard", "local"]).select("query_id", "path", "score")


def index_totals(index: SearchIndex, queries: DataFrame, with_stems: bool = True, block: int = 256) -> DataFrame:
    """(query_id, hits, total): how many rows index_scores gives of each query and the sum of their scores. Each shard
    adds up its own documents, so that no row per document leaves it and no path is read."""
    per = _found(index, queries, None, with_stems, block, total=True)
    return per.groupBy("query_id").agg(F.sum("hits").alias("hits"), F.sum("total").alias("total"))


def index_topk(index: SearchIndex, queries: DataFrame, k: int, with_stems: bool = True, block: int = 256) -> DataFrame:
    """(query_id, path, score, rank): the ``k`` best documents of each query by the score of index_scores to nine
    places, equal ones by path. Each shard leaves out blocks that can't reach its k best and passes on k rows a query."""
    named = _found(index, queries, k, with_stems, block).withColumn("near", F.round("score", 9)).join(_paths(index), ["shard", "local"])
    return topk(named, k, score="near").select("query_id", "path", "score", "rank")
