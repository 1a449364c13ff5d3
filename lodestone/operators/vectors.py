"""Vector search: cosine scores over unit vectors, filtered before the cut, and the life of a vector index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.sources.files import checkpointed


def unit_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.withColumn(column, T.l2_normalize(F.col(column)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _packs(vectors: DataFrame, columns: dict[str, str], rows: int) -> DataFrame:
    """Vectors (embedding) of one width packed together, as unit rows of a matrix: (width, data, one array for each of
    ``columns``, by name and type)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["embedding"].notna()]
            for width, part in batch.groupby(batch["embedding"].map(len)):
                for at in range(0, len(part), rows):
                    own = part.iloc[at : at + rows]
                    x = np.stack(own["embedding"].to_list()).astype(float).reshape(len(own), width)
                    norm = np.sqrt((x * x).sum(1, keepdims=True))
                    data = np.divide(x, norm, out=x, where=norm > 0).tobytes()
                    yield pd.DataFrame({"width": [width], "data": [data], **{c: [own[c].tolist()] for c in columns}})

    arrays = ", ".join(f"{c} array<{kind}>" for c, kind in columns.items())
    return vectors.select("embedding", *columns).mapInPandas(pack, f"width int, data binary, {arrays}")


def cosine_scores(chunks: DataFrame, queries: DataFrame, where: Column | None = None, least: float | None = None, most: int | None = None, block: int = 2048, most_sent: int = 64 << 20) -> DataFrame:
    """(query_id, chunk_id, document, score) of stated queries (query_id, embedding) against all chunks (chunk_id,
    document, embedding). ``where`` drops chunks before any score is computed; widths that differ and null vectors give
    no rows. Blocks of queries meet blocks of chunks, each as one matrix product; only scores of at least ``least``
    leave it, and of each query at most the ``most`` best with all that equal the last of them. Queries of up to
    ``most_sent`` bytes are sent to all tasks; more are numbered by block, and each block of chunks is sent to each."""
    kinds = {**dict(chunks.dtypes), **dict(queries.select("query_id").dtypes)}
    rows = chunks if where is None else chunks.where(where)
    have = _packs(rows, {c: kinds[c] for c in ("chunk_id", "document")}, block)
    asked = _packs(queries, {"query_id": kinds["query_id"]}, block)
    asked = asked.select(F.col("width").alias("q_width"), F.col("data").alias("q_data"), "query_id", F.monotonically_increasing_id().alias("q_no"))
    asked = checkpointed(asked)

    def best(pack, width: int, data: bytes, query_id: list) -> pd.DataFrame:
        got = np.frombuffer(data).reshape(-1, width) @ np.frombuffer(pack.data).reshape(-1, width).T
        keep = np.ones(got.shape, bool) if least is None else got >= least
        if most is not None and most < got.shape[1]:
            keep &= got >= np.partition(got, -most, axis=1)[:, -most][:, None]
        q, c = np.nonzero(keep)
        take = lambda values, at: pd.Series(list(values), dtype=object).iloc[at].reset_index(drop=True)
        return pd.DataFrame({"query_id": take(query_id, q), "chunk_id": take(pack.chunk_id, c), "document": take(pack.document, c), "score": got[q, c]})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                if r.width and r.width == r.q_width:
                    yield best(r, r.q_width, r.q_data, r.query_id)

    gives = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, document {kinds['document']}, score double"
    size = asked.agg(F.coalesce(F.sum(F.length("q_data")), F.lit(0))).first()[0]
    if size <= most_sent:
        # once to each worker: next to each block of chunks they would fill Arrow's batches with copies
        sent = asked.sparkSession.sparkContext.broadcast([tuple(r) for r in asked.select("q_width", "q_data", "query_id").collect()])

        def score_sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples():
                    for width, data, query_id in sent.value:
                        if width and width == r.width:
                            yield best(r, width, data, query_id)

        return have.mapInPandas(score_sent, gives)
    numbers = asked.agg(F.collect_list("q_no").alias("all"))  # a number for each ``block`` queries
    spread = have.crossJoin(F.broadcast(numbers)).withColumn("q_no", F.explode("all")).drop("all")
    return spread.join(asked, "q_no").drop("q_no").mapInPandas(score, gives)


def nearest(chunks: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """The best ``k`` chunks of each query, with their rank: the best of each pair of blocks, then the best of these."""
    return vector_topk(cosine_scores(chunks, queries, where, most=k), k)


def retrieve(chunks: DataFrame, queries: DataFrame, picks: DataFrame, top_k: int, shortlist: int = 30, rerank: bool = True, where: Column | None = None) -> DataFrame:
    """The ``top_k`` (1 to 50) chunks of each query out of a ``shortlist``, with candidate_count, reranked and warning.
    Picks (query_id, picks) of a reranker count only if asked for and where the shortlist has more than ``top_k``; a
    query for which the reranker gave nothing usable keeps its shortlist and a warning."""
    if not 1 <= top_k <= 50:
        raise ValueError(f"top_k must be from 1 to 50, not {top_k}")
    short = nearest(chunks, queries, shortlist, where).withColumn("candidate_count", F.count("*").over(Window.partitionBy("query_id")))
    wanted = F.lit(rerank) & (F.col("candidate_count") > top_k)
    use = short.where(wanted).select("query_id").distinct()
    chosen = apply_picks(short, picks.join(use, "query_id", "left_semi"), top_k)
    warning = F.when(wanted & ~F.col("reranked"), "no usable pick; the shortlist is shown as it was ranked")
    return chosen.withColumn("warning", warning)


def vector_topk(scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each query by score, equal ones by chunk_id; Spark keeps k rows a query in each partition
    before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def apply_picks(shortlist: DataFrame, picks: DataFrame, top_k: int) -> DataFrame:
    """A reranker's picks (query_id, picks: array of places from 1) over a shortlist (query_id, rank, ...): places out
    of range and repeats are ignored, ``top_k`` stay; a query without a usable pick keeps its shortlist, unreranked."""
    chosen = picks.select("query_id", F.posexplode("picks").alias("ord", "rank")).groupBy("query_id", "rank").agg(F.min("ord").alias("ord"))
    joined = shortlist.join(chosen, ["query_id", "rank"], "left")
    any_pick = F.max(F.col("ord").isNotNull()).over(Window.partitionBy("query_id"))
    joined = joined.withColumn("reranked", any_pick).where(~F.col("reranked") | F.col("ord").isNotNull())
    order = Window.partitionBy("query_id").orderBy(F.coalesce("ord", "rank"))
    return joined.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k).drop("ord")


def reuse_vectors(chunks: DataFrame, old: DataFrame, model: str) -> DataFrame:
    """``chunks`` (document, heading_path, text, ...) with the vector of an old chunk (the same with model, embedding)
    that is equal in all three and was made by ``model``, else null. Nulls are equal to nulls and to nothing else."""
    parts = [F.coalesce(F.concat(F.lit("="), F.length(c).cast("string"), F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("document", "heading_path", "text")]
    key = F.sha2(F.concat(*parts), 256)  # lengths keep the parts apart
    mine = old.where((F.col("model") == model) & F.col("embedding").isNotNull())
    known = mine.select(key.alias("k"), F.col("embedding").alias("vector")).groupBy("k").agg(F.first("vector").alias("vector"))
    return chunks.withColumn("k", key).join(known, "k", "left").drop("k")


def alignment_report(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: chunks, vectors, and how many chunks lack a vector, have several, or vectors lack a chunk or width."""
    per = vectors.groupBy("chunk_id").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"))
    both = chunks.select("chunk_id", F.lit(1).alias("c")).join(per, "chunk_id", "full_outer")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return both.agg(n(F.col("c").isNotNull()).alias("chunks"), n(F.col("c").isNotNull() & F.col("n").isNull()).alias("missing"), n(F.col("n") > 1).alias("repeated"), n(F.col("c").isNull()).alias("orphans"), F.countDistinct("lo").alias("widths"))


def index_meta(chunks: DataFrame) -> DataFrame:
    """One row: how many documents and chunks, and the width of vectors."""
    return chunks.agg(F.countDistinct("document").alias("document_count"), F.count("*").alias("chunk_count"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).cast("bigint").alias("dimensions"))


def distinct_sketches(rows: DataFrame, column: str, by: list[str], bits: int = 14) -> DataFrame:
    """(``by``, n, sketch): row counts and HyperLogLog sketches of a column's distinct values, for each part of a table
    (a day, a partition), to be stored; a new part needs no other part's rows. The error is 1.04 / sqrt(2 ** bits)."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(column).cast("string"), bits).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(``by``, n, about): rows and about how many distinct values stored sketches have together."""
    return sketches.groupBy(*(by or [])).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))


def remove_documents(chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks of all other documents, and (document, removed): how many chunks each of ``gone`` (document) had."""
    names = gone.select("document").distinct()
    removed = names.join(chunks.groupBy("document").agg(F.count("*").alias("n")), "document", "left")
    return chunks.join(names, "document", "left_anti"), removed.select("document", F.coalesce("n", F.lit(0)).alias("removed"))
