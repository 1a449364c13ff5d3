"""Hooks for what a user brings: embedders, scorers and extractors, with defaults that need no network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf

from lodestone.functions import text as T
from lodestone.functions.chunking import chunk_markdown

Embedder = Callable[[list[str]], list[np.ndarray]]
Scorer = Callable[[pd.DataFrame], pd.DataFrame]
Extractor = Callable[[list], list]


def hashing_embedder(width: int = 64) -> Embedder:
    """Word counts in hash buckets with signs, of unit length; equal texts give equal vectors."""

    def embed(texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            v = np.zeros(width)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % width] += 1 if h >> 63 else -1
            out.append(v / (np.linalg.norm(v) or 1))
        return out

    return embed


def embed_chunks(chunks: DataFrame, embedder: Embedder | None = None, most_tokens: int = 15_000, most_items: int = 50, counter: Callable[[Column], Column] = T.estimate_tokens) -> DataFrame:
    """(chunk_id, embedding) of chunks (chunk_id, text), asked for in batches that hold ``most_tokens`` tokens by
    ``counter`` and ``most_items`` texts at most, or one longer text; one vector for each text or an error. A batch may
    span Arrow batches, and null texts are empty."""
    make = embedder or hashing_embedder()

    def ask(ids: list, texts: list[str]) -> pd.DataFrame:
        vectors = make(texts)
        if len(vectors) != len(texts):
            raise ValueError(f"{len(texts)} texts gave {len(vectors)} vectors")
        return pd.DataFrame({"chunk_id": ids, "embedding": [v.tolist() for v in vectors]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, used = [], [], 0
        for rows in batches:
            for chunk_id, text, tokens in zip(rows["chunk_id"].tolist(), rows["text"].tolist(), rows["tokens"].tolist(), strict=True):
                if texts and (used + tokens > most_tokens or len(texts) >= most_items):
                    yield ask(ids, texts)
                    ids, texts, used = [], [], 0
                ids.append(chunk_id)
                texts.append(text)
                used += tokens
        if texts:
            yield ask(ids, texts)

    kind, text = dict(chunks.dtypes)["chunk_id"], F.coalesce("text", F.lit(""))
    return chunks.select("chunk_id", text.alias("text"), counter(text).cast("bigint").alias("tokens")).mapInPandas(run, f"chunk_id {kind}, embedding array<double>")


def score_candidates(candidates: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """(query_id, path, score, confidence) from batches (query_id, batch, path, raw) of candidates. The default puts
    raw scores into four levels by their rank in the batch."""

    def default(rows: pd.DataFrame) -> pd.DataFrame:
        share = rows["raw"].rank(pct=True, method="min")
        return pd.DataFrame({"path": rows["path"], "score": np.minimum(3, np.floor(share * 4)), "confidence": share})

    judge = scorer or default

    def run(group: pd.DataFrame) -> pd.DataFrame:
        got = judge(group)
        return got.assign(query_id=group["query_id"].iloc[0])[["query_id", "path", "score", "confidence"]]

    kinds = dict(candidates.dtypes)
    return candidates.groupBy("query_id", "batch").applyInPandas(run, f"query_id {kinds['query_id']}, path {kinds['path']}, score double, confidence double")


def extract_texts(pages: DataFrame, key: str = "page_id", extractor: Extractor | None = None, batch: int = 50, content: str = "html") -> DataFrame:
    """(key, ok, markdown, reason) of pages or files (key, ``content``: text or bytes). An ``extractor`` gets contents
    as they are, bytes as bytes, in batches and gives for each its markdown, or an exception that says why there is
    none. Without one, bytes are read as UTF-8 (no text where they hold a zero byte), tags are stripped and scripts and
    styles dropped, by Spark's own expressions."""
    pages = pages.select(key, F.col(content).alias("html"))
    if extractor is None:
        text = F.col("html")
        if dict(pages.dtypes)["html"] == "binary":
            text = F.when(~F.contains("html", F.lit(b"\x00")), F.make_valid_utf8(F.col("html").cast("string")))
        body = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
        clean = F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))
        ok = F.coalesce(clean, F.lit("")) != ""
        return pages.select(key, ok.alias("ok"), F.when(ok, clean).alias("markdown"), F.when(~ok, "no text").alias("reason"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                got = list(extractor(part["html"].tolist()))
                if len(got) != len(part):
                    raise ValueError(f"{len(part)} pages gave {len(got)} texts")
                bad = [isinstance(x, Exception) or not x for x in got]
                reasons = [(str(x) if isinstance(x, Exception) else "no text") if b else None for x, b in zip(got, bad, strict=True)]
                yield pd.DataFrame({key: part[key], "ok": [not b for b in bad], "markdown": [None if b else x for x, b in zip(got, bad, strict=True)], "reason": reasons})

    kind = dict(pages.dtypes)[key]
    return pages.select(key, "html").mapInPandas(run, f"{key} {kind}, ok boolean, markdown string, reason string")


@arrow_udtf(returnType="doc_id bigint, chunk_index int, heading_path string, text string, tokens int")
class ChunkTable:
    """The chunks of a table's texts (doc_id, text), as the chunker of ``operators.corpus`` makes them, for SQL:
    ``SELECT * FROM chunk_table(TABLE(docs), 300, 50)``. Rows come and go in Arrow batches."""

    def eval(self, docs: pa.RecordBatch, tokens: pa.Array, overlap: pa.Array) -> Iterator[pa.Table]:
        size, shared = tokens[0].as_py(), overlap[0].as_py()
        out: dict[str, list] = {c: [] for c in ("doc_id", "chunk_index", "heading_path", "text", "tokens")}
        for doc_id, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True):
            for n, row in enumerate(chunk_markdown(text or "", size, shared)):
                for c, v in zip(out, (doc_id, n, *row), strict=True):
                    out[c].append(v)
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32())
        yield pa.Table.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))
