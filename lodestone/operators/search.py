"""Text search: weighted postings, BM25 with a stem fallback, query expansion, fusion and diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.corpus import ordered_paths
from lodestone.sources.files import checkpointed

K1, B, STEM_WEIGHT = 1.5, 0.75, 0.8
BODY, PATH, SYMBOL = 1.0, 3.0, 2.0

# Words without value for retrieval.
STOPWORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "aren't", "as",
    "at", "be", "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "can't",
    "cannot", "could", "couldn't", "did", "didn't", "do", "does", "doesn't", "doing", "don't", "down", "during",
    "each", "few", "for", "from", "further", "had", "hadn't", "has", "hasn't", "have", "haven't", "having", "he",
    "her", "here", "hers", "herself", "him", "himself", "his", "how", "i", "if", "in", "into", "is", "isn't", "it",
    "its", "itself", "let", "me", "more", "most", "my", "myself", "no", "nor", "not", "of", "off", "on", "once",
    "only", "or", "other", "ought", "our", "ours", "ourselves", "out", "over", "own", "same", "she", "should",
    "shouldn't", "so", "some", "such", "than", "that", "the", "their", "theirs", "them", "themselves", "then",
    "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was",
    "wasn't", "we", "were", "weren't", "what", "when", "where", "which", "while", "who", "whom", "why", "with",
    "won't", "would", "wouldn't", "you", "your", "yours", "yourself", "yourselves", "app", "please", "make", "want",
    "need", "trying", "sure", "actually", "properly",
]
# Words of users and the identifiers that code uses for them.
SYNONYMS = {
    "login": ["auth", "signin", "session", "token", "credential"],
    "logout": ["signout", "session", "auth"],
    "auth": ["login", "signin", "session", "token", "permission"],
    "session": ["token", "auth", "cookie", "state"],
    "indicator": ["status", "badge", "state", "dot", "signal", "pulse", "spinner", "working", "idle", "paused"],
    "status": ["indicator", "state", "working", "idle", "paused", "badge"],
    "working": ["busy", "generating", "thinking", "loading", "active", "progress"],
    "paused": ["pause", "continue", "resume", "interrupted"],
    "idle": ["ready", "inactive", "standby"],
    "spinner": ["loading", "indicator", "progress", "spin"],
    "button": ["btn", "click", "press", "action", "submit", "trigger"],
    "modal": ["dialog", "popup", "overlay", "window"],
    "dialog": ["modal", "popup", "alert", "confirm"],
    "page": ["view", "screen", "component", "dashboard", "panel"],
    "dashboard": ["panel", "view", "prompt", "board", "home"],
    "tree": ["hierarchy", "node", "filetree", "folder"],
    "tab": ["tabs", "switcher", "navigation", "panel"],
    "dark": ["theme", "darkmode", "light", "color", "mode"],
    "theme": ["dark", "light", "mode", "tailwind", "color", "style"],
    "color": ["theme", "style", "css", "class", "bg"],
    "slow": ["perf", "performance", "latency", "speed", "cache", "debounce", "throttle", "optimize"],
    "fast": ["speed", "perf", "performance", "latency", "cache", "optimize"],
    "faster": ["speed", "perf", "performance", "latency", "cache", "optimize"],
    "sluggish": ["slow", "perf", "performance", "latency", "lag", "speed", "cache", "optimize"],
    "lag": ["latency", "slow", "delay", "perf", "performance"],
    "speed": ["perf", "performance", "fast", "latency", "cache"],
    "perf": ["performance", "speed", "latency", "cache", "benchmark"],
    "ai": ["llm", "model", "provider", "prompt", "completion", "chat", "webchat"],
    "llm": ["ai", "model", "provider", "chat", "deepseek", "groq", "openai"],
    "chat": ["webchat", "conversation", "prompt", "message", "reply", "response"],
    "webchat": ["chat", "window", "deepseek", "chatgpt", "browser", "target"],
    "prompt": ["instruction", "template", "builder", "query", "input"],
    "file": ["path", "fs", "document", "entry", "tree"],
    "folder": ["dir", "directory", "path", "folder"],
    "git": ["vcs", "commit", "diff", "branch", "log", "history"],
    "diff": ["patch", "change", "viewer", "compare", "hunk"],
    "test": ["spec", "unit", "e2e", "vitest", "playwright", "assert"],
    "error": ["fail", "failure", "exception", "catch", "reject", "warn"],
    "bug": ["issue", "fix", "error", "defect", "problem"],
    "upload": ["import", "scanner", "attach", "file", "converter"],
}


def bm25_docs(files: DataFrame) -> DataFrame:
    """Files (path, content) as three channels of tokens: body, path_tokens, symbols (of the first line)."""
    text = F.coalesce("content", F.lit(""))
    return files.select("path", T.tokenize(text).alias("body"), T.tokenize(F.col("path")).alias("path_tokens"), T.tokenize(F.substring_index(text, "\n", 1)).alias("symbols"))


def postings(docs: DataFrame) -> DataFrame:
    """path, term, weight: how much a document's channels say of a term."""
    weigh = lambda c, w: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    terms = docs.select("path", F.explode(F.concat(weigh("body", BODY), weigh("path_tokens", PATH), weigh("symbols", SYMBOL))).alias("t"))
    return terms.groupBy("path", F.col("t.term").alias("term")).agg(F.sum("t.w").alias("weight"))


def stem_postings(terms: DataFrame) -> DataFrame:
    """The same by stem, from postings."""
    return terms.groupBy("path", T.stem(F.col("term")).alias("stem")).agg(F.sum("weight").alias("weight"))


def doc_lengths(docs: DataFrame) -> DataFrame:
    return docs.select("path", (F.size("body") + 2 * F.size("path_tokens")).cast("bigint").alias("doc_len"))


def bm25_scores(docs: DataFrame, queries: DataFrame, with_stems: bool = True) -> DataFrame:
    """(query_id, path, score) of every document with a query term, for queries (query_id, terms).

    Where a document lacks a term, 0.8 times its weight for the term's stem counts instead. A term's document
    frequency is that of the term itself if any document has it, else of its stem.

    Texts are tokenised once, into an index (path, doc_len, tokens with weights) that is written to the shared folder.
    Only its distinct tokens are stemmed; those that some query term needs, exactly or by stem, pick their postings,
    and only those travel on.
    """
    weigh = lambda c, w: F.transform(c, lambda t: F.struct(t.alias("token"), F.lit(w).alias("w")))
    channels = F.concat(weigh("body", BODY), weigh("path_tokens", PATH), weigh("symbols", SYMBOL))
    index = checkpointed(docs.select("path", (F.size("body") + 2 * F.size("path_tokens")).alias("doc_len"), channels.alias("t")))
    asked = queries.select("query_id", F.explode_outer("terms").alias("term")).where("term is not null")
    wanted = asked.select("term").distinct().withColumn("stem", T.stem(F.col("term")))
    stats = index.agg(F.count("*").alias("n"), F.avg("doc_len").alias("avg_len"))
    spread = index.select("path", "doc_len", F.explode("t").alias("t")).select("path", "doc_len", "t.token", "t.w")
    # the vocabulary, each word stemmed once, and which words speak for which terms
    words = spread.select("token").distinct().withColumn("stem", T.stem(F.col("token")))
    needed = words.join(wanted, "stem").select("token", "term") if with_stems else words.select("token", F.col("token").alias("term")).join(wanted.select("term"), "term", "left_semi")
    met = spread.join(needed, "token")
    # one row per document and wanted term: its own weight there, and that of all tokens with its stem
    tf = met.groupBy("term", "path", "doc_len").agg(F.sum(F.when(F.col("token") == F.col("term"), F.col("w")).otherwise(0.0)).alias("exact"), F.sum("w").alias("stem_w"))
    tf = checkpointed(tf)
    df = tf.groupBy("term").agg(F.count_if(F.col("exact") > 0).alias("own"), F.count("*").alias("by_stem"))
    df = df.select("term", F.when(F.col("own") > 0, F.col("own")).otherwise(F.col("by_stem")).alias("df"))
    tf = tf.select("path", "doc_len", "term", F.when(F.col("exact") > 0, F.col("exact")).otherwise(F.col("stem_w") * STEM_WEIGHT).alias("tf"))
    scored = tf.join(df, "term").join(F.broadcast(stats))  # one row
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.when(F.col("avg_len") == 0, 1).otherwise(F.col("avg_len")))
    part = scored.select("path", "term", (idf * F.col("tf") * (K1 + 1) / norm).alias("part"))
    return asked.join(part, "term").groupBy("query_id", "path").agg(F.sum("part").alias("score")).where("score > 0")


def topk(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "path") -> DataFrame:
    """The ``k`` best of each group with their rank from 1; equal scores in the order of ``tie``. Spark cuts each
    partition to k rows a group before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def expand_terms(pieces: DataFrame) -> DataFrame:
    """(query_id, kind, term, ord) from queries (query_id, terms): primary terms without stopwords, or all of them if
    nothing else is left; then stems and synonyms that aren't primary, in first-seen order."""
    synonyms = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    good = F.filter("terms", lambda t: ~t.isin(STOPWORDS))
    rows = pieces.select("query_id", F.when(F.size(good) > 0, good).otherwise(F.col("terms")).alias("primary"), good.alias("good"))
    more = lambda t: F.concat(
        F.when((T.stem(t) != t) & (F.length(T.stem(t)) >= 2), F.array(T.stem(t))).otherwise(F.array().cast("array<string>")),
        F.coalesce(F.element_at(synonyms, t), F.element_at(synonyms, T.stem(t)), F.array().cast("array<string>")),
    )
    rows = rows.withColumn("expanded", F.array_except(F.array_distinct(F.flatten(F.transform("good", more))), F.col("primary")))
    both = [rows.select("query_id", F.lit(k).alias("kind"), F.posexplode(k).alias("ord", "term")) for k in ("primary", "expanded")]
    return both[0].unionByName(both[1])


def merge_terms(local: Column, generated: Column) -> Column:
    """A query's own terms in their order, then those of a generated text that are new: words of 2 to 40 letters and
    digits without stopwords."""
    made = F.filter(F.split(F.lower(generated), "[^a-z0-9]+"), lambda t: ~t.isin(STOPWORDS) & F.length(t).between(2, 40))
    return F.array_distinct(F.concat(local, made))


def fuse_ranks(signals: DataFrame, weights: dict[str, float], damp: int = 5, long: bool = False) -> DataFrame:
    """(query_id, path, score, reasons) from (query_id, path, signal, raw): each signal gives weight / (rank + damp),
    ranks from 0 by raw score, ties by path; reasons in the order of the weights, which is that in which signals count.
    Where a signal has a ``long`` list of hits for a query, it is ranked by ranges, in many tasks."""
    if long:
        rows = signals.withColumn("__by", F.struct("query_id", "signal")).withColumn("__order", F.struct((-F.col("raw")).alias("raw"), "path"))
        rank = F.col("place") - 1
        signals = ordered_paths(rows, "__by", "__order").drop("__by", "__order")
    else:
        rank = F.row_number().over(Window.partitionBy("query_id", "signal").orderBy(F.col("raw").desc(), "path")) - 1
    weight = F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("signal"))
    place = F.element_at(F.create_map(*[x for n, k in enumerate(weights) for x in (F.lit(k), F.lit(n))]), F.col("signal"))
    ranked = signals.withColumn("part", weight / (rank + damp)).withColumn("ord", place)
    return ranked.groupBy("query_id", "path").agg(F.sum("part").alias("score"), F.transform(F.array_sort(F.collect_set(F.struct("ord", "signal"))), lambda s: s["signal"]).alias("reasons"))


def purpose(reasons: Column, graph_missing: Column) -> Column:
    """What to tell of a hit's reasons; where no symbol index was there to ask, that too."""
    said = F.when(F.size(reasons) > 0, F.concat(F.lit("matched via "), F.array_join(reasons, ", "))).otherwise("candidate")
    return F.when(graph_missing, F.concat(said, F.lit(" (text only, there is no symbol index)"))).otherwise(said)


def graph_expand(candidates: DataFrame, edges: DataFrame, seeds: int = 10) -> DataFrame:
    """(query_id, path, bump) for neighbours (src, dst) of each query's best ``seeds`` candidates: 0.3 for each
    adjacent seed, and 0.1 more once for a path that wasn't a candidate."""
    top = topk(candidates, seeds).select("query_id", F.col("path").alias("src"))
    hits = top.join(edges, "src").groupBy("query_id", F.col("dst").alias("path")).agg(F.count("*").alias("k"))
    known = candidates.select("query_id", "path", F.lit(True).alias("known"))
    return hits.join(known, ["query_id", "path"], "left").select("query_id", "path", (F.col("k") * 0.3 + F.when(F.col("known"), 0.0).otherwise(0.1)).alias("bump"))


def cochange_in(candidates: DataFrame, commits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(path, together, bump): how often candidates (path) share a commit (commit, path), without a self join; apart
    for each value of the columns ``by`` of the candidates."""
    keys = by or []
    inside = commits.join(candidates.select(*keys, "path"), "path")
    sizes = inside.withColumn("k", F.count("*").over(Window.partitionBy(*keys, "commit"))).where("k >= 2")
    return sizes.groupBy(*keys, "path").agg(F.sum(F.col("k") - 1).alias("together")).withColumn("bump", F.least("together", F.lit(10)) * 0.4)


def cochange_out(candidates: DataFrame, commits: DataFrame, seeds: DataFrame, least: int = 2, by: list[str] | None = None) -> DataFrame:
    """(path, together, bump) of files that aren't candidates but share commits with seeds, at least ``least`` times;
    apart for each value of the columns ``by``."""
    keys = by or []
    hit = commits.join(seeds.select(*keys, "path"), "path").groupBy(*keys, "commit").agg(F.count("*").alias("k"))
    outside = hit.join(commits, "commit").join(candidates.select(*keys, "path"), [*keys, "path"], "left_anti")
    return outside.groupBy(*keys, "path").agg(F.sum("k").alias("together")).where(F.col("together") >= least).withColumn("bump", F.least("together", F.lit(6)) * 0.3)


def hybrid_search(signals: DataFrame, edges: DataFrame, commits: DataFrame, known: DataFrame, directory: Column, weights: dict[str, float], seeds: int = 10, limit: int = 60) -> DataFrame:
    """(query_id, path, score, rank, reasons) from the hits of several searches (query_id, path, signal, raw).

    Hits on known paths are fused by rank. The best ``seeds`` of each query then reach over edges (src, dst) to their
    neighbours; candidates, the neighbours among them, gain by commits (commit, path) that they share, and known files
    enter that share two or more commits with seeds. What is left is diversified over directories. Reasons are the
    signals in the order of ``weights``, then import-graph, then co-change.
    """
    # scores that decide an order are rounded, so that sums in another order don't change it
    fused = fuse_ranks(signals, weights).join(known, "path", "left_semi")  # unknown paths keep their ranks
    fused = checkpointed(fused.select("query_id", "path", F.round("score", 9).alias("score"), "reasons"))
    none = F.array().cast("array<string>")
    because = lambda df, reason: df.select("query_id", "path", F.col("bump").alias("score"), F.array(F.lit(reason)).alias("reasons"))
    # one row of each kind, so that the reasons of a path follow each other by kind
    gather = lambda kind: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(kind, "reasons"))), lambda r: r["reasons"]))
    top = topk(fused, seeds).select("query_id", "path")
    graph = because(graph_expand(fused, edges, seeds).join(known, "path", "left_semi"), "import-graph")
    both = fused.withColumn("kind", F.lit(0)).unionByName(graph.withColumn("kind", F.lit(1)))
    pool = checkpointed(both.groupBy("query_id", "path").agg(F.sum("score").alias("score"), gather("kind").alias("reasons")))
    inside = because(cochange_in(pool, commits, ["query_id"]), "co-change")
    outside = because(cochange_out(pool, commits, top, by=["query_id"]).join(known, "path", "left_semi"), "co-change")
    every = pool.withColumn("kind", F.lit(0)).unionByName(inside.unionByName(outside).withColumn("kind", F.lit(1)))
    every = every.groupBy("query_id", "path").agg(F.round(F.sum("score"), 9).alias("score"), F.coalesce(gather("kind"), none).alias("reasons"))
    return diversify(every, directory, limit=limit)


def diversify(candidates: DataFrame, directory: Column, penalty: float = 0.7, limit: int = 60, by: str = "query_id") -> DataFrame:
    """The greedy choice that multiplies a directory's next score by ``penalty`` for each pick from it, as one sort:
    within a directory picks go by score, so the i-th is worth score * penalty^i. Scores stay as they were."""
    rows = candidates.withColumn("__dir", directory)
    inside = Window.partitionBy(by, "__dir").orderBy(F.col("score").desc(), "path")
    # no more than ``limit`` of a directory can be picked: Spark cuts to as many before the shuffle
    rows = rows.withColumn("__n", F.row_number().over(inside)).where(F.col("__n") <= limit)
    rows = rows.withColumn("__worth", F.round(F.col("score") * F.pow(F.lit(penalty), F.col("__n") - 1), 9)).drop("__n")
    order = Window.partitionBy(by).orderBy(F.col("__worth").desc(), "path")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("__dir", "__worth")


def recent_files(commits: DataFrame, most: int = 60, by: str = "project") -> DataFrame:
    """(project, path, rank) by the latest commit of each file, then its place in it, from (project, seq, ord, path)
    with seq 0 the latest commit."""
    first = commits.groupBy(by, "path").agg(F.min(F.struct("seq", "ord")).alias("at"))
    order = Window.partitionBy(by).orderBy("at", "path")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(by, "path", "rank")
