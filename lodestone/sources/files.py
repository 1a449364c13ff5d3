"""Files as tables: listing, ignore rules, binary detection, text reading, and the stored index."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions import paths as P
from lodestone.sources.store import latest, new_version, publish

# Folders that a scan never enters.
SKIPPED = ["node_modules", ".git", "dist", "build", "__pycache__", "venv", ".venv", "target", "bin", "obj", ".next", ".cache"]
# Fixed value: names of backups that are never listed.
BACKUP = r"(?i)\.bak(?:\.[0-9T]+)?$"


def shared_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; only a session on this machine alone may lack one."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the session's shared checkpoint folder: used more than once, computed once."""
    scratch_folder(df.sparkSession, "checkpoint")
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()


def scan_tree(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """(path, name, dir, size) of all files below ``root``, less those in skipped folders at any depth below it,
    backups and binary extensions; folders come before files, each by name. Spark lists them, and follows no links of
    its own; contents are only read when asked for."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:/{0,2}", "/"), "/+", "/")
    below = F.substring(plain(F.col("path")), F.length(F.regexp_replace(plain(F.lit(root)), "/$", "")) + 2, F.length("path"))
    rows = rows.withColumn("name", P.basename(F.col("path"))).withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).withColumn("__parts", F.split(below, "/"))
    folders = F.slice("__parts", 1, F.size("__parts") - 1)
    kept = rows.where(~F.exists(folders, lambda s: s.isin(SKIPPED)) & ~F.col("name").rlike(BACKUP) & ~P.extension(F.col("name")).isin(P.BINARY))
    place = F.concat(F.transform(folders, lambda s: F.concat(F.lit("0"), s)), F.array(F.concat(F.lit("1"), "name")))
    return kept.orderBy(place).select("path", "name", "dir", F.col("length").alias("size"), *["content"] * with_content)


def binary_sniff(files: DataFrame) -> DataFrame:
    """Adds is_binary: a listed extension, a zero byte in the first 1024, or no content."""
    zero = F.contains(F.substring("content", 1, 1024), F.lit(b"\x00"))
    return files.withColumn("is_binary", P.extension(F.col("path")).isin(P.BINARY) | F.coalesce(zero, F.lit(True)))


def read_text(files: DataFrame, most_bytes: int = 5 << 20) -> tuple[DataFrame, DataFrame]:
    """Texts (path, content) of files within ``most_bytes``, and the others with a reason. Where ``files`` has a
    ``length``, as Spark's listing gives it, that decides, so that the contents of large files are never read."""
    size = F.col("length") if "length" in files.columns else F.octet_length("content")
    good = files.where(size <= most_bytes).select("path", F.decode("content", "UTF-8").alias("content"))
    return good, files.where(size > most_bytes).select("path", F.lit("too large").alias("reason"), size.cast("bigint").alias("size"))


def read_head(files: DataFrame, n: int = 16_384) -> DataFrame:
    """(path, head): the first ``n`` bytes of contents as text; a character that the cut splits becomes U+FFFD."""
    return files.select("path", F.make_valid_utf8(F.substring("content", 1, n).cast("string")).alias("head"))


def read_commit_log(lines: DataFrame, by: str = "project", most: int | None = 40, order: str = "line_no") -> DataFrame:
    """(project, seq, commit, ord, path) of the ``most`` last commits of each project's log (project, line_no, line):
    lines that begin with __C__ open a commit (seq from 0, the newest first), the other lines that aren't blank are
    its files, with slashes. Lines before the ``most``-th last opening of a project are left out first, so that what is
    left doesn't grow with the log; it is sorted into ranges, so that a long one is read by many tasks."""
    if most is not None:
        opened = lines.where(F.startswith("line", F.lit("__C__"))).select(by, F.col(order).alias("__at"))
        newest = Window.partitionBy(by).orderBy(F.col("__at").desc())
        last = opened.withColumn("__k", F.row_number().over(newest)).where(F.col("__k") <= most).groupBy(by).agg(F.min("__at").alias("__from"))
        last = checkpointed(last)
        lines = lines.join(F.broadcast(last) if last.count() <= 100_000 else last, by).where(F.col(order) >= F.col("__from")).drop("__from")
    ranged = checkpointed(lines.select(by, order, "line").repartitionByRange(by, order).sortWithinPartitions(by, order).withColumn("__part", F.spark_partition_id()))
    head = F.startswith("line", F.lit("__C__"))
    within = Window.partitionBy(by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.withColumn("__n", F.sum(F.when(head, 1).otherwise(0)).over(within)).withColumn("__c", F.last(F.when(head, F.expr("substring(line, 6)")), ignorenulls=True).over(within))
    before = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(by, "__part").agg(F.max("__n").alias("__k"), F.max_by("__c", F.when(F.col("__c").isNotNull(), F.col(order))).alias("__last"))
    parts = parts.select(by, "__part", F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__base"), F.last("__last", ignorenulls=True).over(before).alias("__open"), F.sum("__k").over(Window.partitionBy(by)).alias("__all"))
    rows = rows.where(~head & (F.trim("line") != "")).join(parts, [by, "__part"])
    rows = rows.withColumn("seq", F.col("__all") - F.col("__base") - F.col("__n")).withColumn("commit", F.coalesce("__c", "__open")).where("commit is not null")
    rows = rows if most is None else rows.where(F.col("seq") < most)
    return rows.select(by, "seq", "commit", F.col(order).alias("ord"), F.regexp_replace("line", r"\\", "/").alias("path"))


def ignore_filter(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files (path) that no rule set ignores. Rules (base, ord, pattern, negated) count below their own base, the last
    match of a base decides for it, and any base that ignores a file is enough. A path meets the rules of its own
    folders alone, by an equi-join."""
    parts = F.split("path", "/")
    bases = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inside = F.when(F.col("base") == "", F.col("path")).otherwise(F.expr("substring(path, length(base) + 2)"))
    hits = files.select("path", F.explode(bases).alias("base")).join(rules, "base").where(F.regexp_like(inside, F.col("pattern")))
    last = hits.groupBy("path", "base").agg(F.max_by("negated", "ord").alias("negated"))
    return files.join(last.where("not negated").select("path").distinct(), "path", "left_anti")


def write_index(chunks: DataFrame, vectors: DataFrame, folder: str, model: str, buckets: int | None = None) -> int:
    """Chunks (chunk_id, ...) and vectors (chunk_id, embedding) as a new version of the index in ``folder``, both in
    ``buckets`` by chunk_id (one for each shuffle partition if not given) and sorted by it; returns the version's number.
    Readers see it once all of it is written."""
    spark, path = chunks.sparkSession, new_version(folder)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, df in (("chunks", chunks), ("vectors", vectors)):
        table = f"writing_{uuid.uuid4().hex}"
        kind = df.sparkSession.createDataFrame([], df.schema)  # the table exists first, so that its folder is ours to name
        _bucketed_table(spark, table, kind, f"{path}/{name}", buckets)
        df.select(*kind.columns).write.insertInto(table)
        spark.sql(f"DROP TABLE {table}")
    facts = spark.read.parquet(f"{path}/vectors").agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("width")).first()
    kept = {"model": model, "buckets": str(buckets), "vector_count": str(facts["n"]), "dimensions": str(facts["width"])}
    return publish(spark, folder, path, **kept, chunks=chunks.schema.json(), vectors=vectors.schema.json())


def _bucketed_table(spark: SparkSession, table: str, like: DataFrame, path: str, buckets: int) -> None:
    columns = ", ".join(f"`{c}` {kind}" for c, kind in like.dtypes)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (chunk_id) SORTED BY (chunk_id) INTO {buckets} BUCKETS LOCATION '{path}'")


def read_index(spark: SparkSession, folder: str) -> DataFrame | None:
    """The index's last whole version, chunks joined with vectors bucket by bucket, without a shuffle; one side without
    the other, or a width that differs, shows in ``sound``. None where no index was written."""
    found = latest(spark, folder)
    if found is None:
        return None
    facts, sides = found["facts"], []
    for name in ("chunks", "vectors"):
        # the session's catalog knows a version under its own name, from the first time that it is read
        table = f"lodestone_{name}_{found['path'].rsplit('/', 1)[-1]}"
        if not spark.catalog.tableExists(table):
            like = spark.createDataFrame([], StructType.fromJson(json.loads(facts[name])))
            _bucketed_table(spark, table, like, f"{found['path']}/{name}", int(facts["buckets"]))
        sides.append(spark.table(table))
    chunks, vectors = sides
    both = chunks.join(vectors.withColumnRenamed("chunk_id", "v_id"), chunks["chunk_id"] == F.col("v_id"), "full_outer")
    both = both.withColumns({c: F.lit(facts[c]).cast(kind) for c, kind in (("vector_count", "bigint"), ("dimensions", "int"), ("model", "string"))})
    sound = F.col("chunk_id").isNotNull() & F.col("v_id").isNotNull() & (F.size("embedding") == F.col("dimensions"))
    return both.withColumn("sound", F.coalesce(sound, F.lit(False))).drop("v_id")


def conversion_ledger(docs: DataFrame, attempts: DataFrame) -> DataFrame:
    """(doc_id, status, error, image_analyzed) of documents (doc_id, name) and attempts (doc_id, engine, mode, error,
    figures, vision_error, warning). The first reason to fail counts; a warning is added to a success."""
    rows = docs.join(attempts.drop("name"), "doc_id", "left")
    ext = P.extension(F.col("name"))
    reason = (
        F.when(~P.is_supported_document(F.col("name")), "unsupported format")
        .when((F.col("engine") == "fast") & (F.col("mode") == "text-images") & (ext == ".pdf"), "the fast engine cannot extract images")
        .when(F.col("error").isNotNull(), F.col("error"))
    )
    analyzed = reason.isNull() & (F.coalesce("figures", F.lit(0)) > 0) & F.col("vision_error").isNull()
    return rows.select("doc_id", F.when(reason.isNull(), "converted").otherwise("failed").alias("status"), F.coalesce(reason, F.nullif(F.concat_ws("; ", "vision_error", "warning"), F.lit(""))).alias("error"), analyzed.alias("image_analyzed"))


def newest_first(rows: DataFrame, by: str, at: str) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.col(at).desc())))
