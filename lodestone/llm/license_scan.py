"""License scan by diagonal voting, in DataFrame operations only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.license_texts import BASE, PASSAGES
from lodestone.llm.shared import text_keys

#: What separates words, once A to Z are lower-case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
Templates = tuple[tuple[str, str], ...]


def words(text: Column) -> Column:
    """The words of a text (null: none), with A to Z in lower case and no other letter changed."""
    plain = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(plain, BETWEEN), lambda w: w != "")


def _template_words(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN, text.lower()) if w]


def template_grams(base: Templates = BASE, passages: Templates = PASSAGES, k: int = 3) -> list[tuple]:
    """(gram, n, template, place, words, label, exact) for each n-word gram of each template; n is ``k``, or all words
    of a shorter template."""
    rows = []
    for no, (text, label) in enumerate((*base, *passages)):
        own = _template_words(text)
        if len(own) < 2:
            raise ValueError(f"a template has two words or more: {text!r}")
        n = min(k, len(own))
        rows += [(" ".join(own[at : at + n]), n, no, at, len(own), label, no < len(base)) for at in range(len(own) - n + 1)]
    return rows


def _grams(w: Column, n: int, grams: list[str]) -> Column:
    """Each run of ``n`` words with its place that can be one of ``grams``: its first two words begin one, and another
    has its last one. Only these are put together."""
    starts, ends = sorted({tuple(g.split(" ")[:2]) for g in grams}), sorted({g.split(" ")[-1] for g in grams})
    first, second = sorted({a for a, _ in starts}), sorted({b for _, b in starts})

    def own(x: Column, i: Column) -> Column:
        good = x.isin(first) & F.get(w, i + 1).isin(second) & F.get(w, i + n - 1).isin(ends)
        return F.when(good, F.struct(i.alias("at"), F.array_join(F.slice(w, i + 1, n), " ").alias("own")))

    return F.filter(F.transform(w, own), lambda g: g.isNotNull())


_ROW = ("doc_id", "h1", "h2", "n_words")


def _bands(docs: DataFrame, id_col: str, text_col: str, base: Templates, passages: Templates, k: int, drift: int) -> DataFrame:
    """Per text (doc_id, h1, h2, n_words) and diagonal: template, label, exact, full (all grams on this diagonal), and
    of the band of diagonals that begins here the share of the template's words that stand in it in order, with the
    band's first and last word. A text without votes has one row without a template; ``copies`` counts its rows there."""
    spark, rows = docs.sparkSession, template_grams(base, passages, k)
    kinds = "gram string, n int, template int, place int, words int, label string, exact boolean"
    grams = spark.createDataFrame(rows, kinds).withColumn("h", F.xxhash64("gram"))
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *text_keys(F.col(text_col)), words(F.col(text_col)).alias("w"))
    lengths = sorted({r[1] for r in rows})
    itself = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("own")))
    every = F.concat(*[_grams(F.col("w"), n, [r[0] for r in rows if r[1] == n]) for n in lengths], itself)
    spread = own.select("doc_id", "h1", "h2", F.size("w").cast("bigint").alias("n_words"), F.explode(every).alias("g"))
    spread = spread.select(*_ROW, "g.at", "g.own").withColumn("h", F.xxhash64("own"))
    votes = spread.join(F.broadcast(grams), (spread["h"] == grams["h"]) & (F.col("own") == F.col("gram")), "left").where("own is null or template is not null")
    votes = votes.withColumn("diagonal", F.col("at") - F.col("place"))
    # partial sets before the shuffle: a diagonal's distinct places, at most the template's length
    about = ("template", "diagonal", "n", "words", "label", "exact")
    lines = votes.groupBy(*_ROW, *about).agg(F.array_sort(F.collect_set("place")).alias("places"), F.count(F.when(F.col("own").isNull(), 1)).alias("copies"))
    # neighbouring diagonals, at most ``drift`` apart in all, make a band
    band = Window.partitionBy(*_ROW, "template").orderBy("diagonal").rangeBetween(0, drift)
    lines = lines.withColumn("band", F.collect_list(F.struct("diagonal", "places")).over(band))
    at = F.flatten(F.transform("band", lambda b: F.transform(b["places"], lambda p: F.struct(p.alias("place"), (b["diagonal"] + p).alias("at")))))
    # verify the span: grams count where they follow all earlier ones in the text too, and words once
    start = F.struct(*[F.lit(-1).alias(c) for c in ("place", "at", "upto", "first")], F.lit(0).alias("covered"))

    def step(s: Column, v: Column) -> Column:
        good = (v["place"] > s["place"]) & (v["at"] > s["at"])
        more = v["place"] + F.col("n") - F.greatest(v["place"], s["upto"])
        kept = lambda new, old: F.when(good, new).otherwise(old)
        return F.struct(
            F.greatest(s["place"], v["place"]).alias("place"),
            kept(v["at"], s["at"]).alias("at"),
            kept(v["place"] + F.col("n"), s["upto"]).alias("upto"),
            F.when(s["first"] < 0, v["at"]).otherwise(s["first"]).alias("first"),
            kept(s["covered"] + more, s["covered"]).alias("covered"),
        )

    chain = F.aggregate(F.array_sort(at), start, step)
    lines = lines.withColumn("chain", F.when(~F.col("exact"), chain))
    return lines.select(
        *_ROW, "copies", "template", "label", "exact", "diagonal",
        (F.col("exact") & (F.size("places") == F.col("words") - F.col("n") + 1)).alias("full"),
        (F.col("chain.covered") / F.col("words")).alias("share"),
        F.col("chain.first").alias("begins"),
        (F.col("chain.at") + F.col("n") - 1).alias("ends"),
    )


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: Templates = BASE, passages: Templates = PASSAGES, k: int = 3, drift: int = 3, least: float = 0.6) -> DataFrame:
    """(doc_id, label, template, first_word, last_word, share): where in a text a license stands, words from 0. Of
    bands that overlap within ``drift`` diagonals, the best counts. Odd rows as in scan_licenses; rows that repeat an
    id and its text have their spans once."""
    rows = _bands(docs, id_col, text_col, base, passages, k, drift).where("template is not null")
    sizes = {no: len(_template_words(t)) for no, (t, _) in enumerate((*base, *passages))}
    size = F.element_at(F.create_map(*[x for no, n in sizes.items() for x in (F.lit(no), F.lit(n))]), F.col("template"))
    exact = rows.where("full").select("doc_id", "label", "template", F.col("diagonal").alias("first_word"), (F.col("diagonal") + size - 1).alias("last_word"), F.lit(1.0).alias("share"))
    near = Window.partitionBy(*_ROW, "template").orderBy("diagonal").rangeBetween(-drift, drift)
    good = rows.where(f"not exact and share >= {least}").withColumn("best", F.max(F.struct("share", -F.col("diagonal"))).over(near))
    good = good.where((F.col("best.share") == F.col("share")) & (F.col("best.col2") == -F.col("diagonal")))
    return exact.unionByName(good.select("doc_id", "label", "template", F.col("begins").alias("first_word"), F.col("ends").alias("last_word"), "share"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: Templates = BASE, passages: Templates = PASSAGES, k: int = 3, drift: int = 3, least: float = 0.6) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    All word grams of all texts (``k`` words, fewer for shorter templates) meet the templates' grams by hash, and the
    grams themselves are compared. Each meeting is a vote for the diagonal (place in the text less place in the
    template). A base phrase stands where its diagonal has all votes. For passages, the diagonals from one to
    ``drift`` further make a band, which bounds how far its words can be off, and its span is verified: grams that
    follow each other in the text as in the template must cover ``least`` of the template's words. ``score`` is the
    largest such share, 1 for a base phrase. Templates may have any length.

    Null texts have no words; repeated rows give repeated results; an empty table gives none. Other columns are
    not read. The templates are fixed and few, which bounds what is broadcast.
    """
    rows = _bands(docs, id_col, text_col, base, passages, k, drift)
    found = F.when(F.col("exact"), F.col("full")).otherwise(F.col("share") >= least)
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    place = F.when(F.col("full"), F.col("diagonal")).cast("bigint")
    out = rows.groupBy(*_ROW).agg(
        F.sum("copies").alias("copies"),
        F.count(F.when(F.col("full"), 1)).alias("n_base"),
        F.min(place).alias("first_word"),
        F.max(place).alias("last_word"),
        labels(F.col("full")).alias("base_labels"),
        labels(found).alias("labels"),
        F.coalesce(F.max(F.when(found, F.coalesce("share", F.lit(1.0)))), F.lit(0.0)).alias("score"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def oracle(base: Templates = BASE, passages: Templates = PASSAGES, k: int = 3, drift: int = 3, least: float = 0.6) -> str:
    """SQL for the rows of scan_licenses over ``documents``."""
    plain = lambda text: " ".join(_template_words(text))
    values = ", ".join(f"({no}, '{plain(text)}', '{label}', {str(no < len(base)).lower()})" for no, (text, label) in enumerate((*base, *passages)))
    return rf"""
WITH templates(template, phrase, label, exact) AS (VALUES {values}),
split AS (SELECT *, string_split(phrase, ' ') AS s, least({k}, len(string_split(phrase, ' '))) AS n FROM templates),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
spots AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM w),
grams AS (SELECT doc_id, i - 1 AS spot, n, array_to_string(l[i : i + n - 1], ' ') AS gram FROM spots, (SELECT DISTINCT n FROM split) WHERE i + n - 1 <= len(l)),
places AS (SELECT template, label, exact, n, len(s) AS words, i - 1 AS place, array_to_string(s[i : i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(s) - n + 2)) AS i FROM split)),
votes AS (SELECT doc_id, template, label, exact, p.n, words, place, spot - place AS diagonal FROM grams g JOIN places p ON p.gram = g.gram AND p.n = g.n),
exact_hits AS (SELECT doc_id, label, diagonal FROM votes WHERE exact GROUP BY doc_id, template, label, diagonal, words, n HAVING count(*) = words - n + 1),
anchors AS (SELECT DISTINCT doc_id, template, diagonal AS anchor FROM votes WHERE NOT exact),
band AS (SELECT v.doc_id, template, label, v.n, words, anchor, place, place + min(diagonal) AS stands FROM anchors a JOIN votes v USING (doc_id, template) WHERE diagonal BETWEEN anchor AND anchor + {drift} GROUP BY v.doc_id, template, label, v.n, words, anchor, place),
ordered AS (SELECT *, max(stands) OVER (PARTITION BY doc_id, template, anchor ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM band),
covered AS (SELECT DISTINCT doc_id, template, label, words, anchor, unnest(range(place, place + n)) AS word FROM ordered WHERE before IS NULL OR stands > before),
shares AS (SELECT doc_id, label, count(*) / words AS share FROM covered GROUP BY doc_id, template, label, words, anchor),
found AS (SELECT doc_id, label, share FROM shares WHERE share >= {least} UNION ALL SELECT doc_id, label, 1.0 FROM exact_hits),
base AS (SELECT doc_id, count(*)::BIGINT AS n_base, min(diagonal)::BIGINT AS first_word, max(diagonal)::BIGINT AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM exact_hits GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY doc_id)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id)
"""
