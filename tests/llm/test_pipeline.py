"""The pipeline's stages against plain Python and their operators, and on odd rows."""

import collections

import pytest

import corpus_pipeline
from lodestone.llm import mixing, quality_classifier
from test_llm_operators import brute_links, brute_rules, check_packing

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows over what the one before it kept, written and read as run() does."""
    docs, out, folder = spark.read.parquet(f"{SF}/documents.parquet"), {}, tmp_path_factory.mktemp("stages")
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = out[name] = spark.read.parquet(str(folder / name))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_rejected_documents_go(spark, stages):
    docs = stages["documents"]
    model = quality_classifier.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = ids(quality_classifier.score_quality(docs, model).where("kept"))
    assert ids(stages["quality_classifier"]) == good and 0 < len(good) < docs.count()
    want = []
    for r in stages["quality_classifier"].collect():
        n, chars, symbols, dup, repeated = brute_rules(r.text)
        lines = sum(1 for x in (r.text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r"))
        upper, lower = (sum(a <= c <= b for c in r.text) for a, b in (("A", "Z"), ("a", "z")))
        if n >= 50 and 100 * repeated <= 50 * n and 10 * symbols <= n and 2 * dup <= lines and upper <= lower and 2 * n <= chars <= 20 * n:
            want.append(r.doc_id)
    assert ids(stages["quality_rules"]) == sorted(want)


def test_one_document_of_each_group_stays(stages):
    rows = sorted(stages["quality_rules"].collect(), key=lambda r: r.doc_id)
    _, roots = brute_links([r.text for r in rows])
    assert ids(stages["ngram_jaccard"]) == sorted({rows[k].doc_id for k in roots})


def test_mixed_rows_come_as_often_as_the_mix_takes_them(stages):
    before, mixed = stages["ngram_jaccard"], stages["source_mixing"]
    taken = {r.doc_id: r for r in mixing.mix_documents(before).collect()}
    times = collections.Counter(r.doc_id for r in mixed.collect())
    assert times == +collections.Counter({d: int(r.taken / max(1, r.size) + 0.5) for d, r in taken.items()})
    assert mixed.columns == before.columns
    texts = {r.doc_id: tuple(r) for r in before.collect()}
    assert all(tuple(r) == texts[r.doc_id] for r in mixed.collect())


def test_pieces_are_those_of_the_mixed_rows(spark, stages):
    used, total = check_packing(stages["best_fit_packing"].collect(), [(r.doc_id, r.text) for r in stages["source_mixing"].collect()])
    assert used <= 1.03 * -(-total // 2048)
    columns = "doc_id, piece, start, length, ids_crc32, sequence_id, offset".split(", ")
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(columns).collect())) == sorted(map(tuple, stages["best_fit_packing"].select(columns).collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, odd_documents, no_documents, name):
    clashing = odd_documents
    for c in ("__n", "__row", "__h1", "__slots", "h1", "h2", "row", "stays", "maybe", "__slot", "__copy"):
        clashing = clashing.selectExpr("*", f"'x' as {c}")
    got = STAGE[name](spark, clashing, SF)
    rows = got.collect()
    if name == "best_fit_packing":
        assert {r.doc_id for r in rows} == {None, *range(1, 8)}
    else:
        assert got.columns == clashing.columns and set(map(str, rows)) <= set(map(str, clashing.collect()))
    empty = clashing.limit(0)
    assert STAGE[name](spark, empty, SF).count() == 0
    if name == "ngram_jaccard":
        assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 2, 4, 6, 7]
