"""Queries without SQL, each against plain Python over the same tables."""

import collections
import hashlib
import math
import re

import pytest

from lodestone.functions import hooks
from lodestone.functions.chunking import chunk_markdown, sections_of
from lodestone.plans import corpus_queries
from lodestone.plans import queries as _registered  # noqa: F401
from lodestone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: registry.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def estimate(text):
    return math.ceil(len(text) / 3.2)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_chunks_of_whole_documents(spark, run):
    texts = {r.doc_id: r.text for r in corpus_queries.headed(spark, SF).collect()}
    want = {d: list(chunk_markdown(t)) for d, t in texts.items()}
    got = collections.defaultdict(list)
    for r in sorted(run("win04_chunk_sections"), key=lambda r: (r.doc_id, r.section_no, r.k)):
        got[r.doc_id].append((r.heading_path, r.text, r.tokens))
    assert got == {d: c for d, c in want.items() if c}
    numbered = {(r.doc_id, r.chunk_index): (r.chunk_id, r.tokens) for r in run("win05_number_chunks")}
    assert numbered == {(d, n): (f"{d}#{n}", c[2]) for d, chunks in want.items() for n, c in enumerate(chunks)}
    by_sql = {(r.doc_id, r.chunk_index): (r.heading_path, r.digest, r.tokens) for r in run("udf06_chunk_text")}
    assert by_sql == {(d, n): (c[0], md5(c[1]), c[2]) for d, chunks in want.items() for n, c in enumerate(chunks)}
    labelled = [r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert {r.doc_id: r.chunk_count for r in run("agg04_chunks_per_document")} == {d: len(want[d]) for d in labelled if want.get(d)}
    for d, chunks in want.items():
        # no chunk beyond the limit but for one long sentence with what it carries on; all words, in order
        plain = " ".join(body for _, body in sections_of(texts[d])).split()
        words = [c[1].split() for c in chunks]
        assert set(plain) == {w for c in words for w in c}


def brute_batches(items):
    batch, used, n, out = 0, 0, 0, {}
    for ord_, tokens in sorted(items):
        if n and (used + tokens > 15_000 or n >= 50):
            batch, used, n = batch + 1, 0, 0
        used, n = used + tokens, n + 1
        out[ord_] = batch
    return out


def test_folds(run, documents):
    shards = collections.defaultdict(list)
    for r in documents.values():
        shards[f"{r.source}-{r.doc_id % 1024}"].append((r.doc_id, estimate(r.text)))
    want = {k: v for items in shards.values() for k, v in brute_batches(items).items()}
    assert {r.ord: r.batch for r in run("win09_pack_batches")} == want
    groups = collections.defaultdict(list)
    for r in documents.values():
        groups[f"{r.source}-{r.doc_id // 1000}"].append(r)
    fates, shown = {}, {}
    for rows in groups.values():
        used = outlined = 0
        for r in sorted(rows, key=lambda r: (r.doc_id % 3, f"doc-{r.doc_id}")):
            n, outline = estimate(r.text), math.ceil(estimate(r.text) / 10) if r.doc_id % 2 == 0 else None
            if n <= 3600 and used + n <= 8000:
                fate, used = "included", used + n
            elif outline is not None and outlined + outline <= 1200:
                fate, outlined = "outline", outlined + outline
            else:
                fate = "omitted"
            fates[f"doc-{r.doc_id}"] = fate
        used = 0
        for r in sorted(rows, key=lambda r: r.doc_id):
            shown[r.doc_id] = used + estimate(r.text) <= 8000
            used += estimate(r.text) if shown[r.doc_id] else 0
    assert {r.path: r.fate for r in run("win10_fit_to_budget")} == fates
    assert {r.ord: r.included for r in run("win11_fill_prompt")} == shown


def fence(text):
    longest = max([2, *map(len, re.findall("`{3,}", text))])
    return "`" * (longest + 1)


def test_coding_prompts(spark, run):
    parts = spark.read.parquet(f"{SF}/part.parquet").collect()
    projects = collections.defaultdict(list)
    for r in parts:
        d, k = r.p_brand.replace("#", ""), r.p_partkey
        content = f"import x from './p{k + 1}'\nimport fs from \"node:fs\"\n\nexport function f{k}(a: number): string {{\n  return '{r.p_name}'\n}}\nexport const c{k} = 1;\n"
        projects[d].append((k, f"{d}/.env.{k}" if k % 11 == 3 else f"{d}/p{k}.ts", content if k % 13 != 5 else None))
    got = {r.project: r for r in run("asm03_coding_prompt")}
    assert set(got) == set(projects)
    for d, rows in projects.items():
        used, files, skipped, sensitive = 0, [], [], []
        for _, path, content in sorted(x for x in rows if x[2] is not None):
            if used + estimate(content) > 2000:
                skipped.append(path)
                continue
            used += estimate(content)
            language = "typescript" if path.endswith(".ts") else "text"
            files.append((path, f"File: {path}\n{fence(content)}{language}\n{content}\n{fence(content)}"))
            if "/.env" in path:
                sensitive.append(path)
        tree = "└── " + d + "".join(f"\n    {'└' if i == len(rows) - 1 else '├'}── {p.split('/')[1]}" for i, p in enumerate(sorted(p for _, p, _ in rows)))
        assert got[d].prompt == tree + "\n\n" + "\n\n".join(t for _, t in sorted(files)) + "\n\nAnswer with whole files."
        assert (got[d].skipped, got[d].sensitive, got[d].unreadable) == (sorted(skipped), sorted(sensitive), sorted(p for _, p, c in rows if c is None))


def test_turn_prompts(spark, run, documents):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    fates = {r.path: r.fate for r in run("win10_fit_to_budget")}
    groups = collections.defaultdict(list)
    for r in documents.values():
        groups[f"{r.source}-{r.doc_id // 1000}"].append(r)
    got = {r.session_id: r for r in run("asm06_turn_prompt")}
    assert set(got) == set(groups)
    block = lambda t: f"{fence(t)}\n{t}\n{fence(t)}"
    for name, rows in groups.items():
        rows = sorted(rows, key=lambda r: f"doc-{r.doc_id}")
        first = min(r.doc_id for r in rows)
        poor = sorted(r.doc_id for r in rows if r.doc_id in labels and labels[r.doc_id].quality == 0)
        toxic = any(r.doc_id in labels and labels[r.doc_id].toxic == 1 for r in rows)
        of = lambda fate: [r for r in rows if fates[f"doc-{r.doc_id}"] == fate]  # noqa: B023, E731
        n = lambda r: len(r.text.split("\n"))
        failed = ["lint"] * bool(poor) + ["test"] * toxic
        lint = "lint (`run lint`) — " + ("FAILED\n" + "\n".join(f"- doc-{d}:{d}: poor" for d in poor[:25]) if poor else "PASSED")
        test = "test (`run tests`) — " + ("FAILED\n" + "\n".join(f"line {i}" for i in range(21, 61)) if toxic else "PASSED")
        since = [f"- applied: doc-{first}"] * (first % 3 == 0) + [f"- verification: {', '.join(failed)} FAILED" if failed else "- verification: all stages passed"]
        parts = [
            f"# Coding session — turn {first % 7 + 1}",
            f"## Task\n\nsummarise {name}",
            "## Plan\n\n[x] 1. read\n[>] 2. write\n[!] 3. check\n[ ] 4. send",
            "## Project facts\n\n- plain words\n- short" if first % 2 == 0 else "",
            "## Since the last turn\n\n" + "\n".join(since),
            "## Files — current on-disk content\n\n" + "\n\n".join(f"### doc-{r.doc_id} · {n(r)} lines · sha {hashlib.sha1(r.text.encode()).hexdigest()[:8]}\n\n{block(r.text)}" for r in of("included")) if of("included") else "",
            "## File outlines — signatures only\n\n" + "\n\n".join(f"### doc-{r.doc_id}\n\n{block(r.text.split(chr(10))[0])}" for r in of("outline")) if of("outline") else "",
            "## Not shown — request with ===Need===\n\n" + "\n".join(f"- doc-{r.doc_id} ({n(r)} lines)" for r in of("omitted")) if of("omitted") else "",
            "## Verification output\n\n" + block(f"{lint}\n\n{test}"),
            "## Your next action\n\nTake the smallest step that advances the plan; ask for a file that is not shown with ===Need===.",
            "Answer with whole files.",
            f"## Turn reference\n\nn-{first}",
        ]
        want = "\n\n".join(p for p in parts if p)
        assert got[name].prompt == want and got[name].tokens == estimate(want)
        assert got[name].omitted == [f"doc-{r.doc_id}" for r in of("omitted")]


def test_hooks(spark, run, documents):
    embed = hooks.hashing_embedder()
    widths = {r.chunk_id: (r.width, r.norm) for r in run("udf01_embedder")}
    assert widths == {d: (64, round(float((embed([r.text])[0] ** 2).sum()), 6)) for d, r in documents.items()}
    parts = spark.read.parquet(f"{SF}/part.parquet").collect()
    groups = collections.defaultdict(list)
    for r in parts:
        groups[r.p_brand, r.p_partkey // 5000].append((float(r.p_retailprice), r.p_partkey))
    for r in run("udf03_scorer"):
        own = groups[r.query_id, next(k // 5000 for k in [r.path])]
        price = next(p for p, k in own if k == r.path)
        share = (1 + sum(p < price for p, _ in own)) / len(own)
        assert abs(r.confidence - share) < 1e-9 and r.score == min(3, math.floor(share * 4))
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}

    def plain(html):
        body = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", html or "")
        return re.sub(r"[ \t\r\n]+", " ", re.sub(r"(?s)<[^>]*>", " ", body)).strip(" ")

    assert {r.page_id: (r.ok, r.markdown) for r in run("udf04_extractor")} == {k: (bool(plain(h)), plain(h) or None) for k, h in pages.items()}
    table = spark.read.parquet(f"{SF}/pages.parquet")
    own = hooks.extract_texts(table, extractor=lambda texts: [ValueError("odd") if len(t) % 2 else t.upper() for t in texts]).collect()
    assert all((r.ok, r.reason) == ((False, "odd") if len(pages[r.page_id]) % 2 else (True, None)) for r in own) and len(own) == len(pages)
    with pytest.raises(Exception, match="gave 0 texts"):
        hooks.extract_texts(table, extractor=lambda texts: []).collect()
