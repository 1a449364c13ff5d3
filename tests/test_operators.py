"""Small fixtures for what the tables don't show."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import hooks
from lodestone.functions import paths as P
from lodestone.functions import text as T
from lodestone.operators import assembly, changes, corpus, extract, ranking, search, sessions, vectors
from lodestone.plans import queries as _registered  # noqa: F401
from lodestone.plans import registry
from lodestone.sources import files
from lodestone.streaming import jobs


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_tokenize_and_stem(spark):
    assert column(spark, ["parseSuggestedFiles of webchat, HTTPServer x"], T.tokenize) == [["parsesuggestedfiles", "of", "webchat", "httpserver", "parse", "suggested", "files", "http", "server", "web", "chat"]]
    words = ["checking", "buttons", "classes", "running", "agreed", "created", "status", "this", "bigger", "cat"]
    assert column(spark, words, T.stem) == ["check", "button", "class", "run", "agree", "create", "status", "this", "big", "cat"]


def test_heading_paths_and_fences(spark):
    text = "# Paper\nintro\n## 3 Method\nbody\n### 3.2 Data\nmore\n```python\n# not a heading\n```\n## Four\nend"
    docs = spark.createDataFrame([(1, text), (2, "## A\none\n### A.1\ntwo\n## B\nthree"), (3, None)], "doc_id int, text string")
    got = [(r.doc_id, r.heading_path) for r in corpus.sections(corpus.doc_lines(docs)).orderBy("doc_id", "section_no").collect()]
    assert got == [(1, "Paper"), (1, "Paper > 3 Method"), (1, "Paper > 3 Method > 3.2 Data"), (1, "Paper > Four"), (2, "A"), (2, "A > A.1"), (2, "B")]


def test_chunks_overlap_and_cover(spark):
    ranges = corpus.chunk_ranges([30] * 20, 100, 30)
    assert ranges[0] == {"start": 0, "stop": 3, "tokens": 90} and ranges[1]["start"] == 2 and ranges[-1]["stop"] == 20
    assert all(a["stop"] >= b["start"] for a, b in zip(ranges, ranges[1:], strict=False))
    assert corpus.chunk_ranges([500], 100, 30) == [{"start": 0, "stop": 1, "tokens": 500}] and corpus.chunk_ranges([], 100, 30) == []


def test_packing_folds_keep_their_limits(spark):
    items = spark.createDataFrame([(0, i, t) for i, t in enumerate([9000, 7000, 20000, 100] + [1] * 60)], "shard int, ord bigint, tokens bigint")
    got = sessions.pack_batches(items).orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(64))
    assert [r.batch for r in got[:4]] == [0, 1, 2, 3]
    per = {}
    for r in got:
        per.setdefault(r.batch, []).append(r.tokens)
    assert all(len(v) <= 50 and (sum(v) <= 15000 or len(v) == 1) for v in per.values())
    many = spark.createDataFrame([(0, 0, "a", 100, None), (0, 1, "b", 100, None), (0, 1, "c", 100, 30), (0, 2, "d", 40, None)], "query_id int, priority int, path string, tokens bigint, outline_tokens bigint")
    assert {r.path: r.fate for r in sessions.fit_to_budget(many, 250).collect()} == {"a": "included", "b": "included", "c": "outline", "d": "included"}
    given = spark.createDataFrame([(0, i, t) for i, t in enumerate([5, 9, 3, 4])], "query_id int, ord bigint, tokens bigint")
    assert [r.included for r in sessions.fill_prompt(given, 10).orderBy("ord").collect()] == [True, False, True, False]


def test_filter_comes_before_the_cut(spark):
    rows = [(i, "out", [1.0, 0.0]) for i in range(30)] + [(99, "in", [0.6, 0.8]), (98, "in", None), (97, "in", [0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id int, document string, embedding array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0, 0.0])], "query_id int, embedding array<double>")
    top = vectors.nearest(chunks, queries, 5, F.col("document") == "in")
    assert [(r.query_id, r.chunk_id, round(r.score, 6)) for r in top.orderBy("rank").collect()] == [(0, 99, 0.6), (0, 97, 0.0)]
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("MapInPandas") < plan.index("Filter (isnotnull(document")


def test_blocks_of_vectors_give_what_all_pairs_give(spark):
    rng = random.Random(7)
    rows = [(i, i % 5, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(90)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document int, embedding array<float>").repartition(3)
    asked = chunks.where("chunk_id % 9 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    norm = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
    every = {(q, c): sum(a * b for a, b in zip(v, w, strict=True)) / norm(v) / norm(w) for q, _, v in rows if q % 9 == 0 for c, _, w in rows}
    got = {(r.query_id, r.chunk_id): r.score for r in vectors.cosine_scores(chunks, asked, block=7).collect()}
    assert got.keys() == every.keys() and all(abs(got[k] - every[k]) < 1e-12 for k in got)
    some = {(r.query_id, r.chunk_id) for r in vectors.cosine_scores(chunks, asked, least=0.5, block=7).collect()}
    assert some == {k for k, v in got.items() if v >= 0.5}
    best = vectors.vector_topk(vectors.cosine_scores(chunks, asked, most=4, block=7), 4).collect()
    for q in {q for q, _ in every}:
        want = sorted((-got[q, c], c) for c in range(90))[:4]
        assert sorted((-r.score, r.chunk_id) for r in best if r.query_id == q) == want
    with pytest.raises(ValueError):
        vectors.retrieve(chunks, asked, asked, 51)


def test_diversify_equals_the_greedy_choice(spark):
    rows = [("a/1", 10.0), ("a/2", 9.0), ("a/3", 8.0), ("b/1", 5.0), ("c/1", 4.5)]
    picked, pool, seen = [], dict(rows), {}
    while pool:
        best = max(pool, key=lambda p: pool[p] * 0.7 ** seen.get(p[0], 0))
        seen[best[0]] = seen.get(best[0], 0) + 1
        picked.append(best)
        del pool[best]
    df = spark.createDataFrame([(0, *r) for r in rows], "query_id int, path string, score double")
    got = search.diversify(df, F.regexp_replace("path", "/[^/]*$", "")).orderBy("rank").collect()
    assert [r.path for r in got] == picked


def test_answers_of_every_shape(spark):
    answers = {
        1: "## File: src/a.ts\n\n````ts\nlet x\n```\nstill\n````\nFile: b.py\n~~~\n# b.py\npass",
        2: "===Files===\nFile: a.ts\n<<<<<<< SEARCH\none\n=======\ntwo\n>>>>>>> REPLACE\n<<<<<<< SEARCH\n=======\nno\n>>>>>>> REPLACE\n======\n===Explanation===\nwhy",
        3: "Delete: old.ts\n```\nDelete: inside.ts\n```",
        4: "nothing here",
        5: "",
    }
    df = spark.createDataFrame(list(answers.items()), "response_id int, text string")
    got = {(r.response_id, r.strategy, r.kind, r.path, r.content, r.truncated) for r in extract.parse_changes(df).collect()}
    assert got == {
        (1, "markdown", "full", "src/a.ts", "let x\n```\nstill", False),
        (1, "markdown", "full", "b.py", "# b.py\npass", True),
        (2, "patch", "patch", "a.ts", '[{"search":"one","replace":"two"}]', False),
        (3, "delete", "delete", "old.ts", None, False),
    }


def test_failures_of_every_tool(spark):
    log = "src/a.ts(12,5): error TS2322: bad\n/r/a.ts:3:9  error  unused  rule\nFAIL src/a.test.ts > suite > case\nFAILED tests/t.py::test_x - boom\nall fine\nsrc/a.ts(12,5): error TS2322: bad"
    got = extract.parse_failures(spark.createDataFrame([(1, log)], "log_id int, text string")).orderBy("line_no").collect()
    assert [(r.file, r.line, r.test, r.message) for r in got] == [("src/a.ts", 12, None, "TS2322: bad"), ("/r/a.ts", 3, None, "unused  rule (error)"), ("src/a.test.ts", None, "suite > case", "src/a.test.ts > suite > case"), ("tests/t.py", None, "test_x", "boom")]


def test_patches_change_whole_lines_and_nothing_else(spark):
    cases = [
        ("a  \nb\nc", [("a\nb", "X")], "X\nc"),
        ("a\nb", [("zz", "X")], None),
        ("aa", [("a", "b"), ("ba", "c")], "c"),
        ("keep  \na  \nb", [("a\nb", "X")], "keep  \nX"),
        ("xa  \nb", [("a\nb", "X")], None),
        ("one\r\ntwo \r\nthree\r\n", [("two", "2")], "one\r\n2 \r\nthree\r\n"),
        ("one\r\ntwo \r\nthree\r\n", [("one\ntwo", "X")], "X\r\nthree\r\n"),
        ("a\n\t\nb\n", [("a\n\nb", "X")], "X\n"),
        ("a \nb\na \nb", [("a\nb", "X")], "X\na \nb"),
        ("a", [("a\nb", "X")], None),
    ]
    df = spark.createDataFrame([(t, p) for t, p, _ in cases], "t string, p array<struct<search:string,replace:string>>")
    assert [r[0] for r in df.select(changes.apply_patches(F.col("t"), F.col("p"))).collect()] == [w for _, _, w in cases]


def test_apply_statuses(spark):
    files = spark.createDataFrame([("same", "x"), ("long", "\n".join("l" * 50)), ("gone", "x")], "path string, content string")
    rows = [(1, "new", "full", "n"), (1, "same", "full", "x"), (2, "long", "full", "x"), (2, "new2", "full", "n"), (3, "gone", "delete", None), (3, "missing", "patch", None), (4, "../up", "full", "x")]
    todo = spark.createDataFrame([(*r, [("q", "r")] if r[2] == "patch" else None) for r in rows], "batch_id int, path string, kind string, content string, patches array<struct<search:string,replace:string>>")
    once = {r.path: r.status for r in changes.apply_changes(files, todo).collect()}
    assert once == {"new": "created", "same": "skipped", "long": "failed", "new2": "created", "gone": "deleted", "missing": "failed", "../up": "failed"}
    atomic = {r.path: r.status for r in changes.apply_changes(files, todo, True).collect()}
    assert atomic["new2"] == "skipped" and atomic["gone"] == "skipped" and atomic["new"] == "created"


def test_classification_and_secrets(spark):
    names = ["logo.png", "app.min.js", "package-lock.json", "src/app.ts", "tsconfig.json", "README.md", "data.unknownext", ".env"]
    assert column(spark, names, P.classify_file) == ["asset", "asset", "data", "code", "config", "doc", "config", "config"]
    assert column(spark, [".env", ".env.example", "id_rsa", "a.pem", "a.ts"], P.is_sensitive) == [True, False, True, True, False]


def test_every_binary_ending_is_an_asset(spark):
    assert len(P.BINARY) == len(set(P.BINARY)) == 62
    kinds = column(spark, [f"dir.d/file.x{e.upper() if i % 2 else e}" for i, e in enumerate(P.BINARY)], P.classify_file)
    assert set(kinds) == {"asset"}
    df = spark.createDataFrame([(f"f{e}", bytearray(b"plain")) for e in P.BINARY] + [("f.txt", bytearray(b"a\0")), ("g.txt", bytearray(b"a" * 1024 + b"\0")), ("h.txt", None)], "path string, content binary")
    assert sorted(r.path for r in files.binary_sniff(df).where("not is_binary").collect()) == ["g.txt"]


def test_scan_skips_folders_below_its_root_only(spark, tmp_path):
    root = tmp_path / "build" / "project"
    names = ["b.txt", "a.txt", "src/x.ts", "src/lib/y.ts", "node_modules/m.js", "src/bin/n.ts", ".cache/c.ts", "old.bak", "old.bak.2024T1", "bakery.txt", "logo.png", "coverage/r.txt"]
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text("text")
    for given in (str(root), f"file://{root}/"):
        found = files.scan_tree(spark, given).collect()
        assert [r.path.split("/project/")[1] for r in found] == ["coverage/r.txt", "src/lib/y.ts", "src/x.ts", "a.txt", "b.txt", "bakery.txt"]
    good, bad = files.read_text(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root / "src")), 3)
    assert good.count() == 0 and bad.count() == 3


def test_declarations_of_all_families(spark):
    rows = [
        ("a.ts", "import {\n  a,\n  b,\n} from './b'\nimport fs from \"node:fs\"\nexport const f = (a: {x: number}) => 1\nexport async function g<T extends {a: 1}>(\n  x: T,\n): Promise<T> {\n  return x\n}\nexport let v = 1;\nexport default class K extends L {\n}\nconst hidden = 1\n"),
        ("m.py", "import os.path\nfrom .x import y\nasync def f(a,\n  b) -> int:\n  pass\nclass C:\n  def inner(self): pass\n"),
        ("m.go", 'package m\nimport (\n\t"fmt"\n\tx "a/b"\n)\nfunc (s *S) Run(a int) error {\n}\nfunc main() {\n}\n'),
        ("m.rs", "pub fn run(a: u8) -> u8 {\n}\nstruct P;\nimpl P {\n}\n"),
        ("M.java", "public class M {\n}\n"),
        ("m.c", "struct p {\n};\nint main(void) {\n}\n"),
        ("m.rb", "class A\n  def run(x)\n  end\nend\n"),
        ("m.php", "function run() {\n}\n"),
        ("m.sh", "run() { echo\n}\n"),
        ("m.md", "export const no = 1"),
        ("n.ts", None),
    ]
    got = {r.path: r for r in extract.skeletons(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got["a.ts"].deps == ["./b", "node:fs"]
    assert got["a.ts"].signatures == ["export const f = (a: {x: number}) =>", "export async function g<T extends {a: 1}>( x: T, ): Promise<T>", "export let v = 1;", "export default class K extends L"]
    assert got["m.py"].deps == ["os.path", ".x"] and got["m.py"].signatures == ["async def f(a, b) -> int:"]
    assert got["m.go"].deps == ["fmt", "a/b"] and got["m.go"].signatures == ["func (s *S) Run(a int) error", "func main()"]
    assert got["m.rs"].signatures == ["pub fn run(a: u8) -> u8", "struct P", "impl P"]
    assert got["M.java"].signatures == ["public class M"] and "struct p" in got["m.c"].signatures and got["m.php"].signatures == ["function run()"]
    assert got["m.rb"].signatures == ["class A", "def run(x)"] and got["m.sh"].signatures == ["run() { echo"]
    assert got["m.md"].signatures == got["n.ts"].signatures == got["n.ts"].deps == []


def test_commands_with_and_without_fences(spark):
    texts = [
        "===Debug===\n```bash\n# note\n$ npm test\n\nnpm run lint\n```\ntext\n```\nls\n```\n======",
        "===Debug===\nRun these:\nnpm test\n$ npm run build\nThis should work\n// no\nYou can stop here\n======",
        "## Debug\nNone.",
        "no section",
        None,
    ]
    got = extract.debug_commands(spark.createDataFrame(list(enumerate(texts)), "response_id int, text string")).orderBy("response_id", "ord").collect()
    assert [(r.response_id, r.command) for r in got] == [(0, "npm test"), (0, "npm run lint"), (0, "ls"), (1, "npm test"), (1, "npm run build")]


def test_imports_of_json_files(spark):
    parsed = spark.createDataFrame([("src/a.ts", ["./data", "../b", "react"])], "path string, deps array<string>")
    known = spark.createDataFrame([("src/a.ts",), ("src/data.json",), ("b/index.ts",), ("src/data.py",)], "path string")
    assert {(r.src, r.dst) for r in extract.import_edges(parsed, known).collect()} == {("src/a.ts", "src/data.json"), ("src/data.json", "src/a.ts"), ("src/a.ts", "b/index.ts"), ("b/index.ts", "src/a.ts")}


def test_streamed_index_keeps_every_chunk(spark, tmp_path):
    asked = []

    def embed(chunks):
        asked.append(sorted(r.text for r in chunks.collect()))
        return hooks.embed_chunks(chunks)

    batches = [[("a", "one"), ("b", "one"), ("c", "two")], [("d", "two"), ("a", "one"), ("b", "three")], [("e", "one")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "chunk_id string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.stream_index(jobs.read_stream(spark, str(tmp_path / "in")), lambda b: b, embed, str(tmp_path / "index"))
        assert k > 0 or asked == [["one", "two"]]
    index = jobs.read_stream_index(spark, str(tmp_path / "index")).collect()
    assert sorted((r.chunk_id, r.text) for r in index) == [("a", "one"), ("b", "three"), ("c", "two"), ("d", "two"), ("e", "one")]
    assert len({(r.text, tuple(r.embedding)) for r in index}) == 3
    assert [a for a in asked if a] == [["one", "two"], ["three"]]


def test_commit_logs_keep_their_last_commits(spark):
    log = [f"__C__{c}" if k == 0 else f"dir\\f{k}" if k < 3 else " " for c in range(50) for k in range(4)]
    df = spark.createDataFrame([("p", i, x) for i, x in enumerate(log)] + [("q", 0, "lost"), ("q", 1, "__C__x"), ("q", 2, "f")], "project string, line_no int, line string").repartition(7)
    got = sorted((r.project, r.seq, r.commit, r.path) for r in files.read_commit_log(df).collect())
    assert got == sorted([("p", 49 - c, str(c), f"dir/f{k}") for c in range(10, 50) for k in (1, 2)] + [("q", 0, "x", "f")])
    assert files.read_commit_log(df, most=None).count() == 101


def test_verdicts_are_cleaned(spark):
    rows = [("2.5", "0.4"), ("[3]", "[0.9]"), ("-1", "2"), ("nan", None), ("x", "0.5"), ("1.49", " 1 ")]
    got = ranking.coerce_verdicts(spark.createDataFrame(rows, "score string, confidence string")).collect()
    assert [(r.score, r.confidence) for r in got] == [(3.0, 0.4), (3.0, 0.9), (0.0, 1.0), (0.0, 0.0), (0.0, 0.5), (1.0, 1.0)]


def test_failures_keep_long_test_names(spark):
    log = "FAIL a.test.ts > " + " > ".join(f"s{i}" for i in range(1500))
    got = extract.parse_failures(spark.createDataFrame([(1, log)], "log_id int, text string")).first()
    assert got.file == "a.test.ts" and got.test.endswith("s1499") and got.test.startswith("s0 > s1")


def test_tree_has_corners(spark):
    df = spark.createDataFrame([("p", "src/a.ts"), ("p", "src/lib/b.ts"), ("p", "z.md")], "project string, path string")
    assert assembly.tree_listing(df).first().listing.split("\n") == ["├── src", "│   ├── a.ts", "│   └── lib", "│       └── b.ts", "└── z.md"]


@pytest.mark.parametrize("text", ["", "no fence", "a ``` b", "a ````` b"])
def test_fence_is_longer_than_any_run(spark, text):
    fence = column(spark, [text], T.safe_fence)[0]
    assert len(fence) >= 3 and fence not in text


def test_abstracts_see_whole_texts(spark, tmp_path):
    """What follows 2000 characters counts: without it, the abstract would seem complete."""
    rows = [(k, "web", "en", "First words" + " " * 2500 + "and the last.") for k in (2, 3)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["fn05_extract_abstract"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.abstract for r in got} == {k: "Abstract words of web\nFirst words…" for k in (2, 3)}
