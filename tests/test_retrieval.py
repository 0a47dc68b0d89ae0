"""Search, fusion, index upkeep, symbols, ranks, sources and streams."""

import subprocess

import numpy as np
import pytest

from sievewright.functions import models, scores
from sievewright.operators import retrieval, symbols
from sievewright.operators.state import TABLES, IndexStore
from sievewright.plans import commands
from sievewright.plans.lineage import numbered, runs
from sievewright.sources import readers
from sievewright.streaming import event_stream, index_chunks, running_iterations
from pyspark.sql import functions as F

V = "chunk_id bigint, embedding array<float>"


def test_vector_search(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0]), (6, [])], V)
    q = spark.createDataFrame([(9, [0.9, 0.1, 0.0])], "query_id bigint, query_vector array<float>")
    got = retrieval.vector_search(rows, q, 10).orderBy("place").collect()
    assert [r.chunk_id for r in got] == [1, 2, 4, 5, 6] and got[2].score == 0.0
    assert retrieval.vector_search(rows, q, 0).count() == 0


def test_top_k_equals_full_sort(spark):
    rows = spark.range(20_000).select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0), F.col("id") * 0.001, F.lit(0.25)).cast("array<float>").alias("embedding"))
    q = spark.createDataFrame([(1, [1.0, 5.0, 0.5])], "query_id bigint, query_vector array<float>")
    got = [r.chunk_id for r in retrieval.vector_search(rows, q, 50).orderBy("place").collect()]
    x = np.stack([np.ones(20_000), np.arange(20_000) * 0.001, np.full(20_000, 0.25)], 1).astype(np.float32).astype(np.float64)
    s = (x @ [1, 5, 0.5]) / np.linalg.norm(x, axis=1) / np.linalg.norm([1, 5, 0.5])
    assert len(set(got) & set(np.lexsort((np.arange(20_000), -np.round(s, 15)))[:50].tolist())) >= 49


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(scores.cosine("a", "b")).collect()] == [1.0, 0.0, -1.0, 0.0, 0.0, 0.0]


def test_fusion(spark):
    rows = spark.createDataFrame([(1, "v", 1, 1), (1, "v", 2, 2), (1, "k", 2, 1), (1, "k", 3, 2)], "query_id bigint, source string, chunk_id bigint, place int")
    got = {r.chunk_id: r.score for r in retrieval.fuse(rows, "chunk_id").collect()}
    assert got == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 62})


def test_bm25(spark):
    rows = spark.createDataFrame([(1, "process_payment", "charge the card"), (2, "log_event", "write a line"), (3, None, None)], "chunk_id bigint, entity_name string, content string")
    post = retrieval.postings(rows, "chunk_id", "entity_name", "content")
    q = spark.createDataFrame([(1, "process_payment"), (2, "!!"), (3, None)], "query_id bigint, query_text string")
    got = retrieval.bm25(post, q, "chunk_id", 3).collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, 1)] and got[0].score > 0
    assert retrieval.bm25(post, q, "chunk_id").count() == 1


def test_width_guard(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0])], V)
    with pytest.raises(Exception, match="re-index"):
        retrieval.check_width(rows, 3).collect()
    assert retrieval.check_width(rows, 2).count() == 1


def test_classify(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "path string, hash string")
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "4")], "path string, hash string")
    assert {r.path: r.state for r in retrieval.classify(a, b).collect()} == {"x": "unchanged", "y": "changed", "z": "new", "w": "deleted"}


def test_index_round(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "i"))
    files = spark.createDataFrame([("a.py", "def pay():\n    return charge()\n"), ("b.py", "class Log:\n    def write(self):\n        pass\n")], "path string, content string")
    commands.build_index(store, files, models.hash_embedding, 64)
    assert store.read("chunks").count() == 3 and store.read("files").count() == 2
    q = spark.createDataFrame([(1, "pay")], "query_id bigint, query_text string")
    assert commands.search(store, q, models.hash_embedding, 2).orderBy("place").first().file_path == "a.py"
    newer = spark.createDataFrame([("a.py", "def pay():\n    return charge()\n"), ("c.py", "def new():\n    pass\n")], "path string, content string")
    states = {r.path: r.state for r in commands.update_index(store, newer, models.hash_embedding, 64).collect()}
    assert states == {"a.py": "unchanged", "b.py": "deleted", "c.py": "new"}
    assert {r.file_path for r in store.read("chunks").collect()} == {"a.py", "c.py"}


RUST = """pub fn top_level(x: i64) -> i64 { helper(x) }
struct Config { a: i64 }
pub enum Color { Red }
impl Config {
    pub fn new() -> Self { Config { a: 1 } }
    fn value(&self) -> i64 { "fn fake() {" ; self.a }
}
fn helper(x: i64) -> i64 { x }
"""


def names(source, language):
    return {(r["name"], r["kind"]) for r in symbols.symbols_of(source, language)}


def test_symbols():
    assert names(RUST, "rust") == {("top_level", "Function"), ("Config", "Struct"), ("Color", "Enum"), ("Config", "Impl"), ("new", "Method"), ("value", "Method"), ("helper", "Function")}
    assert names("class A:\n    def m(self):\n        pass\n\ndef f(a: int):\n    pass\n", "python") == {("A", "Class"), ("m", "Method"), ("f", "Function")}
    assert names("def broken(:\n    pass\nclass B:\n", "python") == {("broken", "Function"), ("B", "Class")}
    assert names("export class A {\n  go(x: number): void {\n  }\n}\ninterface I { a: string }\nexport const f = (x: number) => x;\nfunction g() {}\nenum E { A }\n", "typescript") == {("A", "Class"), ("go", "Method"), ("I", "Interface"), ("f", "Function"), ("g", "Function"), ("E", "Enum")}
    assert names("public class A {\n  public int run(int x) {\n    return x;\n  }\n}\ninterface B { }\nenum C { X }\n", "java") == {("A", "Class"), ("run", "Method"), ("B", "Interface"), ("C", "Enum")}
    assert names("package x\n\ntype S struct {\n}\ntype I interface {\n}\nfunc (s *S) M() {\n}\nfunc F() {\n}\n", "go") == {("S", "Struct"), ("I", "Interface"), ("M", "Method"), ("F", "Function")}
    assert names("static long f(long a) {\n  return a;\n}\nstruct P {\n  int x;\n};\nint decl(int x);\n", "c") == {("f", "Function"), ("P", "Struct"), ("decl", "Function")}
    assert names("module M\n  class A\n    def go\n    end\n  end\nend\n", "ruby") == {("M", "Module"), ("A", "Class"), ("go", "Method")}
    assert ("f", "Function") in names("<?php\nfunction f($x) { return $x; }\n", "php") and ("A", "Class") in names("class A {\n fun g() {}\n}\n", "kotlin") and ("P", "Interface") in names("protocol P { }\n", "swift")
    assert symbols.symbols_of("x", "cobol") == []


def test_references():
    found = symbols.symbols_of(RUST, "rust")
    uses = {(r["from_symbol"], r["to_name"]) for r in symbols.refs_of(RUST, "rust", found)}
    assert ("top_level", "helper") in uses and not any(t == "fake" for _, t in uses)


def chain(spark, edges, n):
    nodes = spark.createDataFrame([(i,) for i in range(n)], "sym_id bigint")
    return {r.sym_id: r.rank for r in symbols.pagerank(nodes, spark.createDataFrame(edges, "from_id bigint, to_id bigint, m bigint")).collect()}


def test_pagerank(spark):
    assert chain(spark, [(0, 1, 1), (1, 2, 1)], 3) == pytest.approx({0: 0.05, 1: 0.0925, 2: 0.128625})
    flat = chain(spark, [], 3)
    assert list(flat.values()) == pytest.approx([0.05] * 3)
    want = np.full(3, 1 / 3)
    m = np.array([[0, 0.25, 0.75], [0.5, 0, 0.5], [0, 0, 0]])
    for _ in range(20):
        want = 0.05 + 0.85 * want @ m
    assert chain(spark, [(0, 1, 1), (0, 2, 3), (1, 0, 2), (1, 2, 2)], 3) == pytest.approx(dict(enumerate(want)))


def test_name_edges_and_map(spark):
    files = spark.createDataFrame([("a.rs", "fn a() { b(); b(); }\n"), ("b.rs", "fn b() { c(); }\n"), ("c.rs", "fn c() { }\nfn b() { }\n")], "path string, content string")
    ready = symbols.readable(files)
    found = symbols.identified(symbols.symbols(ready))
    edges = symbols.name_edges(found, symbols.references(ready)).collect()
    assert sorted(r.m for r in edges) == [1, 2]
    out = commands.make_map(files)
    assert out.startswith("├── a.rs\n│   └── fn fn a()") and "└── c.rs" in out
    assert commands.make_map(files, style="markdown").startswith("# Repository Map\n\n## `a.rs`\n\n- **fn** `fn a()`")
    first = commands.make_map(files, 2, ["a.rs"], None).collect()
    assert len(first) <= 2


@pytest.mark.parametrize("budget, n", [(100, 3), (0, 0), (30, 1), (90, 3)])
def test_budget(spark, budget, n):
    rows = spark.createDataFrame([(i, 30, 1.0 / (i + 1)) for i in range(5)], "sym_id bigint, token_cost bigint, order_rank double")
    assert symbols.fit_budget(rows, budget).count() == n


def test_repository_walk(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / ".hidden").mkdir()
    for name, data in {"src/a.rs": b"fn a() {}\n", "b.py": b"x = 1\n", "c.txt": b"t", "d.py": b"a\x00b", "e.go": b"\xff\xfe", ".hidden/f.py": b"y", "g.js": b"x" * 1_048_577, "h.ts": b""}.items():
        (root / name).write_bytes(data)
    got = {r.path: r.language for r in readers.repository_files(spark, str(root), ["b.py"]).collect()}
    assert got == {"src/a.rs": "rust"}


def test_git_history(spark, tmp_path):
    root = str(tmp_path / "g")
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    subprocess.run(["git", "init", "-q", root], check=True)
    p = tmp_path / "g" / "a.py"
    p.write_text("1\n2\n3\n4\n5\n")
    git("add", ".")
    git("commit", "-qm", "first\n\nbody")
    p.write_text("1\n2\n3\n4\n5\n6\n")
    git("mv", "a.py", "b.py")
    git("commit", "-qam", "second")
    readers.register(spark)
    rows = {r.path: r for r in spark.read.format("git_history").option("path", root).load().collect()}
    assert rows["a.py"].status == "Added" and rows["a.py"].lines_added == 5 and rows["a.py"].message == "first" and rows["a.py"].author == "n"
    assert rows["b.py"].status == "Renamed" and rows["b.py"].renamed_from == "a.py" and rows["b.py"].lines_added == 1
    with pytest.raises(Exception):
        spark.read.format("pull_request").option("ref", "o/n#1").load().collect()
    assert "+6" in readers.git_diff(spark, root, "HEAD").first().text


def test_streams(spark, tmp_path):
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev" / "1.json").write_text('{"timestamp":"2026-01-01T00:00:00Z","commit":"a","comment_count":1}\n{"timestamp":"2026-01-01T00:05:00Z","commit":"a","comment_count":2}\n')
    q = running_iterations(event_stream(spark, str(tmp_path / "ev"))).writeStream.outputMode("complete").format("memory").queryName("iters").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("iters").first().iteration_count == 2
    src = tmp_path / "chunks"
    row = (1, "a", 1, 2, "e", "function", "python", "c", "h", "hash", [1.0])
    spark.createDataFrame([row], TABLES["chunks"]).write.parquet(str(src))
    stream = spark.readStream.schema(TABLES["chunks"]).parquet(str(src))
    index_chunks(stream, str(tmp_path / "i"), str(tmp_path / "ck")).awaitTermination()
    assert IndexStore(spark, str(tmp_path / "i")).read("chunks").count() == 1


def test_numbering_and_runs(spark):
    rows = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.col("id").alias("o"), F.floor(F.col("id") / 50).alias("v"))
    got = numbered(rows, ["k"], [F.col("o")]).collect()
    for k in (0, 1):
        assert [r.place for r in sorted((r for r in got if r.k == k), key=lambda r: r.o)] == list(range(1, 1 + sum(r.k == k for r in got)))
    hot = runs(rows, ["k"], [F.col("o")], "v")
    assert hot.groupBy("k").agg(F.countDistinct("run").alias("n")).where("n <> 20").count() == 0
