import re, sys
sys.path.insert(0, str(__import__("pathlib").Path(__file__).parents[1]))
import pytest
from pyspark.sql import SparkSession, functions as F
from corpusmill.functions import paths as P, patterns as R
from corpusmill.operators import index, search


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()


def test_should_index(spark):
    drop = ["a/node_modules/x.js", "Vendor/a.go", "src/TestData/a.py", ".hidden/a.py", "a/.b.py", "a/x.min.js", "a/x_pb2.py", "a/x.d.ts", "a/foo_test.go", "a/test_foo.py", "a/FooTests.cs", "a/BarTest.java", "a/__tests__/b.js", "a/smoke_tests/b.py", "x.core.test/b.java", "a/test-helpers/b.ts", "TestProjects/b.cs", "a/testFixtures/b.kt", "a/router-e2e/b.ts", "README.md", "Makefile", "a/b.unknown"]
    keep = ["src/latest.ts", "a/attest.rs", "src/main.py", "examples/a.go", "a/contest/b.py", "a/testkit/b.rs", "a/Latest.java"]
    rows = spark.createDataFrame([(p, 1000, p in keep) for p in drop + keep] + [("a.py", 63, False), ("a.py", 64, True), ("a.py", 204800, True), ("a.py", 204801, False), (None, 100, False), ("a.py", None, False)], "p string, n long, want boolean")
    bad = rows.where(P.should_index(F.col("p"), F.col("n")) != F.col("want")).collect()
    assert bad == []
    tests = spark.createDataFrame([("a/foo_test.go",), ("a/__tests__/b.js",), ("a/vendor/x.go",)], "p string")
    assert [r[0] for r in tests.select(P.should_index(F.col("p"), F.lit(100), True)).collect()] == [True, True, False]


def test_text_checks(spark):
    rows = [("plain", False), ("tag \U000E0041", True), ("bidi ‮", True), ("​" * 9, True), ("​" * 8, False), ("‍" * 200, False), ("שלום", False), (None, False), ("", False)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert df.where(P.has_hidden_text(F.col("t")) != F.col("want")).collect() == []
    df = spark.createDataFrame([("a\0", True), ("x" * 8192 + "\0", False), ("é" * 4096 + "\0", False), ("x", False), (None, False)], "t string, want boolean")
    assert df.where(P.is_binary(F.col("t")) != F.col("want")).collect() == []


@pytest.mark.parametrize("glob, path, want", [("src/**", "src/a/b.py", True), ("src/**", "src", True), ("src/**", "srcx/a", False), ("**/a.py", "a.py", True), ("**/a.py", "x/y/a.py", True), ("**/a.py", "xa.py", False), ("a?c", "abc", True), ("a?c", "ac", False), ("*.rs", "x/y.rs", True), ("a[b].c", "a[b].c", True), ("a[b].c", "ab.c", False), ("é*", "éa", True), ("a+b", "a+b", True), ("a.b", "axb", False)])
def test_globs(spark, glob, path, want):
    assert bool(re.search(P.glob_regex(glob), path)) == want
    assert spark.createDataFrame([(path,)], "p string").where(P.matches_glob(F.col("p"), glob)).count() == want


def test_path_filter():
    assert P.path_filter(" /src/ ") == "src/**" and P.path_filter("*.py") == "*.py"
    for bad in ("", " / ", "**/" * 5 + "a"):
        with pytest.raises(ValueError):
            P.path_filter(bad)


def test_names(spark):
    df = spark.createDataFrame([("sandboxFilesDist", "sandbox files dist", "dist"), ("test-helpers", "test helpers", "test"), ("workbench", "workbench", None), ("HTTPServer2Demo", "httpserver2 demo", "demo"), ("__x__", "x", None)], "s string, w string, k string")
    assert df.where((F.array_join(P.words(F.col("s")), " ") != F.col("w")) | ~P.suspect_word(F.col("s")).eqNullSafe(F.col("k"))).collect() == []
    df = spark.createDataFrame([("x/A.PY", "python"), ("a.tar.gz", None), ("Makefile", None), (None, None)], "p string, w string")
    assert df.where(~P.language_of(F.col("p")).eqNullSafe(F.col("w"))).collect() == []


@pytest.mark.parametrize("pattern, runs", [("foobar", ["foobar"]), ("foo.*bar", ["foo", "bar"]), ("ab", []), (r"retry_\w+Policy", ["retry_", "Policy"]), ("colou?rful", ["colo", "rful"]), ("(abc|def)ghi", ["ghi"]), ("[abc]defg", ["defg"]), (r"a\.b\(c", ["a.b(c"]), ("abcd{2}e", ["abc"]), ("xyz+", ["xyz"]), ("^start$", ["start"])])
def test_literals(pattern, runs):
    assert R.literal_runs(pattern) == runs


def test_patterns():
    assert R.alternatives("a|b(c|d)|[|]e") == ["a", "b(c|d)", "[|]e"]
    assert R.needs_line_break(r"a\nb") and not R.needs_line_break(r"a\nb|c") and not R.needs_line_break(r"[\n]a") and not R.needs_line_break(r"a\n?b")
    assert R.has_case_flag("(?i)a") and R.has_case_flag("a(?i:b)") and not R.has_case_flag(r"\(?i)") and not R.has_case_flag("(?-i)a")
    assert R.case_variants(R.byte_grams("key")[0]) is None and len(R.case_variants(R.byte_grams("abc")[0])) == 8 and len(R.case_variants(R.byte_grams("a1_")[0])) == 2
    for bad in ("", "x" * 513, "(?=a)", "(?<!a)b", r"(a)\1", "("):
        with pytest.raises((ValueError, re.error)):
            R.checked(bad)


def test_definitions(spark):
    yes = ["def Foo(x):", "class Foo:", "fn Foo<T>(x: T)", "func Foo(", "type Foo struct {", "const Foo = (", "func (s *X) Foo(a int)", "export function Foo(", "struct Foo", "async def Foo(", "interface Foo extends Bar {"]
    no = ["let FooBar = 1", "return Foo(x)", "x = Foo(1)", "if let Some(Foo) = x", "class Foobar:"]
    df = spark.createDataFrame([(x, True) for x in yes] + [(x, False) for x in no], "line string, want boolean")
    assert df.where(F.col("line").rlike(R.definition("Foo")) != F.col("want")).collect() == []
    df = spark.createDataFrame([("import Foo", True), ('x = "class Foo"', True), ("  return Foo", True), ("class Foo:", False), ("impl<'a> Foo<'a> {", False)], "line string, want boolean")
    assert df.where(R.binds_only(F.col("line"), "Foo") != F.col("want")).collect() == []


def test_relevance_order(spark):
    rows = [("def retry(x):", "src/a.py"), ("const f = (x) => {", "src/a.js"), ("    retry(x)", "src/a.py"), ("import retry", "src/a.py"), ("retry(x)", "tests/a.py")]
    got = [r[0] for r in spark.createDataFrame(rows, "l string, p string").select(R.relevance(F.col("l"), F.col("p"))).collect()]
    assert got[0] > 8000 and got[1] > 8000 and got[2] > got[4] > got[3]


def test_index_and_search(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(i, i % 3, f"src/f{i}.py", "\r\n".join(f"{words[(i + k) % 4]}_{k} = {words[i % 4]}({i})" for k in range(4))) for i in range(60)] + [(90, 1, "x.py", None), (91, 1, "y.py", ""), (92, None, None, "alpha_9 = 1\nné\0x")]
    docs = spark.createDataFrame(rows, "doc_id long, repo_id long, path string, text string").cache()
    full, stop = index.build(docs)
    first, first_stop = index.build(docs.where("doc_id < 30"))
    more, more_stop = index.extend(first, first_stop, docs.where("doc_id >= 30"), docs.count())
    pairs = lambda x: {(r.gram, i) for r in x.collect() for i in r.doc_ids}
    assert pairs(more) <= pairs(full) and {r.gram for r in first_stop.collect()} <= {r.gram for r in more_stop.collect()}
    by = {(g, i) for i, _, _, t in rows if t for b in [t.encode()] for g in {b[k] << 16 | b[k + 1] << 8 | b[k + 2] for k in range(len(b) - 2) if 0 not in b[k : k + 3]}}
    counts = {}
    for g, _ in by:
        counts[g] = counts.get(g, 0) + 1
    assert pairs(full) == {(g, i) for g, i in by if counts[g] <= index.cutoff(len(rows))}
    for pattern in ("alpha_3 = ", r"beta\(1\d\)|gamma_2", "a.b", r"(alpha|beta)\(5", "nothing here"):
        scan = {(i, k + 1) for i, _, _, t in rows if t for k, line in enumerate(t.split("\n")) if re.search(pattern, line.removesuffix("\r"))}
        assert {(r.doc_id, r.line_no) for r in search.search(docs, pattern).collect()} == scan
        for ix, st in ((full, stop), (more, more_stop)):
            ids = search.candidates(ix.select("gram", F.explode("doc_ids").alias("doc_id")), pattern, st)
            kept = docs if ids is None else docs.join(ids, "doc_id", "left_semi")
            assert {(r.doc_id, r.line_no) for r in search.search(kept, pattern).collect()} == scan
    ids = search.candidates(full.select("gram", F.explode("doc_ids").alias("doc_id")), "GAMMA_1", stop, ignore_case=True)
    kept = docs if ids is None else docs.join(ids, "doc_id", "left_semi")
    assert search.search(kept, "GAMMA_1", ignore_case=True).count() == search.search(docs, "gamma_1").count() > 0
    assert search.search(docs, "a\\nb").count() == 0 and search.search(docs.limit(0), "alpha").count() == 0
    assert index.rebuild_due(50, 0, 10) and index.rebuild_due(0, 41, 100) and not index.rebuild_due(0, 40, 100) and not index.rebuild_due(0, 9, 0)
    hits = spark.createDataFrame([(1, n) for n in (1, 2, 3, 4, 8)], "doc_id long, line_no int")
    assert sorted(r.line_no for r in search.collapsed(hits, 2).collect()) == [1, 4, 8] and search.collapsed(hits, 0).count() == 5
