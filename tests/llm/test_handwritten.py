import random, re, sys
sys.path.insert(0, str(__import__("pathlib").Path(__file__).parents[2]))
import numpy as np
import pytest
from corpusmill.llm import handwritten as H
from pyspark.sql import SparkSession

R = random.Random(9)


def word():
    return "".join(R.choice("abcdefghij") for _ in range(7))


def code(n=60):
    forms = ["{a} = {b}({c}, {n})", "if {a} > {n}: {b}.{c}()", "for {a} in {b}.{c}: {a}.append({n})", "raise ValueError('{a} ' + {b})", "{a}['{b}'] = {c}", "with {a}({n}) as {b}: {c}({b})", "return [{a} for {a} in {b} if {a} < {n}]", "assert {a} != {b}, '{c}'"]
    return "".join(R.choice(forms).format(a=word(), b=word(), c=word(), n=R.randrange(9999)) + "\n" for _ in range(n))


@pytest.mark.parametrize("line, want", [("// Code generated by toolx. DO NOT EDIT.", True), ("# This file is produced by tools/x; manual changes will be lost.", True), (" * <auto-generated> x 1.2 </auto-generated>", True), ("# @generated from a.schema by x", True), ("// Automatisch erzeugt durch x 1.2 - bitte nicht ändern.", True),
                                        ("// Do not edit this list without asking the release group.", False), ("// The ids are generated by the caller; do not edit their order.", False), ("# Writes the header of generated files, see x.", False), ("// minified output of this module lives in the release archive", False)])
def test_banners(line, want):
    assert bool(H.GENERATED.search(line)) == want


@pytest.mark.parametrize("line, want", [("// Vendored from libx 5.1.0; do not diverge.", True), ("# libx v1.2.3 - https://libx.example/ - bundled with this package", True), ("// This is a snapshot of libx 2.1; see https://x", True), ("# call the x vendor before changing y", False)])
def test_vendor_banners(line, want):
    assert bool(H.VENDORED.search(line)) == want


def test_classes(spark, tmp_path):
    copy = code()
    table = "".join(f"  case {i * 2}: return '{word()}';\n" for i in range(40))
    mini = ";".join(f"var {R.choice('abcdef')}={R.choice('abcdef')}({R.choice('abcdef')},{i})" for i in range(80))
    rows = [(1, 1, "a.py", code()), (2, 2, "b.py", code()), (3, 3, "src/x.py", copy), (4, 4, "lib/y.py", "# note\n" + copy), (5, 5, "gen/t.c", table), (6, 5, "m.js", mini), (7, 5, "d.py", "x = '" + "Zk9" * 400 + "'"), (8, 6, "third_party/z/q.py", code()),
            (9, 6, "vendors_api/q.py", code()), (10, 7, "e.py", None), (11, 7, "e.py", " \n"), (12, 7, "e.py", ""), (None, 8, "f.py", table), (13, None, None, code()), (14, 9, "g.py", code() + "# Autogenerated by x: do not touch\n"), (15, 9, "h.py", copy * 0 + code(2))]
    rows += [(5, 5, "gen/t.c", table)]
    spark.createDataFrame([(*x, "tarball", "k") for x in rows] + [(99, 1, "c.md", table, "issue", "k")], "doc_id long, repo_id long, path string, text string, source string, key string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("directory", "gen"), ("file", "m"), (None, None)], "kind string, name string").write.parquet(f"{tmp_path}/suspects.parquet")
    got = sorted(r.doc_id for r in H.p1_found(spark, str(tmp_path)).collect())
    assert got == [3, 4, 5, 6, 7, 8, 14]
    by = {r.doc_id: r for r in H.p1_classes(spark, str(tmp_path)).collect()}
    assert by[3].vendored and by[5].generated and by[6].minified and by[7].blob and by[5].suspect and by[6].suspect and not by[1].suspect and set(by) == {1, 2, 3, 4, 5, 6, 7, 8, 9, 13, 14, 15}


def test_links_of_all_pairs(spark):
    """Signatures that meet the thresholds, but share few minima in a row, and partners that are not outermost in a bucket."""
    r = np.random.default_rng(3)
    new = lambda n: r.integers(0, 1 << 32, n, dtype=np.uint32)

    def off(x, n):
        x = x.copy()
        x[np.arange(n) * len(x) // n] = new(n)
        return x

    form, raw, far = new(96), new(64), new(64)
    rows = [(2, 2, form, raw, 0.0, 0.0), (1, 1, off(form, 3), far, 0.0, 0.0), (9, 9, off(form, 3), new(64), 0.0, 0.0), (3, 3, off(form, 24), off(raw, 19), 0.0, 0.0), (4, 2, form, raw, 0.0, 0.0), (5, 4, off(form, 24), off(raw, 20), 0.0, 0.0)]
    line = new(96)
    rows += [(20, 7, line, new(64), 0.0, 0.5), (21, 7, off(line, 24), new(64), 0.0, 0.5), (22, 8, line, new(64), 0.0, 0.5), (23, 7, off(line, 25), new(64), 0.0, 0.5)]
    data = new(96)
    rows += [(30, 1, data, None, 0.65, 0.0), (31, 1, off(data, 24), None, 0.65, 0.0), (32, 2, off(data, 12), None, 0.5, 0.0)]
    t = spark.createDataFrame([(i, p, x.tobytes(), None if y is None else y.tobytes(), a, b) for i, p, x, y, a, b in rows], "doc_id long, repo long, sig binary, raw binary, literal double, periodic double")
    ids = lambda x: {y.doc_id for y in x.collect()}
    assert ids(H.copies(t)) == {2, 3, 4}
    assert ids(H.families(t)) == {20, 21}
    assert ids(H.literals(t)) == {30, 31}


def test_partners_inside_a_bucket(spark):
    shared = code(30)
    other = lambda: re.sub("[a-j]{7}", lambda m: word(), shared)
    files = {1: (1, other()), 9: (9, other()), 4: (4, shared), 5: (5, shared)}
    docs = spark.createDataFrame([(i, p, "a.py", t, "tarball") for i, (p, t) in files.items()], "doc_id long, repo_id long, path string, text string, source string")
    assert {x.doc_id for x in H.classes(docs).where("vendored").collect()} == {4, 5}


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
