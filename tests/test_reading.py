import sys
sys.path.insert(0, str(__import__("pathlib").Path(__file__).parents[1]))
import pytest
from pyspark.sql import SparkSession
from corpusmill.functions import changelog as L, code as C
from corpusmill.operators import reading


def lines(text):
    return text.split("\n")


JS = lines("""import { one } from './one';
const open = async (a) => {
  const s = "} not { here";
  return `a ${s} }
  still } open`;
};
/* a block
 * } comment */
class Shape extends Base {
  constructor(x) {
    super(x);
  }
  async area(a, b) {
    if (a) { return b; }
    return a;
  }
}
(() => {
  run();
})();""")
PY = lines('''def long(
    a,
    b=(1, 2),
):
    """Text
    def inside(x):
    """
    return a


class Thing:
    # a note
    def part(self):
        return 1

x = 1''')
RUST = lines("""pub(crate) fn life<'a>(x: &'a str) -> &'a str {
    let c = '{';
    x
}
impl<T> Show for Thing<T> {
    fn show(&self) {}
}""")


def test_block_ends():
    assert C.block_end(JS, 1, "javascript") == 5 and C.block_end(JS, 8, "javascript") == 16 and C.block_end(JS, 12, "javascript") == 15
    assert C.block_end(PY, 0, "python") == 7 and C.block_end(PY, 10, "python") == 13 and C.block_end(RUST, 0, "rust") == 3
    assert C.definitions(JS, "area", "javascript") == [(12, 15)] and C.definitions(PY, "inside", "python") == [] and C.definitions(RUST, "Thing", "rust") == [(4, 6)]
    assert C.block_end(lines("def a\n  x\nend\ny"), 0, "ruby") == 2 and C.block_end(["int f(void);", "int x;"], 0, "c") == 0


def test_outlines():
    assert C.outline(JS, "javascript") == [1, 8, 9, 12] and C.outline(PY, "python") == [0, 10, 12] and C.outline(PY, "python", True) == [0, 10]
    assert C.outline(RUST, "rust") == [0, 4, 5] and C.outline([], "go") == []


@pytest.mark.parametrize("line, name", [("pub async fn go(x: u8) {", "go"), ("func (s *Server) Run() error {", "Run"), ("export default class Foo {", "Foo"), ("impl<T> Display for Bar<T> {", "Bar"), ("const f = (x) =>", "f"), ("let y = 3", None), ("return call(x)", None), ("public static final class Q {", "Q")])
def test_declared(line, name):
    assert C.declared(line) == name


@pytest.mark.parametrize("line, name", [("  public static int size(List<String> a) {", "size"), ("  render() {", "render"), ("  if (x) {", None), ("  } else if (y) {", None), ("  foo(x);", None), ("  while (a(b)) {", None), ("  x = call(y) {", None)])
def test_methods(line, name):
    assert C.method(line) == name


def test_prose_and_scopes():
    assert [i for i, m in enumerate(C.prose(PY, "python")) if m] == [4, 5, 6, 11]
    assert [i for i, m in enumerate(C.prose(JS, "javascript")) if m] == [6, 7]
    assert not any(C.prose(lines("/* open\n" + "x\n" * 70 + "*/"), "c")) and not any(C.prose(['"""', "never closed"], "python"))
    assert C.scope(PY, 13) == "def part(self):" and C.scope(PY, 12) == "class Thing:" and C.scope(PY, 15) is None and C.scope(JS, 14) == "async area(a, b) {"


def test_imports():
    assert C.imports(lines("from .a import (b as c,\n  d)\nimport os.path as p, sys\nfrom x import *"), "python") == [("c", ".a"), ("d", ".a"), ("p", "os.path"), ("sys", "sys")]
    assert C.imports(lines("import x, { y as z } from './m';\nconst { q: r } = require('../n')\nimport type { T } from 't'"), "typescript") == [("x", "./m"), ("z", "./m"), ("r", "../n"), ("T", "t")]
    assert C.module_paths("..util.x", "a/b/c.py", "python") == ["a/util/x.py", "a/util/x/__init__.py"] and C.module_paths("os", "a.py", "python") == []
    assert C.module_paths("../m.js", "src/a/b.ts", "typescript")[:3] == ["src/m.js", "src/m.ts", "src/m.tsx"] and C.module_paths("../../x", "a/b.ts", "typescript") == [] and len(C.module_paths("./m", "b.ts", "typescript")) == 12
    assert C.normalise("a/./b/../c") == "a/c" and C.normalise("../a") is None and C.identifiers("a.b(c) + a + d") == ["a", "c", "d"]


MD = "# Changelog\n\n## Unreleased\n\n## [2.1.0] - 2024-01-02\n\n### Added\n- See [the docs](http://x) for more than twenty characters. Then more.\n  - nested\n```\n## 9.9.9\n```\n## v2.0.0\n- old\n"
RST = "History\n=======\n\n1.2.0 (2020)\n------------\n\n* x\n\n1.1.0\n-----\n\n* y\n"


def test_changelogs():
    assert [(v, a, z) for v, _, a, z in L.releases(MD)] == [("unreleased", 2, 3), ("2.1.0", 4, 11), ("2.0.0", 12, 14)]
    assert [v for v, *_ in L.releases(RST)] == ["1.2.0", "1.1.0"] and L.releases("no heading") == [] and L.releases("") == []
    rows = L.releases(MD)
    assert L.latest(MD, rows)[0] == "2.1.0" and L.found(rows, "v2.0")[0] == "2.0.0" and L.found(rows, "3") is None
    assert L.summary("- See [the docs](http://x) for more than twenty characters. Then more.") == "See the docs for more than twenty characters." and L.summary("  - nested") is None and L.summary("| a |") is None and len(L.summary("x" * 200)) == 90
    assert L.version_in("v1.2.3-rc1 x") == "1.2.3-rc1" and L.version_in("release of today") is None
    assert L.rank("CHANGES.rst") < L.rank("news") and L.rank("docs/changelog.md") is None and L.rank("x.md") is None


def test_tables(tmp_path):
    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    js = "import { help } from './lib';\nexport function main() {\n  return help();\n}\n"
    rows = [(1, 1, "src/a.js", "JS", js, "tarball"), (2, 1, "src/lib.js", None, "export function help() {\n  return inner();\n}\nfunction inner() {\n  return 1;\n}\n", "tarball"), (3, 2, "src/b.js", "javascript", js, "tarball"), (4, 1, "x.py", "python", None, "tarball"), (5, 1, "y.py", "python", "", "tarball"), (6, 1, None, None, "x", "tarball"), (7, 1, "CHANGELOG.md", "markdown", MD, "changelog"), (None, 1, "z.py", "python", "def a():\n  pass", "tarball")]
    spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, repo_id long, path string, language string, text string, source string, name string").write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    assert [tuple(r) for r in reading.import_targets(spark, d).collect()] == [(1, "help", 2, "src/lib.js")]
    assert sorted(map(tuple, reading.helpers(spark, d).collect())) == [(2, "help", "inner")]
    assert {(r.doc_id, r.name) for r in reading.declarations(spark, d).collect()} == {(1, "main"), (2, "help"), (2, "inner"), (3, "main")}
    assert [(r.doc_id, r.version) for r in reading.latest_releases(spark, d).collect()] == [(7, "2.1.0")] and reading.changelog_releases(spark, d).count() == 3
    assert {r.doc_id: r.code for r in reading.comment_lines(spark, d).collect()} == {1: 4, 2: 6, 3: 4, 5: 0} and reading.defined_blocks(spark, d).count() == 4
