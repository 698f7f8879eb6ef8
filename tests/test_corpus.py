import datetime, io, sys, tarfile
sys.path.insert(0, str(__import__("pathlib").Path(__file__).parents[1]))
import pytest
from pyspark.sql import SparkSession
from corpusmill.plans import show
from corpusmill.plans.corpus import Corpus, newer, setting
from corpusmill.sources import archives as A
from corpusmill.streaming import indexing
from corpusmill.operators import index


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()


def body(name, n=6):
    return "".join(f"def {name}_{k}(x):\n    return x + {k}\n\n" for k in range(n))


def test_corpus(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "c"))
    files = [("own/one", "src/a.py", body("alpha")), ("own/one", "src/test_a.py", body("t")), ("https://host.example/Own/Two.git", "b.py", body("beta")), ("bad", "x.py", body("x")), ("own/one", "vendor/v.py", body("v"))]
    df = spark.createDataFrame(files, "repo string, path string, content string")
    facts = spark.createDataFrame([("own/one", "abc", datetime.date(2020, 1, 1), False), ("own/two", "", None, True)], "repo string, commit_sha string, pushed_at date, archived boolean")
    got = c.add(df, facts)
    assert (got["added"], got["unchanged"], got["skipped"], got["files"]) == (2, 0, 1, 2)
    assert c.index()["full"] and c.unindexed().count() == 0
    again = c.add(df.where("repo = 'own/one'"), facts)
    assert (again["added"], again["unchanged"]) == (0, 1) and c.stats()["documents"] == 2
    c.add(spark.createDataFrame([("OWN/Three", "c.py", body("gamma"))], "repo string, path string, content string"))
    assert c.unindexed().count() == 1
    hits = lambda **k: {(r.path, r.line_no) for r in c.search(r"def \w+_3\(", **k).collect()}
    before = hits()
    assert before == {("src/a.py", 10), ("b.py", 10), ("c.py", 10)}
    assert not c.index()["full"] and hits() == before
    c.index(rebuild=True)
    assert hits() == before and hits(path="src") == {("src/a.py", 10)} and hits(language="PY") == before
    assert c.tag(["own/one", "own/none"], add=["Core"]) == ["own/none"] and hits(tag="core") == {("src/a.py", 10)} and hits(repos=["own/TWO"]) == {("b.py", 10)}
    with pytest.raises(ValueError):
        c.tag(["own/one"], add=["a b"])
    assert c.decay("2024-01-01", dry_run=True) == ["Own/Two", "own/one"] and c.stats()["repos"] == 3
    c.remove("own/two")
    assert c.decay("2024-01-01") == ["own/one"] and c.stats() == {"repos": 1, "documents": 1, "bytes": len(body("gamma"))}
    assert c.compact() > 0 and hits() == {("c.py", 10)}
    c.refilter()
    c.clear_index()
    assert c.unindexed().count() == 1 and hits() == {("c.py", 10)}
    c.config("limit", "5")
    assert c.config() == {"limit": 5}


def test_settings():
    assert setting("auto_index", "Yes") is True and setting("limit", "7") == 7
    for k, v in (("auto_index", "maybe"), ("limit", "-1"), ("nothing", "1")):
        with pytest.raises(ValueError):
            setting(k, v)
    assert newer("1.10.0", "1.9.9") and not newer("v1.2", "1.2.0")


@pytest.mark.parametrize("text, want", [("own/name", "own/name"), ("https://host.example/own/name.git", "own/name"), ("git@host.example:own/name.git", "own/name"), ("host.example/own/name/tree/main", "own/name"), ("own", None), ("own/name/x", None), ("-own/name", None), ("own/name.", None), ("own/na me", None), ("o" * 40 + "/x", None)])
def test_repo_references(text, want):
    assert A.canonical_repo(text) == want


def test_sources(spark, tmp_path):
    def pack(files):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            for name, data in files:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        return out.getvalue()

    good = body("alpha").encode()
    (tmp_path / "own__name.tar.gz").write_bytes(pack([("root/src/a.py", good), ("root/b.py", good + b"\0"), ("root/c.py", good + "‮".encode()), ("root/README.md", good), ("root/dist/d.py", good)]))
    assert [(r.repo, r.path, r.language) for r in A.archive_files(spark, str(tmp_path)).collect()] == [("own/name", "src/a.py", "python")]
    with pytest.raises(ValueError):
        list(A.members(pack([("root/../x.py", good)])))
    (tmp_path / "list.txt").write_text("own/a # first\n\n# nothing\nOWN/A\nhttps://host.example/own/b\nbad line\n")
    assert sorted(r.repo for r in A.repo_list(spark, str(tmp_path / "list.txt")).collect()) == ["own/a", "own/b"]
    xml = "<feed><entry><title>a &lt;b&gt; &amp;lt;</title><author><name>N</name></author><updated>2024-05-01T00:00:00Z</updated><link href=\"x?a&amp;b\"/></entry><entry><title>old</title><updated>2024-01-01T00:00:00Z</updated></entry></feed>"
    rows = A.feed_entries(spark.createDataFrame([("own/a", xml), ("own/b", ""), ("own/c", None)], "repo string, xml string"))
    got = {(r.repo, r.position): (r.title, r.author, r.link) for r in rows.collect()}
    assert got == {("own/a", 0): ("a <b> &lt;", "N", "x?a&b"), ("own/a", 1): ("old", None, None)}
    assert [r.title for r in A.recent(rows, "2024-05-02T00:00:00Z").collect()] == ["a <b> &lt;"]


def test_streamed_index(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, f"name_{i} = call({i})") for i in range(20)]
    spark.createDataFrame(rows[:10], "doc_id long, text string").write.parquet(src)
    run = lambda: indexing.append_postings(spark.readStream.schema("doc_id long, text string").parquet(src), out, str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame(rows[10:], "doc_id long, text string").write.mode("append").parquet(src)
    run()
    run()
    got = {(r.gram, tuple(r.doc_ids)) for r in indexing.merged(spark, out).collect()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(r.gram, tuple(r.doc_ids)) for r in index.postings(index.grams(docs), spark.createDataFrame([], "gram int")).collect()}
    assert got == want


def test_show(spark):
    text = "import os\n\n" + body("alpha", 3) + "class Big:\n" + "".join(f"    def m{k}(self):\n        # note\n        return alpha_1({k})\n" for k in range(3))
    assert show.show(text, "python", symbols=["alpha_1"]).strip().startswith("6  def alpha_1") and "# note" not in show.show(text, "python", symbols=["Big"], comments=False)
    assert len(show.show(text, "python", lines_from=2, lines_to=4).split("\n")) == 3
    assert [x.split()[2].split("(")[0] for x in show.show(text, "python", outline=True).split("\n")] == ["alpha_0", "alpha_1", "alpha_2", "Big:", "m0", "m1", "m2"]
    assert "def m2" in show.show(text * 30, "python") and "return" not in show.show(text * 30, "python")
    with pytest.raises(LookupError):
        show.show(text, "python", symbols=["nothing"])
    files = {"src/a.ts": ("typescript", "import { help } from './lib/help'\nexport function main() {\n  return help(local(1))\n}\nfunction local(x) {\n  return x\n}\n"), "src/lib/help.ts": ("typescript", "export function help(x) {\n  return deep(x)\n}\nfunction deep(x) {\n  return far(x)\n}\nfunction far(x) {\n  return x\n}\n")}
    assert [(h, n) for h, _, n, _ in show.helpers(files, "src/a.ts", "main")] == [(1, "help"), (1, "local"), (2, "deep")]
    hits = [{"repo_id": 1, "path": "a.py", "line_no": 3, "line": "x" * 500}, {"repo_id": 1, "path": "a.py", "line_no": 9, "line": "y"}]
    assert "100 more characters" in show.render_text(hits) and show.render_compact(hits).count("\n") == 1 and '"more_available": true' in show.render_json(hits, True)
    assert show.within_budget(hits, 50) == hits[:1] and show.human(1_500_000) == "1.5 MB"
    docs = spark.createDataFrame([(1, 1, "src/a.py", "python", text), (2, 1, "src/b.py", "python", text), (3, 2, "src/c.py", "python", text)], "doc_id long, repo_id long, path string, language string, text string")
    shown, omitted = show.folder(docs, 1, "src", most=200)
    assert shown.startswith("src/a.py") and omitted == ["src/b.py"] and show.grouped_paths(docs, 1) == "src/ a.py b.py"
    assert [x[1:3] for x in show.define(docs, "alpha_2")] == [("src/a.py", 9), ("src/c.py", 9), ("src/b.py", 9)] and show.hits_json(docs.select("doc_id")).count() == 3
