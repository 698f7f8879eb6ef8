import sys
sys.path.insert(0, str(__import__("pathlib").Path(__file__).parents[2]))
import pytest
from corpusmill.llm import personal as P
from pyspark.sql import SparkSession


def found(t, source="issue"):
    return [(k, t[s:e]) for k, s, e, *_ in P.scan(t, source) if k != "name"]


@pytest.mark.parametrize("t, want", [
    ("mail ann.b+x@post.zedd.example now", ("email", "ann.b+x@post.zedd.example")), ("bob [at] zedd [dot] example", ("email", "bob [at] zedd [dot] example")), ("bob(at)zedd.example", ("email", "bob(at)zedd.example")),
    ("call +49 (0)30 23125-160.", ("phone", "+49 (0)30 23125-160")), ("Fax: 01632 960323", ("phone", "01632 960323")), ("(569) 555-0182", ("phone", "(569) 555-0182")), ("at 01.99.00.11.38", ("phone", "01.99.00.11.38")), ("870 555 0110 ext. 19", ("phone", "870 555 0110 ext. 19")), ("+12985550100", ("phone", "+12985550100")),
    ("SSN 980-57-2806.", ("id_number", "980-57-2806")), ("passport no. T9895220.", ("id_number", "T9895220")), ("ssn=942557071", ("id_number", "942557071")), ("NIE X-8964179-K.", ("id_number", "X-8964179-K")), ("Steuer-ID 29 742 821 852,", ("id_number", "29 742 821 852")), ("driver's licence HEDHG698302 to", ("id_number", "HEDHG698302")),
    ("at 527 Orchard Street.", ("address", "527 Orchard Street")), ("Flat 20, 66 Bramble Gardens", ("address", "Flat 20, 66 Bramble Gardens")), ("  Flat 31\n  37 Foundry Gardens\n", ("address", "Flat 31\n  37 Foundry Gardens")), ("48 rue des Tallows, x", ("address", "48 rue des Tallows")), ("Calle del Bramble 29, 3º B", ("address", "Calle del Bramble 29")), ("Orchardweg 66a", ("address", "Orchardweg 66a")), ("P.O. Box 6016", ("address", "P.O. Box 6016")),
])
def test_formats(t, want):
    assert found(t) == [want]


@pytest.mark.parametrize("t", ["noreply@zedd.example", "git@code.zedd.example:zedd/x.git", "zedd@1.2.3", "Took 347 000 189 ns over 17 runs.", "Ticket 283-96-2735X was closed.", "Build 2022.12.21.5841", "on 10.14.220.96 port", "Flat 22 Court layout", "Moved 13 Road Map items", "id ed891eb2-a764-1b53-e8a2-20de43451da7", "Checksum 694446094210", "", " \n"])
def test_no_formats(t):
    assert found(t) == []


def test_comments_only():
    t = 'x = "a@zedd.example"\n# by b@zedd.example\n'
    assert found(t, "tarball") == [("email", "b@zedd.example")]


def test_names_and_placeholders(tmp_path):
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    given, family = ["Ada", "Bo", "Cleo", "Dan"], ["Zander", "Yorick", "Xavisson", "Wendelin"]
    rows = [(i, f"fix\nSigned-off-by: {given[i % 4]} {family[i // 4 % 4]} <u{i}@zedd.example>\n", "commit") for i in range(16)]
    rows += [(20, "Thanks to Ada Newname for it.\nBlue Harbor wrote 3 rows on the Blue Harbor cluster.", "issue"), (21, None, "issue"), (22, "", "issue"), (None, "a@zedd.example", "issue"), (23, "x\nZander, Bo wrote: hm", "review")] + rows[:1]
    spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, kind int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, P.p9_found(spark, str(tmp_path)).collect()))
    assert got == sorted([(i, 2, k) for i in range(16) for k in ("email", "name")] + [(20, 1, "name"), (23, 2, "name")])
    texts = dict(map(tuple, P.p9_redacted(spark, str(tmp_path)).collect()))
    assert texts[0] == "fix\nSigned-off-by: [NAME] <[EMAIL]>\n" and texts[21] is None and texts[22] == "" and texts[23] == "x\n[NAME] wrote: hm" and texts[20].startswith("Thanks to [NAME] for it.\nBlue Harbor")


def test_names_do_not_drift(tmp_path):
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    given, family = ["Ada", "Bo", "Cleo", "Dan"], ["Zander", "Yorick", "Xavisson", "Wendelin"]
    rows = [(i, f"Reported-by: {given[i % 4]} {family[i // 4]} <u{i}@zedd.example>\n{given[i % 4]} {family[i // 4]} saw it.", "commit") for i in range(16)]
    rows += [(20 + i, f"As {family[i]}, {given[i]} said, it is cold.\nBlue Harbor wrote {i} rows.", "issue") for i in range(4)]
    rows += [(30, "Mail Queue moved.\nThe Quick start.\nKyoto Logs grew.", "issue"), (31, "As Ada Zander said, it is cold.", "issue")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in P.p9_found(spark, str(tmp_path)).collect() if r.kind == "name"}
    assert got == {(i, line, "name") for i in range(16) for line in (1, 2)} | {(20 + i, 1, "name") for i in range(4)} | {(31, 1, "name")}


def test_words_of_addresses_are_no_candidates():
    t = "Ship to 12 Orchard Street today, Flat 3, 66 Bramble Gardens.\nAda Zander\n9 Ada Zander Road"
    assert [t[s:e] for k, s, e, *_ in P.scan(t, "issue") if k == "name"] == ["Ada Zander"]


@pytest.mark.parametrize("t, want", [
    ('def f():\n    """Does x.\n\n    By a@zedd.example\n    """\n    y = "b@zedd.example"\n', ["a@zedd.example"]), ("int x; /* kept\n by a@zedd.example */\nchar *s = \"b@zedd.example\";\n", ["a@zedd.example"]), ("f(); /* a@zedd.example */\n", ["a@zedd.example"]),
    ("<!-- x\na@zedd.example\n-->\n<p>b@zedd.example</p>\n", ["a@zedd.example"]), ("=begin\na@zedd.example\n=end\nx = 'b@zedd.example'\n", ["a@zedd.example"]), ("f();//a@zedd.example\n", ["a@zedd.example"]), ("x = 1 #a@zedd.example\n", ["a@zedd.example"]), ("a int, --a@zedd.example\n", ["a@zedd.example"]),
    ("x = 'b@zedd.example' # a@zedd.example\n", ["a@zedd.example"]), ('x = """\nb@zedd.example\n"""\ny = "b@zedd.example"\n# a@zedd.example\n', ["a@zedd.example"]), ("ls src/*\nmail b@zedd.example\n# a@zedd.example\n", ["a@zedd.example"]), ("/* open\na@zedd.example\n", ["a@zedd.example"]), ("# see src/*\nmail b@zedd.example\n", []), ("{- x\na@zedd.example -}\n", ["a@zedd.example"]),
    ("/* a@zedd.example\n * c@zedd.example\n */\nx = 'b@zedd.example'\n", ["a@zedd.example", "c@zedd.example"]), ("u = 'https://zedd.example/b@zedd.example'\n", []),
])
def test_whole_comments(t, want):
    assert [v for _, v in found(t, "tarball")] == want
