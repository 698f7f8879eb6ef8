import sys, pytest
sys.path.insert(0, str(__import__("pathlib").Path(__file__).parents[2]))
from corpusmill.llm import tokens
from pyspark.sql import SparkSession

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()


def test_repeated_and_null_ids(spark):
    rows = [(1, "one two"), (1, "one two"), (2, None), (None, "one two"), (None, ""), (3, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = tokens.encode(docs, PATH)
    ids = sorted(((r.doc_id, list(r.ids)) for r in got.collect()), key=str)
    two = next(i for d, i in ids if d == 1)
    assert len(ids) == 6 and len(two) >= 2
    assert [i for d, i in ids if d == 1] == [two, two] and [i for d, i in ids if d is None] in ([two, []], [[], two]) and [i for d, i in ids if d == 2] == [[]]
    assert sorted(map(tuple, tokens.decode(got, PATH).collect()), key=str) == sorted(((d, t or "") for d, t in rows), key=str)


def test_round_trip(spark):
    d = "/root/testdata/sf0.01"
    got = dict(map(tuple, tokens.p7_text(spark, d).collect()))
    want = {r.doc_id: r.text or "" for r in spark.read.parquet(d + "/documents.parquet").select("doc_id", "text").collect()}
    assert got == want


def test_unknown_id(spark):
    with pytest.raises(Exception, match="no piece"):
        tokens.decode(spark.createDataFrame([(1, [10**8])], "doc_id long, ids array<int>"), PATH).collect()
