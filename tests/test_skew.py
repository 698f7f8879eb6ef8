import sys, pytest
sys.path.insert(0, str(__import__("pathlib").Path(__file__).parents[1]))
import __spark_entry__ as e
from pyspark.sql import SparkSession


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()


def test_distinct_medians(spark, tmp_path):
    rows = [(1, "abc", [1, 2, 3], "2020-01-01"), (1, "abc", [1, 2, 3], "2020-01-02"), (2, "abc", [1, 1, 9], "2020-01-01"), (3, "abc", None, "2020-01-01"),
            (None, "xyz", [2], None), (None, "xyz", [2], None), (4, "xyz", [9], "2020-01-01"), (5, None, [1], "2020-01-01")]
    spark.createDataFrame(rows, "posting_id long, trigram string, doc_ids array<long>, written_at string").write.parquet(f"{tmp_path}/postings.parquet")
    spark.createDataFrame([(1,), (2,), (3,)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, e.queries()["p6_distinct_medians"](spark, str(tmp_path)).collect())) == [("abc", 3, 1), ("xyz", 3, 1)]


def test_values_are_counted_before_the_join(spark, tmp_path, monkeypatch):
    from corpusmill.operators import skew
    skew.checkpoints(spark)
    df = spark.createDataFrame([("hot", i % 3) for i in range(300)] + [("a", 5)], "k string, v long")
    joined, join = [], type(df).join
    monkeypatch.setattr(type(df), "join", lambda a, *x, **y: joined.append(a.count()) or join(a, *x, **y))
    assert sorted(map(tuple, skew.keyed_quantile(df, "k", "v", 0.5).collect())) == [("a", 1, 5), ("hot", 300, 1)]
    assert joined and max(joined) == 4


def test_refinement_over_wide_ranges(spark):
    import random
    from corpusmill.operators import skew
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.9 else f"k{r.randrange(5)}", r.choice([r.randrange(-10**9, 10**9), r.randrange(40), -2**63, 2**63 - 1])) for _ in range(4000)] + [(None, 1), ("n", None), ("one", 7)]
    by = {}
    for k, v in rows:
        if k is not None and v is not None:
            by.setdefault(k, []).append(v)
    df = spark.createDataFrame([(*x, 1) for x in rows], "k string, v long, rows int")
    for q in (0, 0.5, 0.9, 1):
        got = {x[0]: (x[1], x[2]) for x in skew.keyed_quantile(df, "k", "v", q).collect()}
        assert got == {k: (len(v), sorted(v)[max(1, -(-int(q * 10) * len(v) // 10)) - 1]) for k, v in by.items()}
    assert skew.keyed_quantile(df.limit(0), "k", "v", 0.5).collect() == []


def test_hot_key_is_spread(spark):
    from corpusmill.operators import skew
    df = spark.range(0, 40000, 1, 8).selectExpr("if(id % 10 = 0, 'a', 'hot') as k", "id as v")
    got = {x[0]: (x[1], x[2]) for x in skew.keyed_quantile(df, "k", "v", 0.5).collect()}
    assert got["a"] == (4000, 19990) and got["hot"][0] == 36000
