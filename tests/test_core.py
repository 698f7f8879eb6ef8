import sys, duckdb, pytest
sys.path.insert(0, str(__import__("pathlib").Path(__file__).parents[1]))
import __spark_entry__ as e
from pyspark.sql import SparkSession
D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()


@pytest.mark.parametrize("name", list(e.oracle_sql()))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "repos", "postings", "prepared_files"):
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = e.queries()[name](spark, D)
    want = c.execute(f"select {','.join(f'"{x}"' for x in df.columns)} from ({e.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
