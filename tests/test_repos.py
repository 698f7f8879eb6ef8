import sys
from pathlib import Path
R = Path(__file__).parents[1]
sys.path.insert(0, str(R))
import __spark_entry__ as e
from pyspark.sql import SparkSession


def test_repo_profile(tmp_path):
    s = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    docs = [(1, "go", 5), (1, "c", 5), (1, "py", 3), (2, None, None), (2, "go", None), (3, "c", 1), (3, None, 2), (None, "c", 9)]
    s.createDataFrame(docs, "repo_id long, language string, raw_size long").write.parquet(f"{tmp_path}/documents.parquet")
    s.createDataFrame([(1, 7), (2, None), (3, 1), (4, 2)], "repo_id long, disk_bytes long").write.parquet(f"{tmp_path}/repos.parquet")
    got = sorted(map(tuple, e.queries()["repo_profile"](s, str(tmp_path)).collect()))
    assert got == [(1, "c", 3, 13, 7), (2, None, 2, 0, None), (3, None, 2, 3, 1), (4, None, 0, 0, 2)]
