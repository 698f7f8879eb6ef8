import random, re, sys
sys.path.insert(0, str(__import__("pathlib").Path(__file__).parents[2]))
import pytest
from corpusmill.llm import common, neardup
from pyspark.sql import SparkSession


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()


def sets(t):
    w = re.findall(r"[A-Za-z0-9_]+", t or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_pairs(spark, tmp_path):
    r = random.Random(5)
    rows = []
    for base in range(12):
        words = [f"w{r.randrange(10**6)}" for _ in range(120)]
        for copy in range(r.choice([1, 4])):
            w = list(words)
            for _ in range(r.randrange(6)):
                w[r.randrange(120)] = "x"
            rows.append((len(rows), "go", " ".join(w)))
    rows += [(900, "go", None), (901, "go", ""), (902, "go", "a b c d"), (903, "go", "a b c d e"), (904, "go", "a,b,c d e"), (905, None, rows[0][2]), (None, "go", rows[0][2]), rows[0]]
    spark.createDataFrame([(*x, 1) for x in rows], "file_id long, language string, content string, key int").write.parquet(f"{tmp_path}/prepared_files.parquet")
    want = set()
    once = {i: sets(t) for i, lang, t in rows if lang and i is not None}
    for a in once:
        for b in once:
            if a < b and once[a] and once[b] and len(once[a] & once[b]) >= 0.7 * len(once[a] | once[b]):
                want.add((a, b))
    got = [tuple(x) for x in neardup.p5_found(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (903, 904) in want
    groups = {x.file_id: x.group_id for x in neardup.p5_groups(spark, str(tmp_path)).collect()}
    assert set(groups) == {i for i, s in once.items() if s} and all(groups[a] == groups[b] for a, b in want if len(once[a] & once[b]) >= 0.8 * len(once[a] | once[b]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 75), (7, 7), (100, 50)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 75: 50, 100: 50}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []
