import random, sys
sys.path.insert(0, str(__import__("pathlib").Path(__file__).parents[2]))
import pytest
from corpusmill.llm import spans
from pyspark.sql import SparkSession


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()


def brute(rows, least):
    seen = {}
    for i, g, t in rows:
        for x in range(len(t or "") - least + 1):
            seen.setdefault(t[x : x + least], set()).add(g)
    out = set()
    for i, g, t in rows:
        if i is None or t is None:
            continue
        mark = [0] * (len(t) + 1)
        for x in range(len(t) - least + 1):
            if len(seen[t[x : x + least]]) > 1:
                mark[x : x + least] = [1] * least
        x = 0
        while x < len(t):
            y = x
            while mark[y]:
                y += 1
            if y > x:
                out.add((i, x, y))
            x = y + 1
    return out


@pytest.mark.parametrize("p", spans.COVERS)
def test_covers(p):
    d = spans.COVERS[p]
    assert {(a - b) % p for a in d for b in d} == set(range(p))


@pytest.mark.parametrize("least", [12, 40])
def test_against_brute_force(spark, least, monkeypatch):
    r = random.Random(least)
    text = lambda n: "".join(r.choice("ab\n é🙂") for _ in range(n))
    parts = [text(n) for n in (least - 1, least, least + 3, 3 * least)]
    rows = [(i, r.choice([1, 1, 1, 2, 3, None]), "".join(r.choice([text(r.randrange(60)), r.choice(parts)]) for _ in range(r.randrange(6)))) for i in range(80)]
    rows += [(100, 1, None), (101, 2, ""), (102, 2, "ab" * 90), (103, 2, "ab" * 40), (104, 3, "ab" * 70)]
    rows += [(200 + i, 1, "hot " + parts[3]) for i in range(40)] + [(rows[0])]  # hot in one group; a repeated row
    df = spark.createDataFrame([(*x, "extra") for x in rows], "id long, group long, content string, h string").repartition(3)
    got = [tuple(x) for x in spans.shared_spans(df, least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, least) and got


def test_nothing(spark):
    df = spark.createDataFrame([], "id long, group long, content string")
    assert spans.shared_spans(df).collect() == []
    df = spark.createDataFrame([(None, 1, "x" * 400), (1, 2, None), (2, 3, "")], "id long, group long, content string")
    assert spans.shared_spans(df).collect() == []
