import random, sys
from collections import Counter
sys.path.insert(0, str(__import__("pathlib").Path(__file__).parents[2]))
import pytest
from corpusmill.llm import containers as C
from pyspark.sql import SparkSession


def best(items, capacity):
    """The least number of containers, by exhaustive search."""
    items = sorted(items, reverse=True)
    low = [len(items)]

    def place(i, bins):
        if len(bins) >= low[0]:
            return
        if i == len(items):
            low[0] = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= items[i]:
                rest = list(bins)
                rest.remove(room)
                place(i + 1, [*rest, room - items[i]])
        place(i + 1, [*bins, capacity - items[i]])

    place(0, [])
    return low[0]


def test_patterns():
    r = random.Random(4)
    extra = 0
    for _ in range(150):
        capacity = r.choice([10, 20, 37])
        items = [r.randrange(1, capacity + 1) for _ in range(r.randrange(0, 9))]
        got = C.packed(Counter(items), capacity)
        assert Counter(s for parts, n in got for s in parts for _ in range(n)) == Counter(items) and all(sum(p) <= capacity for p, _ in got)
        extra += sum(n for _, n in got) - best(items, capacity)
    assert extra <= 3


def test_dominating_sets_keep_the_optimum():
    r = random.Random(5)
    for _ in range(300):
        capacity = r.choice([12, 30])
        items = [r.randrange(1, capacity + 1) for _ in range(r.randrange(1, 9))]
        parts = C.dominating(C.Stock(Counter(items)), capacity, r.choice(items))
        if parts:
            rest = list((Counter(items) - Counter(parts)).elements())
            assert best(rest, capacity) + 1 == best(items, capacity)


def test_fill():
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    r = random.Random(6)
    rows = [(i, " word" * r.randrange(0, 70), 1) for i in range(200)] + [(None, " word" * 3, 1), (7, " word" * 130, 1), (7, None, 1), (201, " word" * 5000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int").repartition(5)
    got = C.fill(df, 50, "/opt/tokenizers/byte_bpe_50k.tiktoken").collect()
    by = {}
    for x in got:
        by.setdefault(x.container, []).append(x)
    for xs in by.values():
        xs.sort(key=lambda x: x.position)
        assert [x.position for x in xs] == list(range(len(xs))) and sum(x.tokens for x in xs) <= 50
        assert all(x.at == sum(y.tokens for y in xs[:k]) for k, x in enumerate(xs))
    total = sum((t or "").count(" word") for _, t, _ in rows)
    assert sum(x.tokens for x in got) == total and len(by) <= total / 50 * 1.05 + 1
    assert sum(x.piece == 0 for x in got) == len(rows) and [x.tokens for x in sorted(got, key=lambda x: x.start_token) if x.doc_id == 201] == [50] * 100
    assert C.fill(df.limit(0), 50, "/opt/tokenizers/byte_bpe_50k.tiktoken").collect() == []
    assert [tuple(x) for x in C.fill(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").coalesce(1), 50, "/opt/tokenizers/byte_bpe_50k.tiktoken").orderBy("doc_id").select("container", "position").collect()] == [(0, 0), (0, 1)]
