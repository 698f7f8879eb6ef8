import re, sys
sys.path.insert(0, str(__import__("pathlib").Path(__file__).parents[2]))
import __spark_entry__ as e
from corpusmill.llm.secrets import build, mask, redacted, spans
from pyspark.sql import SparkSession


def test_mask_and_pieces():
    assert mask("Pä9É-ß٣\n") == "Xx0X-x0\n"
    t = 'a = 1\nsecret = "TwXCXakthKxG" + "Kzi7r1sK6KyyNN"\nb = "kept" + "too"\n'
    assert redacted(t, build()) == 'a = 1\nsecret = "XxXXXxxxxXxX" + "Xxx0x0xX0XxxXX"\nb = "kept" + "too"\n'


def test_all_files():
    d = "/root/testdata/sf0.01"
    s = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    files = {r.file_id: r for r in s.read.parquet(f"{d}/prepared_files.parquet").orderBy("arrived_at", ascending=False).collect()}
    got = e.queries()["p2_redacted"](s, d).collect()
    assert len(got) == len(files) and {r.file_id for r in got} == set(files)
    a, hit = build(), 0
    for r in got:
        t = files[r.file_id].content
        if t is None:
            assert r.content is None
            continue
        found = spans(t, a)
        hit += bool(found)
        assert len(r.content) == len(t) and [c for c in r.content if not c.isalnum()] == [c for c in t if not c.isalnum()]
        assert bool(found) == (r.content != t) and all(r.content[x:y] == mask(t[x:y]) for x, y in found)
        kept, at = [], 0
        for x, y in found:
            kept.append((at, x))
            at = y + re.match(r"""(?:["'][^\w"']*["'][^"'\n]+(?=["']))*""", t[y:])[0].__len__()  # further pieces
        assert all(r.content[x:y] == t[x:y] for x, y in [*kept, (at, len(t))])
    assert hit > 50
