import sys
sys.path.insert(0, str(__import__("pathlib").Path(__file__).parents[2]))
from corpusmill.llm.tokens import p7_ids
from pyspark.sql import SparkSession


def test_matches_tokenizers():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    s = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: list(r.ids) for r in p7_ids(s, d).collect()}
    rows = s.read.parquet(d + "/documents.parquet").select("doc_id", "text").collect()
    bad = [r.doc_id for r in rows if got[r.doc_id] != t.encode(r.text or "", add_special_tokens=False).ids]
    assert len(got) == len(rows) and not bad, bad[:5]
