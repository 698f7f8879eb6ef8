"""A trigram index of the corpus: byte trigrams of each document, their document frequencies, postings and a stop list.

A trigram is three successive bytes of the UTF-8 text, none of them NUL, as a number (first byte highest). A trigram held
by more than 35 % of the documents stops being indexed. Postings are written as (gram, bucket, doc_ids) with a bounded
range of document ids a row, so no list grows with the corpus. Null and empty texts have no trigrams; null doc_ids aren't
indexed.
"""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusmill.operators.core import read

STOP_SHARE = 0.35  # fixed value
BUCKET = 65_536  # ids a posting row covers at most
REBUILD_RUNS, REBUILD_STALE = 50, 40  # fixed values: appended runs, and stale documents in percent, that call for a rebuild


def _grams(col: pd.Series) -> pd.Series:
    out = []
    for text in col:
        b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int32) if text else np.empty(0, np.int32)
        g = (b[:-2] << 16 | b[1:-1] << 8 | b[2:])[(b[:-2] > 0) & (b[1:-1] > 0) & (b[2:] > 0)] if len(b) > 2 else b[:0]
        out.append(np.unique(g))
    return pd.Series(out, dtype=object)


def grams(docs: DataFrame) -> DataFrame:
    """(doc_id, gram), each once."""
    udf = F.pandas_udf(_grams, "array<int>")
    return docs.where("doc_id is not null and text is not null").select("doc_id", F.explode(udf("text")).alias("gram"))


def frequencies(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("gram").agg(F.count(F.lit(1)).alias("documents"))


def cutoff(documents: int) -> int:
    return max(1, int(STOP_SHARE * documents))


def stop_list(df: DataFrame, documents: int) -> DataFrame:
    return df.where(F.col("documents") > cutoff(documents)).select("gram")


def postings(pairs: DataFrame, stop: DataFrame) -> DataFrame:
    """(gram, bucket, doc_ids): sorted ids of each gram outside the stop list, a bucket of ids a row."""
    kept = pairs.join(stop, "gram", "left_anti").withColumn("bucket", F.floor(F.col("doc_id") / BUCKET))
    return kept.groupBy("gram", "bucket").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))  # at most BUCKET ids


def build(docs: DataFrame, stop: DataFrame | None = None):
    """(postings, stop list) of all docs; a given stop list is kept and added to."""
    pairs, n = grams(docs), docs.count()
    found = stop_list(frequencies(pairs), n)
    stop = found if stop is None else stop.unionByName(found).distinct()
    return postings(pairs, stop), stop


def extend(index: DataFrame, stop: DataFrame, new: DataFrame, documents: int):
    """Adds documents with higher ids to an index: their postings are appended, then grams beyond the cutoff of all documents join the stop list, which never shrinks."""
    added = grams(new).join(stop, "gram", "left_anti").withColumn("bucket", F.floor(F.col("doc_id") / BUCKET))
    old = index.select("gram", "bucket", F.explode("doc_ids").alias("doc_id"))
    both = old.unionByName(added.select("gram", "bucket", "doc_id")).distinct()
    merged = both.groupBy("gram", "bucket").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))
    sizes = merged.groupBy("gram").agg(F.sum(F.size("doc_ids")).alias("documents"))
    stop = stop.unionByName(stop_list(sizes, documents)).distinct()
    return merged.join(stop, "gram", "left_anti"), stop


def rebuild_due(runs: int, stale: int, live: int) -> bool:
    return runs >= REBUILD_RUNS or live > 0 and stale * 100 // max(live, 1) > REBUILD_STALE


def trigram_df(spark, d):
    return frequencies(grams(read(spark, d, "documents")))


def trigram_stop(spark, d):
    docs = read(spark, d, "documents")
    return stop_list(frequencies(grams(docs)), docs.count())


def trigram_postings(spark, d):
    return build(read(spark, d, "documents"))[0]


def index_stats(spark, d):
    """(documents, trigrams_seen, trigrams_stored) of a full build."""
    docs = read(spark, d, "documents")
    n = docs.count()
    return frequencies(grams(docs)).agg(F.lit(n).cast("long").alias("documents"), F.count(F.lit(1)).alias("trigrams_seen"), F.coalesce(F.sum((F.col("documents") <= cutoff(n)).cast("long")), F.lit(0)).alias("trigrams_stored"))


def incremental_index(spark, d):
    """The number of stored pairs a gram has after an index of the first batches is extended by the rest; its rows are a part of those of a rebuild."""
    docs = read(spark, d, "documents").where("doc_id is not null")
    half = docs.agg(F.expr("percentile_disc(0.5) within group (order by doc_id)")).first()[0]
    index, stop = build(docs.where(F.col("doc_id") <= half))
    index, _ = extend(index, stop, docs.where(F.col("doc_id") > half), docs.count())
    return index.groupBy("gram").agg(F.sum(F.size("doc_ids")).alias("documents"))


def unindexed_repos(spark, d):
    """Repositories with documents beyond the highest live id that the stored postings reach."""
    docs = read(spark, d, "documents").select("doc_id", "repo_id")
    ids = read(spark, d, "postings").select(F.explode("doc_ids").alias("doc_id"))
    upto = docs.join(ids, "doc_id", "left_semi").agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    return docs.where(F.col("doc_id") > int(upto)).select("repo_id").where("repo_id is not null").distinct()


def posting_lookup(spark, d):
    """The document ids that the stored frames hold for some trigrams, each once; absent trigrams have no row."""
    rows = read(spark, d, "postings").where(F.col("trigram").isin("con", "ret", "\n  ", "zzq"))
    return rows.select("trigram", F.explode("doc_ids").alias("doc_id")).distinct()


def stale_postings(spark, d):
    """Ids in stored postings without a live document, once."""
    ids = read(spark, d, "postings").select(F.explode("doc_ids").alias("doc_id")).distinct()
    return ids.join(read(spark, d, "documents").select("doc_id").distinct(), "doc_id", "left_anti")


QUERIES = {f.__name__: f for f in (trigram_df, trigram_stop, trigram_postings, index_stats, incremental_index, unindexed_repos, posting_lookup, stale_postings)}
BYTES = "SELECT doc_id, unnest(b) AS x, generate_subscripts(b, 1) AS i FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents WHERE text IS NOT NULL)"
PAIRS = f"SELECT DISTINCT doc_id, x FROM (SELECT doc_id, x || lead(x, 1) OVER w || lead(x, 2) OVER w AS x FROM ({BYTES}) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE x IS NOT NULL AND NOT regexp_matches(x, '^(..)*00')"
DF = f"SELECT CAST('0x' || x AS INT) AS gram, count(*) AS documents FROM ({PAIRS}) GROUP BY x"
CUT = f"(SELECT greatest(1, CAST(floor({STOP_SHARE} * count(*)) AS BIGINT)) FROM documents)"
FIRST = "(SELECT quantile_disc(doc_id, 0.5) FROM documents)"
SQL = {
    "trigram_df": DF,
    "trigram_stop": f"SELECT gram FROM ({DF}) WHERE documents > {CUT}",
    "trigram_postings": f"WITH p AS MATERIALIZED ({PAIRS}), k AS (SELECT x FROM p GROUP BY x HAVING count(*) <= {CUT}) SELECT CAST('0x' || p.x AS INT) AS gram, doc_id // {BUCKET} AS bucket, list(doc_id ORDER BY doc_id) AS doc_ids FROM p JOIN k ON k.x = p.x GROUP BY ALL",
    "index_stats": f"SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS trigrams_seen, count(*) FILTER (WHERE documents <= {CUT}) AS trigrams_stored FROM ({DF})",
    "incremental_index": f"WITH p AS MATERIALIZED ({PAIRS}), s AS (SELECT x FROM p WHERE doc_id <= {FIRST} GROUP BY x HAVING count(*) > (SELECT greatest(1, CAST(floor({STOP_SHARE} * count(*)) AS BIGINT)) FROM documents WHERE doc_id <= {FIRST})) SELECT CAST('0x' || x AS INT) AS gram, count(*) AS documents FROM p WHERE x NOT IN (SELECT x FROM s) GROUP BY x HAVING count(*) <= {CUT}",
    "unindexed_repos": "SELECT DISTINCT repo_id FROM documents WHERE repo_id IS NOT NULL AND doc_id > (SELECT coalesce(max(doc_id), 0) FROM documents WHERE doc_id IN (SELECT unnest(doc_ids) FROM postings))",
    "posting_lookup": "SELECT DISTINCT trigram, unnest(doc_ids) AS doc_id FROM postings WHERE trigram IN ('con', 'ret', chr(10) || '  ', 'zzq')",
    "stale_postings": "SELECT DISTINCT id AS doc_id FROM (SELECT unnest(doc_ids) AS id FROM postings) WHERE id NOT IN (SELECT doc_id FROM documents)",
}
