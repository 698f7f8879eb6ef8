"""Near-duplicate records: hash minima with banding, verification by signature and by exact similarity, connected components.

Tokens are maximal runs of [A-Za-z0-9_]; a record's set is that of its five successive tokens. Records with equal sets are
one class, found by a hash of the set before anything is compared, so copies don't meet in a bucket. Classes whose minima
agree in a band are candidates; a pair goes on if its signatures agree in enough places, and stays if the exact Jaccard
coefficient reaches the threshold. With 32 bands of 4 minima a pair at 0.7 is missed with a probability of about 0.00015.

Null ids, null contents and contents of fewer than five tokens have no rows. Rows of one id count once. Extra columns are
ignored.
"""
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corpusmill.llm.common import checkpoints, components, table

WORD = re.compile(r"[A-Za-z0-9_]+")
BANDS, ROWS = 32, 4
SHINGLE = 5


def minima_parameters(n=BANDS * ROWS):
    """Odd multipliers and offsets of n hash functions, from a fixed rule."""
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def mixed(x):
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text, cache, size=SHINGLE):
    """The set of hashes of this many successive tokens, ascending. cache: word hashes of the worker."""
    import xxhash

    words = WORD.findall(text)
    if len(words) < size:
        return np.empty(0, np.uint64)
    if len(cache) > 500_000:
        cache.clear()
    h = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        v = cache.get(w)
        if v is None:
            v = cache[w] = xxhash.xxh64_intdigest(w)
        h[i] = v
    n = len(words) - size + 1
    x = np.zeros(n, np.uint64)
    for k in range(size):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(mixed(x))


def signature(s, a, b):
    """The upper halves of the least hash under each function."""
    out = np.full(len(a), ~np.uint64(0))
    for x in range(0, len(s), 4096):
        out = np.minimum(out, (s[x : x + 4096, None] * a + b).min(axis=0))
    return (out >> np.uint64(32)).astype(np.uint32)


def signed(df):
    """df (id, content) to (id, set_hash, size, sig, bands): sig is packed, bands has a hash of each band."""

    def run(batches):
        import xxhash

        a, b = minima_parameters()
        cache = {}
        for batch in batches:
            out = []
            for i, t in zip(batch["id"], batch.content):
                s = shingles(t, cache)
                if len(s):
                    sig = signature(s, a, b)
                    rows = sig.reshape(BANDS, ROWS)
                    out.append((i, xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63), len(s), sig.tobytes(), [xxhash.xxh64_intdigest(r.tobytes(), seed=k) - (1 << 63) for k, r in enumerate(rows)]))
            yield pd.DataFrame(out, columns=["id", "set_hash", "size", "sig", "bands"])

    return df.mapInPandas(run, "id long, set_hash long, size long, sig binary, bands array<long>")


def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([float((np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).mean()) for x, y in zip(a, b)], dtype=float)


def exact(a: pd.Series, b: pd.Series) -> pd.Series:
    cache, out = {}, []
    for x, y in zip(a, b):
        x, y = shingles(x, cache), shingles(y, cache)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / max(1, len(x) + len(y) - both))
    return pd.Series(out, dtype=float)


def near_pairs(df, threshold):
    """df (id, content) to (members, pairs): members (id, class_id) of every record that has a set, class_id the least id of equal sets; pairs (a, b, similarity) of class ids, a < b, with at least this similarity."""
    checkpoints(df.sparkSession)
    rows = df.where("id is not null and content is not null").select(F.col("id").cast("long"), "content")
    sigs = signed(rows).checkpoint()
    members = sigs.select("id", "set_hash").distinct()
    first = sigs.groupBy("set_hash").agg(F.min("id").alias("class_id"))
    members = members.join(first, "set_hash").select("id", "class_id").distinct()
    classes = sigs.join(first.select(F.col("class_id").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    bands = classes.select("id", "size", "bands").select("id", "size", F.posexplode("bands").alias("band", "key"))
    busy = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "key")
    bands = bands.join(busy, ["band", "key"], "left_semi")
    x, y = bands.select("key", "band", F.col("id").alias("a"), F.col("size").alias("m")), bands.select("key", "band", F.col("id").alias("b"), F.col("size").alias("n"))
    pairs = x.join(y, ["key", "band"]).where(F.expr("a < b") & (F.least("m", "n") >= F.greatest("m", "n") * threshold)).select("a", "b").distinct()
    pairs = pairs.join(classes.select(F.col("id").alias("a"), F.col("sig").alias("s")), "a").join(classes.select(F.col("id").alias("b"), F.col("sig").alias("t")), "b")
    pairs = pairs.where(F.pandas_udf(agreement, "double")("s", "t") >= threshold - 0.22).select("a", "b").checkpoint()  # over five standard deviations below
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = rows.join(ends, "id", "left_semi").dropDuplicates(["id"])  # both joins below read the same exchange
    pairs = pairs.join(texts.select(F.col("id").alias("a"), F.col("content").alias("s")), "a").join(texts.select(F.col("id").alias("b"), F.col("content").alias("t")), "b")
    return members, pairs.select("a", "b", F.pandas_udf(exact, "double")("s", "t").alias("similarity")).where(F.col("similarity") >= threshold).checkpoint()


def source_files(spark, d):
    return table(spark, d, "prepared_files").where("language is not null").select(F.col("file_id").alias("id"), "content")


def p5_found(spark, d):
    """Every pair at 0.7 or more, those of equal sets included."""
    members, pairs = near_pairs(source_files(spark, d), 0.7)
    links = pairs.select("a", "b")
    full = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class_id")
    copies = members.join(full, "class_id", "left_semi")
    same = copies.select(F.col("id").alias("x"), "class_id").join(copies.select(F.col("id").alias("y"), "class_id"), "class_id").where("x < y").select("x", "y")
    left = links.join(members.select(F.col("id").alias("x"), F.col("class_id").alias("a")), "a").join(members.select(F.col("id").alias("y"), F.col("class_id").alias("b")), "b").select("x", "y")
    both = left.unionByName(same)
    return both.select(F.least("x", "y").alias("file_id_a"), F.greatest("x", "y").alias("file_id_b"))


def p5_groups(spark, d):
    """(file_id, group_id, links): each source file of five tokens or more with the least file_id it is connected with at 0.8 or more, and its class's links to other classes."""
    members, pairs = near_pairs(source_files(spark, d), 0.8)
    roots = components(pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    got = members.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").join(links, "class_id", "left")
    return got.select(F.col("id").alias("file_id"), F.coalesce("root", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
