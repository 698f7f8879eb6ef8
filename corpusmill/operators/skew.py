"""Keyed statistics when a few keys hold most rows: exact counts and quantiles without gathering a key's rows anywhere.

Rows are first counted by key and value on the map side; the counts are spread by key and value, never by key alone. A
quantile is found by narrowing, round by round, a histogram of mergeable counts per key until a bin is one value. The keys'
state is joined to the counts by key and salt, so a key with many different values is spread over SALTS places too.

Null keys or values are left out; an empty input gives no rows; the result has only the columns named here.
"""
from pyspark.sql import DataFrame, Window as W, functions as F

BINS = 256
SALTS = 16


def checkpoints(spark):
    """Sets the session's checkpoint folder: the one named in spark.checkpoint.dir; where that is unset a local session gets a temporary folder, and a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        d = tempfile.mkdtemp(prefix="corpusmill-")
    sc.setCheckpointDir(d)


def keyed_quantile(df: DataFrame, key: str, value: str, q: float, bins: int = BINS) -> DataFrame:
    """(key, rows, quantile) of integer values: the value at rank ceil(q * rows), at least the first. rows is what the last histogram of the key adds up to, with what the rounds before put below it."""
    checkpoints(df.sparkSession)
    data = df.select(F.col(key).alias("_k"), F.col(value).cast("long").alias("_v")).where("_k is not null and _v is not null")
    data = data.groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_m")).withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int")).checkpoint()
    state = data.groupBy("_k").agg(F.sum("_m").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    state = state.withColumn("_r", F.greatest(F.lit(1), F.ceil(F.col("_n") * q)))
    state = state.withColumn("_below", F.lit(0).cast("long")).withColumn("_above", F.lit(0).cast("long")).checkpoint()
    done = state.where("_hi = _lo")
    by = W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)  # at most `bins` rows a key
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    wide = "cast({} as decimal(20,0))"  # the range of values may exceed a long
    while True:
        state = state.where("_hi > _lo")
        if not state.limit(1).count():
            break
        hist = data.join(state.select("*", salts), ["_k", "_salt"]).where("_v between _lo and _hi")
        width = f"({wide.format('_hi')} - {wide.format('_lo')}) div {bins} + 1"
        hist = hist.withColumn("_w", F.expr(f"cast({width} as decimal(20,0))")).withColumn("_b", F.expr(f"({wide.format('_v')} - {wide.format('_lo')}) div _w"))
        hist = hist.groupBy("_k", "_n", "_r", "_lo", "_hi", "_w", "_b", "_below", "_above").agg(F.sum("_m").alias("_c"))
        hist = hist.withColumn("_s", F.sum("_c").over(by)).withColumn("_all", F.sum("_c").over(W.partitionBy("_k"))).where("_s >= _r and _s - _c < _r")
        state = hist.select(
            "_k", "_n",
            F.expr(f"cast({wide.format('_lo')} + _b * _w as long)").alias("_lo2"),
            F.expr(f"cast(least({wide.format('_hi')}, {wide.format('_lo')} + (_b + 1) * _w - 1) as long)").alias("_hi"),
            F.expr("_r - (_s - _c)").alias("_r"),
            F.expr("_below + _s - _c").alias("_below"), F.expr("_above + _all - _s").alias("_above"), "_c",
        ).withColumnRenamed("_lo2", "_lo").checkpoint()
        one = state.where("_hi = _lo").withColumn("_n", F.expr("_below + _c + _above")).drop("_c")
        done = done.unionByName(one)
        state = state.drop("_c")
    return done.select(F.col("_k").alias(key), F.col("_n").alias("rows"), F.col("_lo").alias("quantile"))


def p6_keys(spark, df):
    """Rows and median number of ids per trigram; a null list counts as empty."""
    df = df.withColumn("n_ids", F.when(F.col("doc_ids").isNull(), 0).otherwise(F.size("doc_ids")))
    return keyed_quantile(df, "trigram", "n_ids", 0.5)


def p6_key_medians(spark, d):
    return p6_keys(spark, spark.read.parquet(f"{d}/postings.parquet"))


def once(postings: DataFrame) -> DataFrame:
    """postings with each posting_id once, as _lone, _id, trigram, doc_ids: of a repeated one the earliest row counts, of null ones each."""
    lone = F.when(F.col("posting_id").isNull(), F.monotonically_increasing_id())
    rows = postings.withColumn("_lone", lone).groupBy("posting_id", "_lone").agg(F.min(F.struct("written_at", "trigram", "doc_ids")).alias("_p"))
    return rows.select("posting_id", "_lone", "_p.trigram", "_p.doc_ids")


def distinct_postings(postings: DataFrame, documents: DataFrame) -> DataFrame:
    """(trigram, n_ids): one row a posting with its number of distinct ids that documents has; a null list counts as empty."""
    ids = once(postings).select("posting_id", "_lone", "trigram", F.explode_outer(F.array_distinct("doc_ids")).alias("doc_id"))
    known = documents.select("doc_id").distinct().withColumn("_known", F.lit(1))
    return ids.join(known, "doc_id", "left").groupBy("posting_id", "_lone", "trigram").agg(F.count("_known").alias("n_ids")).select("trigram", "n_ids")


def p6_distinct_medians(spark, d):
    """p6_key_medians over distinct postings and existing document ids, as problem 6 asks."""
    df = distinct_postings(spark.read.parquet(f"{d}/postings.parquet"), spark.read.parquet(f"{d}/documents.parquet"))
    return keyed_quantile(df, "trigram", "n_ids", 0.5)


def p6_trigram_counts(spark, d):
    """(trigram, rows, documents): distinct postings, and different existing document ids in them, of each trigram. Ids are made distinct by trigram and id, then counted: a hot trigram is spread by its ids."""
    rows = once(spark.read.parquet(f"{d}/postings.parquet")).where("trigram is not null")
    known = spark.read.parquet(f"{d}/documents.parquet").select("doc_id").distinct()
    ids = rows.select("trigram", F.explode("doc_ids").alias("doc_id")).distinct().join(known, "doc_id", "left_semi")
    docs = ids.groupBy("trigram").agg(F.count(F.lit(1)).alias("documents"))
    return rows.groupBy("trigram").agg(F.count(F.lit(1)).alias("rows")).join(docs, "trigram", "left").select("trigram", "rows", F.coalesce("documents", F.lit(0)).alias("documents"))


def p6_repo_counts(spark, d):
    """(repo_id, rows, documents, median_size): rows, different document ids and exact median raw_size of each repo_id of documents; the null repo_id has no row, a repository without sizes a null median."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("repo_id is not null")
    per = docs.select("repo_id", "doc_id").groupBy("repo_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("repo_id").agg(F.sum("n").alias("rows"), F.count("doc_id").alias("documents"))
    sizes = keyed_quantile(docs, "repo_id", "raw_size", 0.5).select("repo_id", F.col("quantile").alias("median_size"))
    return per.join(sizes, "repo_id", "left")


def p6_found(spark, d):
    """Trigrams with at least 2 % of the rows as they are; their rows are those that the refined histogram of each key adds up to."""
    df = spark.read.parquet(f"{d}/postings.parquet")
    total = df.count()
    return p6_keys(spark, df).where(F.col("rows") >= total * 0.02).select("trigram")


QUERIES = {f.__name__: f for f in (p6_found, p6_key_medians, p6_distinct_medians, p6_trigram_counts, p6_repo_counts)}
ONCE = "SELECT row_number() OVER () AS p, trigram, doc_ids FROM (SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY written_at NULLS FIRST, trigram NULLS FIRST, doc_ids NULLS FIRST) AS i FROM postings) WHERE (i = 1 OR posting_id IS NULL) AND trigram IS NOT NULL"
SQL = {
    "p6_found": "SELECT trigram FROM postings WHERE trigram IS NOT NULL GROUP BY trigram HAVING count(*) >= 0.02 * (SELECT count(*) FROM postings)",
    "p6_key_medians": """WITH t AS (SELECT trigram, coalesce(len(doc_ids), 0) AS v, row_number() OVER (PARTITION BY trigram ORDER BY coalesce(len(doc_ids), 0)) AS i, count(*) OVER (PARTITION BY trigram) AS n FROM postings WHERE trigram IS NOT NULL) SELECT trigram, n AS "rows", v AS quantile FROM t WHERE i = (n + 1) // 2""",
    "p6_distinct_medians": f"""WITH k AS MATERIALIZED ({ONCE}), v AS (SELECT k.p, k.trigram, count(DISTINCT d.doc_id) AS v FROM k LEFT JOIN (SELECT p, unnest(doc_ids) AS id FROM k) u ON u.p = k.p LEFT JOIN documents d ON d.doc_id = u.id GROUP BY ALL), t AS (SELECT trigram, v, row_number() OVER (PARTITION BY trigram ORDER BY v) AS i, count(*) OVER (PARTITION BY trigram) AS n FROM v) SELECT trigram, n AS "rows", v AS quantile FROM t WHERE i = (n + 1) // 2""",
    "p6_trigram_counts": f"""WITH k AS MATERIALIZED ({ONCE}), u AS (SELECT DISTINCT trigram, unnest(doc_ids) AS id FROM k), c AS (SELECT trigram, count(*) AS c FROM u WHERE id IN (SELECT doc_id FROM documents) GROUP BY trigram) SELECT k.trigram, count(*) AS "rows", coalesce(max(c.c), 0) AS documents FROM k LEFT JOIN c ON c.trigram = k.trigram GROUP BY k.trigram""",
    "p6_repo_counts": """SELECT repo_id, count(*) AS "rows", count(DISTINCT doc_id) AS documents, quantile_disc(raw_size, 0.5) AS median_size FROM documents WHERE repo_id IS NOT NULL GROUP BY repo_id""",
}
