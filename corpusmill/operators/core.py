"""Core aggregates and joins. Null keys form their own group; empty tables give empty results."""
from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus_totals(spark, d):
    return read(spark, d, "documents").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("raw_size"), F.lit(0)).alias("bytes"))


def repo_stats(spark, d):
    return read(spark, d, "documents").groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.sum("raw_size").alias("bytes"))


def repo_profile(spark, d):
    """Every repository with its files, source bytes and the language of most bytes; of equal ones the first by name, the null language before all. disk_bytes is as stored in repos: documents has no compressed lengths."""
    per = read(spark, d, "documents").groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("n"), F.sum("raw_size").alias("s"))
    per = per.groupBy("repo_id").agg(F.sum("n").alias("files"), F.sum("s").alias("source_bytes"), F.min_by("language", F.struct(F.col("s").isNull(), -F.col("s"), "language")).alias("language"))
    got = read(spark, d, "repos").select("repo_id", "disk_bytes").join(per, "repo_id", "left")
    return got.select("repo_id", "language", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("source_bytes", F.lit(0)).alias("source_bytes"), "disk_bytes")


def top_languages(spark, d):
    return read(spark, d, "repos").where("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("repos")).orderBy(F.desc("repos"), "language").limit(6)


def tag_counts(spark, d):
    return read(spark, d, "repos").select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("repos"))


def empty_repos_anti(spark, d):
    return read(spark, d, "repos").join(read(spark, d, "documents").select("repo_id").distinct(), "repo_id", "left_anti").select("repo_id")


def dedup_case_repos(spark, d):
    return read(spark, d, "repos").groupBy("name_key").agg(F.max_by("repo_id", F.struct("indexed_at", "repo_id")).alias("repo_id"))


QUERIES = {f.__name__: f for f in (corpus_totals, repo_stats, repo_profile, top_languages, tag_counts, empty_repos_anti, dedup_case_repos)}
SQL = {
    "corpus_totals": "SELECT count(*) AS documents, CAST(coalesce(sum(raw_size),0) AS BIGINT) AS bytes FROM documents",
    "repo_stats": "SELECT repo_id, count(*) AS files, CAST(sum(raw_size) AS BIGINT) AS bytes FROM documents GROUP BY repo_id",
    "repo_profile": "WITH g AS (SELECT repo_id, language, count(*) AS n, sum(raw_size) AS s FROM documents GROUP BY ALL), l AS (SELECT repo_id, language, row_number() OVER (PARTITION BY repo_id ORDER BY s DESC NULLS LAST, language NULLS FIRST) AS i FROM g), t AS (SELECT repo_id, sum(n) AS n, sum(s) AS s FROM g GROUP BY repo_id) SELECT r.repo_id, l.language, CAST(coalesce(t.n, 0) AS BIGINT) AS files, CAST(coalesce(t.s, 0) AS BIGINT) AS source_bytes, r.disk_bytes FROM repos r LEFT JOIN t ON t.repo_id = r.repo_id LEFT JOIN l ON l.repo_id = r.repo_id AND l.i = 1",
    "top_languages": "SELECT language, count(*) AS repos FROM repos WHERE language IS NOT NULL GROUP BY language ORDER BY repos DESC, language LIMIT 6",
    "tag_counts": "SELECT tag, count(*) AS repos FROM (SELECT unnest(tags) AS tag FROM repos) GROUP BY tag",
    "empty_repos_anti": "SELECT repo_id FROM repos r WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.repo_id = r.repo_id)",
    "dedup_case_repos": "SELECT name_key, repo_id FROM (SELECT name_key, repo_id, row_number() OVER (PARTITION BY name_key ORDER BY indexed_at DESC, repo_id DESC) AS rn FROM repos) WHERE rn = 1",
}
