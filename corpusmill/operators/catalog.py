"""Listings, lookups and maintenance of the corpus: documents and repositories. Null repo_ids belong to no repository; null sizes count as 0."""
from pyspark.sql import Window as W, functions as F

from corpusmill.functions import paths as P
from corpusmill.operators.core import read

TODAY = "2024-06-30"  # what the queries take for today, so that results don't change from day to day
CURATION_NAMES = ["awesome", "tutorial", "course", "roadmap", "cheatsheet", "cheat-sheet", "interview", "handbook", "guide", "curriculum", "learn-", "-learning", "system-design", "project-based", "free-programming", "public-apis", "every-programmer", "coding-interview", "study-plan", "-notes", "bookmarks", "resources", "collection", "list-of", "papers", "prompts", "-books", "ebook"]  # fixed values


def limited(df, n):
    """The first n rows; all if n is negative."""
    return df if n < 0 else df.limit(n)


def files_of(docs, repos, name, n=-1):
    """A repository's files by path; the name in any case."""
    own = repos.where(F.col("name_key") == name.lower()).select("repo_id")
    return limited(docs.join(own, "repo_id", "left_semi").select("doc_id", "path", "language", "raw_size").orderBy("path", "doc_id"), n)


def some_repo(spark, d):
    return read(spark, d, "repos").where("name is not null").agg(F.min_by("name", "repo_id")).first()[0] or ""


def files_listing(spark, d):
    return files_of(read(spark, d, "documents"), read(spark, d, "repos"), some_repo(spark, d).upper())


def point_read(spark, d):
    """Documents by repository and path."""
    docs = read(spark, d, "documents")
    at = docs.where("path is not null and repo_id is not null").agg(F.min(F.struct("doc_id", "repo_id", "path")).alias("x")).first().x
    repo, path = (at.repo_id, at.path) if at else (None, None)
    return docs.where((F.col("repo_id") == F.lit(repo)) & (F.col("path") == F.lit(path))).select("doc_id", "text")


def sample_paths(spark, d):
    return read(spark, d, "documents").orderBy("doc_id").select("doc_id", "path").limit(20)


def repo_listing(spark, d):
    """Every repository: what is stored of it where that is known, what its documents say otherwise; nulls first by name."""
    per = read(spark, d, "documents").groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("raw_size"), F.lit(0)).alias("s"))
    got = read(spark, d, "repos").join(per, "repo_id", "left")
    return got.select("repo_id", "name", F.coalesce("files", "n", F.lit(0)).alias("files"), F.coalesce("source_bytes", "s", F.lit(0)).alias("source_bytes")).orderBy(F.asc_nulls_first("name"), "repo_id")


def live_totals(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "raw_size", F.lit(0).alias("repo"))
    repos = read(spark, d, "repos").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("raw_size"), F.lit(1).alias("repo"))
    return docs.unionByName(repos).agg(F.count_if(F.col("repo") == 0).alias("documents"), F.coalesce(F.sum("raw_size"), F.lit(0)).alias("bytes"), F.coalesce(F.max("doc_id"), F.lit(0)).alias("highest_id"), F.count_if(F.col("repo") == 1).alias("repos"))


def document_languages(spark, d):
    return read(spark, d, "documents").select(P.canonical_language(F.col("language")).alias("language")).where("language is not null").distinct()


def directory_counts(spark, d):
    directory = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    return read(spark, d, "documents").where("path is not null").groupBy("repo_id", directory.alias("directory")).agg(F.count(F.lit(1)).alias("files"))


def tags_sorted(spark, d):
    """Repositories a tag, by tag; a repository's repeated tag counts once."""
    return read(spark, d, "repos").select(F.explode(F.array_distinct(F.transform("tags", lambda t: F.lower(F.trim(t))))).alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count(F.lit(1)).alias("repos")).orderBy("tag")


def tagged_repos(spark, d):
    """Repositories that carry the most frequent tag (of equal ones the first)."""
    top = tags_sorted(spark, d).agg(F.min(F.struct((-F.col("repos")).alias("n"), "tag")).alias("x")).first().x
    return read(spark, d, "repos").where(F.array_contains(F.transform("tags", lambda t: F.lower(F.trim(t))), top.tag if top else "")).select("repo_id", "name")


def retagged(spark, d):
    """Each repository's tags after adding one and removing another, in order and without repeats."""
    tags = F.coalesce(F.transform("tags", lambda t: F.lower(F.trim(t))), F.array().cast("array<string>"))
    return read(spark, d, "repos").select("repo_id", F.array_join(F.array_except(F.array_union(tags, F.array(F.lit("reviewed"))), F.array(F.lit("cli"))), ",").alias("tags"))


def repos_named(spark, d):
    return read(spark, d, "repos").where(F.contains(F.lower("name"), F.lit("or"))).select("repo_id", "name")


def decay_candidates(spark, d):
    """Repositories without a push for twelve months of thirty days, or archived; unknown dates don't count as old."""
    old = F.col("pushed_at").isNotNull() & (F.col("pushed_at") < F.date_sub(F.lit(TODAY).cast("date"), 360))
    return read(spark, d, "repos").where(old | F.coalesce("archived", F.lit(False))).select("repo_id", "name", "pushed_at")


def stale_repos(spark, d):
    return read(spark, d, "repos").select("repo_id", F.coalesce(F.col("pushed_at") < F.date_sub(F.lit(TODAY).cast("date"), 365), F.lit(False)).alias("stale"))


def decayed(spark, d):
    """Documents left after the decayed repositories are removed."""
    return read(spark, d, "documents").join(decay_candidates(spark, d).select("repo_id"), "repo_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))


def changed_files(spark, d):
    """Prepared files of repositories whose stored commit isn't the last one known: an empty or null commit always counts as changed. Redelivered files count once."""
    same = read(spark, d, "repos").where("commit_sha is not null and commit_sha <> ''").select("repo_id")
    return read(spark, d, "prepared_files").join(same, "repo_id", "left_anti").where("file_id is not null").select("file_id", "repo_id").distinct()


def resolved_names(spark, d):
    """The stored spelling of each repository named by prepared files, null where none is stored."""
    stored = read(spark, d, "repos").groupBy("name_key").agg(F.max_by("name", F.struct("indexed_at", "repo_id")).alias("stored"))
    typed = read(spark, d, "prepared_files").where("repo is not null").select("repo", F.lower("repo").alias("name_key")).distinct()
    return typed.join(stored, "name_key", "left").select("repo", "stored")


def known_repos_anti(spark, d):
    """How many repositories named by prepared files are stored, and how many aren't; the name's case doesn't matter."""
    return resolved_names(spark, d).agg(F.count("stored").alias("known"), F.count_if(F.col("stored").isNull()).alias("new"))


def first_delivery(spark, d):
    """Each prepared file once: the row that arrived first."""
    files = read(spark, d, "prepared_files").where("file_id is not null")
    return files.groupBy("file_id").agg(F.min(F.struct("arrived_at", "path", "repo_id")).alias("x")).select("file_id", "x.repo_id", "x.path", "x.arrived_at")


def snapshot_labels(spark, d):
    """v<version> (<first eight of the commit>), whichever is known; a permalink only for a full commit id."""
    v, c = F.nullif(F.col("version"), F.lit("")), F.nullif(F.col("commit_sha"), F.lit(""))
    label = F.when(v.isNotNull() & c.isNotNull(), F.concat(F.lit("v"), v, F.lit(" ("), F.substring(c, 1, 8), F.lit(")"))).when(v.isNotNull(), F.concat(F.lit("v"), v)).when(c.isNotNull(), F.substring(c, 1, 8))
    return read(spark, d, "repos").select("repo_id", label.alias("label"), F.coalesce(F.col("commit_sha").rlike("^[0-9a-fA-F]{40}$"), F.lit(False)).alias("permalink"))


def largest_repos(spark, d):
    return read(spark, d, "repos").where("files is not null").orderBy(F.desc("files"), "repo_id").select("repo_id", "files").limit(10)


def audit_median(spark, d):
    """The upper median of the repositories' stored files (null as 0): the element at half the number of rows."""
    files = read(spark, d, "repos").select(F.coalesce("files", F.lit(0)).alias("files"))
    n = files.count()
    counts = files.groupBy("files").agg(F.count(F.lit(1)).alias("n"))  # far fewer rows than repositories
    upto = counts.withColumn("upto", F.sum("n").over(W.orderBy("files")))
    return upto.where(F.col("upto") > n // 2).agg(F.coalesce(F.min("files"), F.lit(0)).alias("median_files"))


def _audit(docs, kind):
    if kind == "directory":
        name = F.explode(F.transform(F.filter(P.directories(F.col("path")), lambda s: P.suspect_word(s).isNotNull()), lambda s: F.lower(s)))
    else:
        name = P.suspect_word(P.stem(P.file_name(F.col("path"))))
    rows = docs.where("path is not null").select("repo_id", "path", "doc_id", name.alias("name")).where("name is not null")
    per = rows.groupBy("name", "repo_id").agg(F.count(F.lit(1)).alias("files"), F.min(F.struct("doc_id", "path")).alias("first"))
    got = per.groupBy("name").agg(F.sum("files").alias("files"), F.count("repo_id").alias("repos"), F.min("first").alias("first"))
    return got.orderBy(F.desc("files"), "name").limit(30).select("name", "files", "repos", F.col("first.path").alias("example"))


def audit_directories(spark, d):
    """The thirty suspect directory names with most files, their repositories and first example."""
    return _audit(read(spark, d, "documents"), "directory")


def audit_files(spark, d):
    return _audit(read(spark, d, "documents"), "file")


def curation_repos(spark, d):
    """Repositories whose name shows a list or a course."""
    name = F.lower(F.substring_index("name", "/", -1))
    return read(spark, d, "repos").select("repo_id", F.coalesce(name.rlike(P.quoted(CURATION_NAMES)), F.lit(False)).alias("curated"))


def recent_documents(spark, d):
    """The forty documents indexed last within three days of the last one, newest first."""
    docs = read(spark, d, "documents")
    last = docs.agg(F.max("indexed_at")).first()[0]
    return docs.where(F.col("indexed_at") >= F.lit(last) - F.expr("interval 72 hours")).orderBy(F.desc("indexed_at"), "doc_id").select("doc_id", "indexed_at").limit(40)


def upserted_repos(spark, d):
    """Repositories by name in any case, merged: the latest row's facts, and for what it lacks those of the one before it."""
    w = W.partitionBy("name_key").orderBy(F.desc_nulls_last("indexed_at"), F.desc("repo_id")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = read(spark, d, "repos").where("name_key is not null")
    cols = ("name", "stars", "pushed_at", "language")
    return rows.select("name_key", *[F.first(c, ignorenulls=True).over(w).alias(c) for c in cols]).distinct()


DIRS = "string_split(path, '/')[:-2]"
WORD = "list_filter(string_split_regex(lower(regexp_replace({}, '([\\p{{Ll}}0-9])(\\p{{Lu}})', '\\1_\\2', 'g')), '[_.-]+'), lambda w: list_contains([" + ", ".join(f"'{w}'" for w in P.SUSPECT_WORDS) + "], w))[1]"
ALIAS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in P.ALIASES.items()) + "}"
AUDIT = "SELECT name, CAST(sum(f) AS BIGINT) AS files, count(repo_id) AS repos, min(x).p AS example FROM (SELECT name, repo_id, count(*) AS f, min({{'d': doc_id, 'p': path}}) AS x FROM ({}) WHERE name IS NOT NULL GROUP BY name, repo_id) GROUP BY name ORDER BY files DESC, name LIMIT 30"
TAGS = "SELECT repo_id, name, list_distinct(list_transform(tags, lambda t: lower(trim(t)))) AS t FROM repos"
DECAY = f"pushed_at IS NOT NULL AND pushed_at < DATE '{TODAY}' - 360 OR coalesce(archived, false)"
RESOLVED = "SELECT p.repo, s.stored FROM (SELECT DISTINCT repo FROM prepared_files WHERE repo IS NOT NULL) p LEFT JOIN (SELECT name_key, name AS stored FROM (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY indexed_at DESC NULLS LAST, repo_id DESC) AS i FROM repos) WHERE i = 1) s ON s.name_key = lower(p.repo)"
QUERIES = {f.__name__: f for f in (files_listing, point_read, sample_paths, repo_listing, live_totals, document_languages, directory_counts, tags_sorted, tagged_repos, retagged, repos_named, decay_candidates, stale_repos, decayed, changed_files, resolved_names, known_repos_anti, first_delivery, snapshot_labels, largest_repos, audit_median, audit_directories, audit_files, curation_repos, recent_documents, upserted_repos)}
SQL = {
    "files_listing": "SELECT doc_id, path, language, raw_size FROM documents WHERE repo_id IN (SELECT repo_id FROM repos WHERE name_key = (SELECT lower(min_by(name, repo_id)) FROM repos WHERE name IS NOT NULL))",
    "point_read": "SELECT d.doc_id, d.text FROM documents d JOIN (SELECT repo_id, path FROM documents WHERE path IS NOT NULL AND repo_id IS NOT NULL ORDER BY doc_id LIMIT 1) k ON k.repo_id = d.repo_id AND k.path = d.path",
    "sample_paths": "SELECT doc_id, path FROM documents ORDER BY doc_id LIMIT 20",
    "repo_listing": "SELECT r.repo_id, r.name, coalesce(r.files, t.n, 0) AS files, CAST(coalesce(r.source_bytes, t.s, 0) AS BIGINT) AS source_bytes FROM repos r LEFT JOIN (SELECT repo_id, count(*) AS n, coalesce(sum(raw_size), 0) AS s FROM documents GROUP BY repo_id) t ON t.repo_id = r.repo_id",
    "live_totals": "SELECT count(*) AS documents, CAST(coalesce(sum(raw_size), 0) AS BIGINT) AS bytes, coalesce(max(doc_id), 0) AS highest_id, (SELECT count(*) FROM repos) AS repos FROM documents",
    "document_languages": f"SELECT DISTINCT coalesce({ALIAS}[lower(trim(language))], lower(trim(language))) AS language FROM documents WHERE language IS NOT NULL",
    "directory_counts": "SELECT repo_id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS directory, count(*) AS files FROM documents WHERE path IS NOT NULL GROUP BY ALL",
    "tags_sorted": f"SELECT tag, count(*) AS repos FROM (SELECT unnest(t) AS tag FROM ({TAGS})) WHERE tag <> '' GROUP BY tag",
    "tagged_repos": f"SELECT repo_id, name FROM ({TAGS}) WHERE list_contains(t, (SELECT tag FROM (SELECT unnest(t) AS tag FROM ({TAGS})) WHERE tag <> '' GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 1))",
    "retagged": "SELECT repo_id, array_to_string(list_filter(CASE WHEN list_contains(t, 'reviewed') THEN t ELSE list_append(t, 'reviewed') END, lambda x: x <> 'cli'), ',') AS tags FROM (SELECT repo_id, list_transform(coalesce(tags, []), lambda x: lower(trim(x))) AS t FROM repos)",
    "repos_named": "SELECT repo_id, name FROM repos WHERE contains(lower(name), 'or')",
    "decay_candidates": f"SELECT repo_id, name, pushed_at FROM repos WHERE {DECAY}",
    "stale_repos": f"SELECT repo_id, coalesce(pushed_at < DATE '{TODAY}' - 365, false) AS stale FROM repos",
    "decayed": f"SELECT source, count(*) AS documents FROM documents d WHERE NOT EXISTS (SELECT 1 FROM repos r WHERE r.repo_id = d.repo_id AND ({DECAY})) GROUP BY source",
    "changed_files": "SELECT DISTINCT file_id, repo_id FROM prepared_files p WHERE file_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM repos r WHERE r.repo_id = p.repo_id AND commit_sha IS NOT NULL AND commit_sha <> '')",
    "resolved_names": RESOLVED,
    "known_repos_anti": f"SELECT count(stored) AS known, count(*) - count(stored) AS new FROM ({RESOLVED})",
    "first_delivery": "SELECT file_id, repo_id, path, arrived_at FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY arrived_at, path) AS i FROM prepared_files WHERE file_id IS NOT NULL) WHERE i = 1",
    "snapshot_labels": "SELECT repo_id, CASE WHEN v IS NOT NULL AND c IS NOT NULL THEN 'v' || v || ' (' || substring(c, 1, 8) || ')' WHEN v IS NOT NULL THEN 'v' || v WHEN c IS NOT NULL THEN substring(c, 1, 8) END AS label, coalesce(regexp_matches(c, '^[0-9a-fA-F]{40}$'), false) AS permalink FROM (SELECT repo_id, nullif(version, '') AS v, nullif(commit_sha, '') AS c FROM repos)",
    "largest_repos": "SELECT repo_id, files FROM repos WHERE files IS NOT NULL ORDER BY files DESC, repo_id LIMIT 10",
    "audit_median": "SELECT coalesce(max(f), 0) AS median_files FROM (SELECT coalesce(files, 0) AS f FROM repos ORDER BY f LIMIT 1 OFFSET (SELECT count(*) // 2 FROM repos))",
    "audit_directories": AUDIT.format(f"SELECT repo_id, doc_id, path, unnest(list_transform(list_filter({DIRS}, lambda s: {WORD.format('s')} IS NOT NULL), lambda s: lower(s))) AS name FROM documents WHERE path IS NOT NULL"),
    "audit_files": AUDIT.format("SELECT repo_id, doc_id, path, " + WORD.format("regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '')") + " AS name FROM documents WHERE path IS NOT NULL"),
    "curation_repos": f"SELECT repo_id, coalesce(regexp_matches(lower(string_split(name, '/')[-1]), '{P.quoted(CURATION_NAMES)}'), false) AS curated FROM repos",
    "recent_documents": "SELECT doc_id, indexed_at FROM documents WHERE indexed_at >= (SELECT max(indexed_at) FROM documents) - INTERVAL 72 HOUR ORDER BY indexed_at DESC, doc_id LIMIT 40",
    "upserted_repos": "SELECT name_key, " + ", ".join(f"list({c} ORDER BY indexed_at DESC NULLS LAST, repo_id DESC) FILTER (WHERE {c} IS NOT NULL)[1] AS {c}" for c in ("name", "stars", "pushed_at", "language")) + " FROM repos WHERE name_key IS NOT NULL GROUP BY name_key",
}
