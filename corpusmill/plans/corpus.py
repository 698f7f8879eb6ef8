"""A corpus in a folder: documents, repositories, index and settings as Parquet snapshots behind a manifest.

Every change writes new snapshots and then replaces the manifest, the only file that is overwritten: a reader sees the old
state or the new one, and an interrupted change leaves files that the next compaction removes. The folder is one that all
executors share; the manifest is small and handled by the driver through Hadoop's file system.
"""
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from corpusmill.functions import paths as P
from corpusmill.operators import index, search
from corpusmill.sources.archives import canonical_repo

DOCUMENTS = "doc_id long, repo_id long, path string, language string, text string, raw_size long, indexed_at timestamp"
REPOS = "repo_id long, name string, name_key string, commit_sha string, pushed_at date, archived boolean, tags array<string>, indexed_at timestamp"
TABLES = {"documents": DOCUMENTS, "repos": REPOS, "postings": "gram int, bucket long, doc_ids array<long>", "stop": "gram int"}
# Words for yes and no in settings.
YES, NO = ("true", "yes", "on", "1"), ("false", "no", "off", "0")
SETTINGS = {"auto_index": bool, "include_tests": bool, "limit": int, "per_repo": int, "context": int, "decay_months": int}


def setting(key, value):
    """A setting's value from text; raises ValueError for unknown keys and wrong values."""
    if key not in SETTINGS:
        raise ValueError(f"there is no setting {key}")
    v = str(value).strip().lower()
    if SETTINGS[key] is bool:
        if v not in YES + NO:
            raise ValueError(f"{key} is true or false")
        return v in YES
    if not v.isdigit():
        raise ValueError(f"{key} is a whole number, not negative")
    return int(v)


def newer(a, b):
    """Whether version a comes after b, by three numbers."""
    def three(v):
        return tuple(int(x) for x in (v.lstrip("v").split("-")[0].split(".") + ["0", "0"])[:3])

    return three(a) > three(b)


class Corpus:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        at = self.path(f"{self.folder}/manifest.json")
        if not self.fs.exists(at):
            return {"tables": {}, "upto": 0, "runs": 0, "settings": {}}
        return json.loads("\n".join(r.value for r in self.spark.read.text(at.toString()).collect()))

    def commit(self, tables: dict | None = None, without=(), **facts):
        """Writes the tables as new snapshots, then the manifest that names them, and no longer those in without."""
        m = self.manifest()
        for name in without:
            m["tables"].pop(name, None)
        for name, df in (tables or {}).items():
            at = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{at}", compression="zstd")
            m["tables"][name] = at
        m |= facts
        new = self.path(f"{self.folder}/manifest-{uuid.uuid4().hex}.json")
        out = self.fs.create(new, True)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        at = self.path(f"{self.folder}/manifest.json")
        self.fs.delete(at, False)
        if not self.fs.rename(new, at):
            raise OSError("the manifest can't be replaced")

    def read(self, name) -> DataFrame:
        at = self.manifest()["tables"].get(name)
        return self.spark.read.parquet(f"{self.folder}/{at}") if at else self.spark.createDataFrame([], TABLES[name])

    def config(self, key=None, value=None):
        m = self.manifest()
        if key is None:
            return m["settings"]
        self.commit(settings=m["settings"] | {key: setting(key, value)})

    def add(self, files: DataFrame, facts: DataFrame | None = None, now=None) -> dict:
        """Adds or replaces repositories. files: (repo, path, content[, language]); facts: (repo, commit_sha, pushed_at, archived), at most a row a repository. A repository whose known, not empty commit is stored already is unchanged. Returns the counts by outcome."""
        now = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        spelled = F.udf(canonical_repo, "string")
        names = files.select("repo").distinct().withColumn("name", spelled("repo")).withColumn("name_key", F.lower("name"))
        skipped = names.where("name is null").count()
        names = names.where("name is not null")
        facts = facts if facts is not None else self.spark.createDataFrame([], "repo string, commit_sha string, pushed_at date, archived boolean")
        facts = facts.select(F.lower(spelled("repo")).alias("name_key"), "commit_sha", "pushed_at", "archived").where("name_key is not null").dropDuplicates(["name_key"])
        repos, docs = self.read("repos"), self.read("documents")
        wanted = names.groupBy("name_key").agg(F.min("name").alias("typed")).join(facts, "name_key", "left")
        same = repos.where("commit_sha is not null and commit_sha <> ''").select("name_key", "commit_sha")
        fresh = wanted.join(same, ["name_key", "commit_sha"], "left_anti")
        added_repos = fresh.count()
        unchanged = wanted.count() - added_repos
        top = repos.agg(F.coalesce(F.max("repo_id"), F.lit(0))).first()[0]
        number = F.row_number().over(W.orderBy("name_key"))  # a row a repository of this call, without its files
        known = repos.select("name_key", F.col("repo_id").alias("old_id"), F.col("name").alias("old_name"), F.col("pushed_at").alias("old_pushed"), F.col("archived").alias("old_archived"), "tags", F.col("commit_sha").alias("old_sha"))
        made = fresh.join(known, "name_key", "left").withColumn("n", number)
        made = made.select(F.coalesce("old_id", F.col("n") + top).cast("long").alias("repo_id"), F.coalesce("old_name", "typed").alias("name"), "name_key", F.coalesce("commit_sha", "old_sha").alias("commit_sha"), F.coalesce("pushed_at", "old_pushed").alias("pushed_at"), F.coalesce("archived", "old_archived").alias("archived"), "tags", now.alias("indexed_at"))
        all_repos = repos.join(made.select("name_key"), "name_key", "left_anti").select(*made.columns).unionByName(made)
        size = F.octet_length("content")
        tests = bool(self.manifest()["settings"].get("include_tests"))
        kept = files.join(names.select("repo", "name_key"), "repo").join(made.select("name_key", "repo_id"), "name_key").where(P.should_index(F.col("path"), size, tests) & ~P.has_hidden_text(F.col("content")) & ~P.is_binary(F.col("content")))
        kept = kept.dropDuplicates(["repo_id", "path"])
        upto = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
        per = kept.select("repo_id", "path", P.language_of(F.col("path")).alias("language"), F.col("content").alias("text"), size.cast("long").alias("raw_size"), now.alias("indexed_at"))
        per = per.withColumn("doc_id", F.monotonically_increasing_id() + F.lit(upto + 1))  # above all before, not dense; fixed once written
        columns = [c.split()[0] for c in DOCUMENTS.split(", ")]
        self.commit({"documents": docs.join(made.select("repo_id"), "repo_id", "left_anti").select(*columns).unionByName(per.select(*columns)), "repos": all_repos})
        added = self.read("documents").where(F.col("doc_id") > upto)
        totals = added.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("raw_size"), F.lit(0)).alias("bytes")).first()
        return {"added": added_repos, "unchanged": unchanged, "skipped": skipped, "files": totals.files, "bytes": totals.bytes}

    def index(self, rebuild=False) -> dict:
        """Brings the index up to date: from scratch at first, when asked for or when a rebuild is due, else by the documents above its high-water mark."""
        m, docs = self.manifest(), self.read("documents")
        live, top = docs.agg(F.count(F.lit(1)), F.coalesce(F.max("doc_id"), F.lit(0))).first()
        covered = docs.where(F.col("doc_id") <= m["upto"]).count()
        stale = max(0, m.get("indexed", 0) - covered)
        full = rebuild or not m["tables"].get("postings") or index.rebuild_due(m["runs"], stale, live)
        if full:
            postings, stop = index.build(docs)
            added = live
        else:
            new = docs.where(F.col("doc_id") > m["upto"])
            postings, stop = index.extend(self.read("postings"), self.read("stop"), new, live)
            added = live - covered
        self.commit({"postings": postings, "stop": stop}, upto=top, runs=0 if full else m["runs"] + 1, indexed=live if full else m.get("indexed", 0) + added)
        stored = self.read("postings").select("gram").distinct().count()
        return {"documents": live, "added": added, "trigrams_seen": stored + self.read("stop").count(), "trigrams_stored": stored, "full": full}

    def clear_index(self):
        """Drops the index and its marks with one manifest."""
        self.commit(without=("postings", "stop"), upto=0, runs=0, indexed=0)

    def unindexed(self) -> DataFrame:
        return self.read("documents").where(F.col("doc_id") > self.manifest()["upto"]).select("repo_id").distinct()

    def search(self, pattern, ignore_case=False, language=None, path=None, tag=None, repos=None) -> DataFrame:
        """Matching lines, through the index where the pattern allows; documents above the high-water mark are searched too."""
        docs = self.read("documents")
        if language:
            docs = docs.where(F.col("language") == P.canonical_language(F.lit(language)))
        if path:
            docs = docs.where(P.matches_glob(F.col("path"), P.path_filter(path)))
        if tag or repos:
            own = self.read("repos")
            own = own.where(F.array_contains("tags", tag.strip().lower())) if tag else own
            own = own.where(F.col("name_key").isin([(canonical_repo(r) or "").lower() for r in repos])) if repos else own
            docs = docs.join(own.select("repo_id"), "repo_id", "left_semi")
        m = self.manifest()
        if m["tables"].get("postings"):
            pairs = self.read("postings").select("gram", F.explode("doc_ids").alias("doc_id"))
            ids = search.candidates(pairs, pattern, self.read("stop"), ignore_case)
            if ids is not None:
                new = docs.where(F.col("doc_id") > m["upto"])
                docs = docs.where(F.col("doc_id") <= m["upto"]).join(ids, "doc_id", "left_semi").select(*new.columns).unionByName(new)
        return search.search(docs, pattern, ignore_case)

    def tag(self, names, add=(), remove=()) -> list:
        """Adds and removes tags of repositories; returns the names that aren't stored. Blank tags and those with a comma or a space are refused."""
        for t in [*add, *remove]:
            if not t.strip() or "," in t or " " in t.strip():
                raise ValueError(f"not a tag: {t!r}")
        keys = [(canonical_repo(n) or n).lower() for n in names]
        repos = self.read("repos")
        known = {r.name_key for r in repos.where(F.col("name_key").isin(keys)).select("name_key").collect()}
        clean = lambda ts: F.array(*[F.lit(t.strip().lower()) for t in ts]).cast("array<string>")
        tags = F.array_except(F.array_union(F.coalesce("tags", clean([])), clean(add)), clean(remove))
        self.commit({"repos": repos.withColumn("tags", F.when(F.col("name_key").isin(keys), tags).otherwise(F.col("tags")))})
        return [n for n, k in zip(names, keys) if k not in known]

    def drop(self, ids: DataFrame):
        """Removes the repositories of ids (repo_id) and their documents."""
        self.commit({"documents": self.read("documents").join(ids, "repo_id", "left_anti"), "repos": self.read("repos").join(ids, "repo_id", "left_anti")})

    def remove(self, name):
        self.drop(self.read("repos").where(F.col("name_key") == (canonical_repo(name) or name).lower()).select("repo_id"))

    def decay(self, today, months=12, archived=True, dry_run=False) -> list:
        """Removes repositories without a push for so many months of thirty days, and archived ones; unknown dates don't count as old. Returns their names."""
        old = F.coalesce(F.col("pushed_at") < F.date_sub(F.lit(today).cast("date"), 30 * months), F.lit(False)) if months else F.lit(False)
        gone = self.read("repos").where(old | (F.lit(archived) & F.coalesce("archived", F.lit(False))))
        names = [r.name for r in gone.select("name").orderBy("name").collect()]
        if names and not dry_run:
            self.drop(gone.select("repo_id"))
        return names

    def refilter(self, include_tests=False):
        """Removes what the rules keep out now, and repositories left without a document."""
        docs = self.read("documents")
        kept = docs.where(P.should_index(F.col("path"), F.col("raw_size"), include_tests))
        self.commit({"documents": kept, "repos": self.read("repos").join(kept.select("repo_id").distinct(), "repo_id", "left_semi")})

    def compact(self) -> int:
        """Deletes what no manifest names; returns the bytes."""
        used, freed = set(self.manifest()["tables"].values()) | {"manifest.json"}, 0
        for f in self.fs.listStatus(self.path(self.folder)):
            if f.getPath().getName() not in used:
                freed += self.fs.getContentSummary(f.getPath()).getLength()
                self.fs.delete(f.getPath(), True)
        return freed

    def stats(self) -> dict:
        d = self.read("documents").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("raw_size"), F.lit(0)).alias("bytes")).first()
        return {"repos": self.read("repos").count(), "documents": d.documents, "bytes": d.bytes}
