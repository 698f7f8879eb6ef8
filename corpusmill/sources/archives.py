"""Repository archives, lists of repositories and commit feeds as DataFrames."""
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusmill.functions import paths as P

MOST_BYTES, MOST_FILES = 1 << 30, 200_000  # fixed values: what one archive may hold
HOST = re.compile(r"^(?:https?://|git@|ssh://(?:git@)?|git://)?(?:www\.)?(?P<host>[\w-]+(?:\.[\w-]+)+)[/:]", re.I)


def members(archive: bytes):
    """(path, bytes) of the files of a gzipped tar below its root directory; absolute and climbing paths are an error, others than files are passed over."""
    import io
    import tarfile

    total = 0
    with tarfile.open(fileobj=io.BytesIO(archive), mode="r:gz") as tar:
        for n, m in enumerate(x for x in tar if x.isfile()):
            if m.name.startswith("/") or ".." in m.name.split("/"):
                raise ValueError(f"unsafe path in the archive: {m.name}")
            total += m.size
            if n >= MOST_FILES or total > MOST_BYTES:
                raise ValueError("the archive holds too much")
            path = m.name.partition("/")[2]
            if path:
                yield path, tar.extractfile(m).read()


def archive_files(spark, folder: str) -> DataFrame:
    """(repo, path, language, content, bytes) of the indexable text files of all *.tar.gz below the folder, named owner__name.tar.gz; files with a NUL in their first 8,192 bytes or hidden text are left out."""

    def run(batches):
        for b in batches:
            for path, body in zip(b.path, b.content):
                repo = re.sub(r"\.tar\.gz$", "", path.rpartition("/")[2]).replace("__", "/", 1)
                rows = [(repo, p, x.decode("utf-8", "replace"), len(x)) for p, x in members(bytes(body)) if b"\0" not in x[:8192]]
                yield pd.DataFrame(rows, columns=["repo", "path", "content", "bytes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").option("recursiveFileLookup", "true").load(folder)
    got = files.select("path", "content").mapInPandas(run, "repo string, path string, content string, bytes long")
    got = got.where(P.should_index(F.col("path"), F.col("bytes")) & ~P.has_hidden_text(F.col("content")))
    return got.select("repo", "path", P.language_of(F.col("path")).alias("language"), "content", "bytes")


def canonical_repo(text: str) -> str | None:
    """owner/name of a repository reference in any usual form; None if it isn't one, or names a branch, a file or more."""
    t = text.strip()
    m = HOST.match(t)
    t = t[m.end() :] if m else t
    t = re.sub(r"/tree/[^/]+/?$", "", t).rstrip("/")
    t = re.sub(r"\.git$", "", t)
    parts = t.split("/")
    if len(parts) != 2 or not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9-]{0,38}", parts[0]) or not re.fullmatch(r"[A-Za-z0-9._-]{1,100}", parts[1]) or parts[1].endswith(".") or parts[1] in (".", ".."):
        return None
    return t


def repo_list(spark, path: str) -> DataFrame:
    """(repo, position) of a list with one reference a line: comments behind # and blank lines left out, of equal references in any case the first."""
    lines = spark.read.text(path).select(F.trim(F.substring_index("value", "#", 1)).alias("text"), F.monotonically_increasing_id().alias("position")).where("text <> ''")
    repo = F.udf(canonical_repo, "string")  # a short list
    return lines.select(repo("text").alias("repo"), "position").where("repo is not null").groupBy(F.lower("repo").alias("k")).agg(F.min_by("repo", "position").alias("repo"), F.min("position").alias("position")).drop("k")


def unescaped(text):
    """XML's five entities; the ampersand last."""
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(c))
    return text


def feed_entries(df: DataFrame, most: int = 20) -> DataFrame:
    """df (repo, xml) to (repo, position, title, author, updated, link): the first entries of Atom feeds; missing fields are null."""
    parts = F.slice(F.split("xml", "<entry>"), 2, most)
    rows = df.select("repo", F.posexplode(parts).alias("position", "e"))

    def field(tag):
        return F.trim(unescaped(F.nullif(F.regexp_extract("e", rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1), F.lit(""))))

    return rows.select("repo", "position", field("title").alias("title"), field("name").alias("author"), F.try_to_timestamp(field("updated")).alias("updated"), unescaped(F.nullif(F.regexp_extract("e", r'<link[^>]*href="([^"]*)"', 1), F.lit(""))).alias("link"))


def recent(entries: DataFrame, now, hours: int = 72, limit: int = 40) -> DataFrame:
    """The newest entries of the last hours before now."""
    return entries.where(F.col("updated") >= F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(hours))).orderBy(F.desc("updated"), "repo", "position").limit(limit)
