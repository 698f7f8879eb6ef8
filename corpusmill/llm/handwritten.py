"""Generated, minified and vendored files, and data saved as code, among stored source files.

A file's code, without comments, is masked: identifiers, strings and numbers become one character each, so every character
is a token. Sets of masked and of raw token shingles have signatures of hash minima; signatures in more bands than may
differ share one, so every pair that meets a threshold is compared, equal files as one. Files of two repositories whose form
and raw shingles agree are vendored copies, differing files within a repository that repeat a line form are generated, and
files of literals whose form agrees are blobs. Beside the pairs count what a file shows by itself: banners in its comments, a
vendor directory, the share of literals, of one-letter identifiers and of periodic lines.

Null, empty and blank texts, and documents of other sources, are no cases; null doc_ids have no row; rows of one doc_id
count once. Names listed by the audit are reported, but decide nothing. Extra columns are ignored.
"""
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corpusmill.llm.common import checkpoints, table
from corpusmill.llm.neardup import minima_parameters, mixed, shingles, signature

COMMENT = re.compile(r"(?m)^[ \t]*(?://|#(?!\s*(?:include|define|if|ifdef|ifndef|endif|pragma)\b)|/\*|\*|--).*$")
STRING = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|`[^`$]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")
PLAIN = re.compile(r"\"\"\"[\s\S]*\"\"\"|'''[\s\S]*'''|\"[^\"\n$#{}]*\"|'[^\n]*'")  # no value is put into it
IDENTIFIER = re.compile(r"[^\W\d]\w*")
NUMBER = re.compile(r"(?<!\w)\d[\w.]*")
SPACE = re.compile(r"[ \t\r\f\v]+")
GENERATED = re.compile(r"(?im)^\W*(?:(?:this file is |code |source )?(?:auto-?generated|machine-(?:written|generated|made))\b|<auto-?generated|@generated\b|(?:this (?:file|code) (?:is|was) |code |file )?(?:generated|produced|emitted|created|built|written) (?:automatically )?(?:by|from|with) (?!hand\b|the (?:caller|user))[\w./-]*\s?\S*.*(?:do not|don.t|changes|edit|lost|overwritten|regenerate|every build)|fichier (?:produit|généré) automatiquement|(?:datei )?automatisch (?:erzeugt|generiert)|(?:archivo |código )?generado automáticamente)|\bdo not edit\b\W*$")
VENDORED = re.compile(r"(?im)^\W*(?:vendored from \S|(?:copied|taken) (?:verbatim )?from \S.*\d|(?:this is a )?(?:local |verbatim )?(?:copy|snapshot) of \S+ .*\d|imported from the \S+ tree\b|\S+ v\d[\w.]* - https?://\S+ - (?:bundled|included) with)")
VENDOR_PATH = re.compile(r"(?i)(?:^|/)(?:third[_-]?party|node_modules|pods|deps|external|ext|_?vendor|vendored|bower_components|contrib/upstream)/")
MIN_REPEATS, PERIODIC, LITERAL, SHORT = 8, 0.6, 0.7, 0.5
MINIMA, WIDTH, RAW = 96, 24, 64
FORM, SAME, OTHER = 0.75, 0.7, 0.5


def masked(text):
    """(masked code, share of literals, share of one-letter identifiers, mean line length) of the code outside comment lines."""
    code = COMMENT.sub("", text)
    total = sum(map(len, code.split()))
    without = NUMBER.sub("0", STRING.sub(lambda m: "\x01" if PLAIN.fullmatch(m[0]) else m[0], code))
    literal = 1 - sum(map(len, without.split())) / max(1, total)
    names = IDENTIFIER.findall(without)
    short = sum(len(w) == 1 for w in names) / max(1, len(names))
    out = SPACE.sub("", IDENTIFIER.sub("a", without))
    lines = [x for x in code.split("\n") if x.strip()]
    return "\n".join(x for x in out.split("\n") if x), literal, short, total / max(1, len(lines))


def periodic(lines):
    """The share of lines in the longest stretch that repeats with a period of up to six lines, at least MIN_REPEATS times."""
    seen = {}
    a = np.array([seen.setdefault(x, len(seen)) for x in lines])
    best = 0
    for p in range(1, min(7, len(a))):
        same = np.flatnonzero(a[p:] != a[:-p])
        run = int(np.diff(np.r_[-1, same, len(a) - p]).max()) - 1
        if run >= (MIN_REPEATS - 1) * p:
            best = max(best, run + p)
    return best / max(1, len(a))


def comments(text):
    """The comment lines: banners stand at the top or at the end of a file."""
    return "\n".join(m[0] for m in COMMENT.finditer(text))


def facts(docs):
    """One row a source file: what it shows by itself, and its signatures."""

    def run(batches):
        a, b = minima_parameters(MINIMA)
        cache = {}
        for batch in batches:
            out = []
            for i, repo, path, text in zip(batch.doc_id, batch.repo_id, batch.path, batch.text):
                if not text.strip():
                    continue
                code, literal, short, width = masked(text)
                head = comments(text)
                tokens = len(code)
                points = np.frombuffer(code.replace("\n", "").encode("utf-32-le"), np.uint32).astype(np.uint64)
                n = len(points) - WIDTH + 1
                if n > 0:
                    x = np.zeros(n, np.uint64)
                    for k in range(WIDTH):
                        x = x * np.uint64(0x9E3779B97F4A7C15) + points[k : k + n]
                    sig = signature(np.unique(mixed(x)), a, b).tobytes()
                    raw = shingles(text, cache)
                    raw = signature(raw, a[:RAW], b[:RAW]).tobytes() if len(raw) else None
                else:
                    sig, raw = None, None
                out.append((i, None if pd.isna(repo) else int(repo), bool(GENERATED.search(head)), bool(VENDORED.search(head)) or bool(path) and bool(VENDOR_PATH.search(path)), short >= SHORT and width >= 80 and tokens >= 60, literal >= LITERAL and tokens > 0, literal, periodic(code.split("\n")), sig, raw))
            frame = pd.DataFrame(out, columns=["doc_id", "repo_id", "banner", "vendor", "minified", "blob", "literal", "periodic", "sig", "raw"])
            yield frame.astype({"repo_id": "Int64"})

    rows = docs.where("source = 'tarball' and doc_id is not null and text is not null").select("doc_id", "repo_id", "path", "text")
    return rows.mapInPandas(run, "doc_id long, repo_id long, banner boolean, vendor boolean, minified boolean, blob boolean, literal double, periodic double, sig binary, raw binary")


def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0.0 if x is None or y is None else float((np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).mean()) for x, y in zip(a, b)], dtype=float)


def band_keys(column, minima, threshold, *also):
    """Hashes of the bands of a signature, one more than places that may differ at the threshold: signatures that meet it share a key."""
    n = minima - int(np.ceil(minima * threshold)) + 1
    at = [minima * k // n for k in range(n + 1)]
    return F.array(*[F.xxhash64(F.lit(k), F.substring(column, 4 * x + 1, 4 * (y - x)), *also) for k, (x, y) in enumerate(zip(at, at[1:]))])


def alike(rows, keys, kept):
    """rows (id, sig, raw), equal ones under one id, to (id, other), both ways: the pairs that share a key and are kept by their agreement in form and raw shingles (same)."""
    of = rows.select("id", F.explode(keys).alias("key")).distinct()
    pairs = of.join(of.withColumnRenamed("id", "other"), "key").where("id < other").select("id", "other").distinct()
    side = rows.select("id", "sig", "raw").dropDuplicates(["id"])
    pairs = pairs.join(side, "id").join(side.select(F.col("id").alias("other"), F.col("sig").alias("o_sig"), F.col("raw").alias("o_raw")), "other")
    agree = F.pandas_udf(agreement, "double")
    pairs = pairs.withColumn("form", agree("sig", "o_sig")).where(F.col("form") >= FORM).withColumn("same", agree("raw", "o_raw")).where(kept).select("id", "other")
    return pairs.unionByName(pairs.select(F.col("other").alias("id"), F.col("id").alias("other")))


def copies(rows):
    """Files whose form and raw shingles agree with a file of another repository."""
    rows = rows.where("raw is not null").withColumn("id", F.xxhash64("sig", "raw"))
    own = rows.groupBy("id").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi"))
    near = alike(rows, band_keys("raw", RAW, SAME), F.col("same") >= SAME).join(own.withColumnRenamed("id", "other"), "other").select("id", "lo", "hi")
    near = near.unionByName(own).groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return rows.select("doc_id", "repo", "id").join(near, "id").where("lo <> repo or hi <> repo").select("doc_id")


def families(rows):
    """Files that repeat a line form and agree in form, but not in raw shingles, with another such file of their repository."""
    rows = rows.where("periodic >= 0.4").withColumn("id", F.xxhash64("repo", "sig", "raw"))
    bare = rows.where("raw is null").groupBy("id").agg(F.countDistinct("doc_id").alias("n")).where("n > 1").select("id")
    linked = alike(rows, band_keys("sig", MINIMA, FORM, "repo"), F.col("same") < OTHER).select("id")
    return rows.select("doc_id", "id").join(linked.unionByName(bare), "id", "left_semi").select("doc_id")


def literals(rows):
    """Files of literals that agree in form with another such file."""
    rows = rows.where("literal >= 0.6").withColumn("id", F.xxhash64("sig"))
    equal = rows.groupBy("id").agg(F.countDistinct("doc_id").alias("n")).where("n > 1").select("id")
    linked = alike(rows, band_keys("sig", MINIMA, FORM), F.lit(True)).select("id")
    return rows.select("doc_id", "id").join(linked.unionByName(equal), "id", "left_semi").select("doc_id")


def classes(docs):
    """(doc_id, generated, minified, vendored, blob) of every source file with a text."""
    checkpoints(docs.sparkSession)
    f = facts(docs).checkpoint()
    rows = f.where("sig is not null").select("doc_id", F.coalesce("repo_id", F.lit(-1)).alias("repo"), "sig", "raw", "literal", "periodic")
    links = None
    for name, found in (("copy", copies(rows)), ("family", families(rows)), ("literals", literals(rows))):
        found = found.select("doc_id", *[F.lit(name == x).alias(x) for x in ("copy", "family", "literals")])
        links = found if links is None else links.unionByName(found)
    links = links.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("copy", "family", "literals")])
    no = F.lit(False)
    got = f.join(links, "doc_id", "left")
    return got.groupBy("doc_id").agg(
        F.max(F.col("banner") | (F.col("periodic") >= PERIODIC) & ~F.col("blob") | F.coalesce("family", no)).alias("generated"),
        F.max("minified").alias("minified"),
        F.max(F.col("vendor") | F.coalesce("copy", no)).alias("vendored"),
        F.max(F.col("blob") | F.coalesce("literals", no)).alias("blob"),
    )


def p1_found(spark, d):
    return classes(table(spark, d, "documents")).where("generated or minified or vendored or blob").select("doc_id")


def p1_classes(spark, d):
    """(doc_id, generated, minified, vendored, blob, suspect): the classes of every source file, and whether the audit lists its directory or a word of its name."""
    docs, suspects = table(spark, d, "documents"), table(spark, d, "suspects")
    names = suspects.where("name is not null").select("kind", F.lower("name").alias("name")).distinct()
    parts = F.split(F.lower("path"), "/")
    own = docs.where("source = 'tarball' and doc_id is not null").select("doc_id", F.explode(F.concat(
        F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.struct(F.lit("directory").alias("kind"), x.alias("name"))),
        F.transform(F.split(F.element_at(parts, -1), "[^a-z0-9]+"), lambda x: F.struct(F.lit("file").alias("kind"), x.alias("name"))))).alias("p"))
    listed = own.select("doc_id", "p.*").join(names, ["kind", "name"], "left_semi").select("doc_id").distinct().withColumn("suspect", F.lit(True))
    return classes(docs).join(listed, "doc_id", "left").withColumn("suspect", F.coalesce("suspect", F.lit(False)))


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes}
