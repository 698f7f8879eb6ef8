"""Reading code and changelogs: scopes, definitions, outlines, imports, releases. Each runs inside Arrow batches, one text at a time; what crosses files is a join. Null texts and languages have no rows."""
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusmill.functions import changelog as L, code as C, paths as P
from corpusmill.operators import search
from corpusmill.operators.core import read


def sources(spark, d) -> DataFrame:
    """Source documents with the canonical language, or the one of the path."""
    language = F.coalesce(P.canonical_language(F.col("language")), P.language_of(F.col("path")))
    return read(spark, d, "documents").where("source = 'tarball' and text is not null and doc_id is not null").select("doc_id", "repo_id", "path", language.alias("language"), "text").where("language is not null")


def each(docs: DataFrame, function, schema: str) -> DataFrame:
    """Rows of function(lines, language, path) for each document, with its doc_id."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches):
        for b in batches:
            out = []
            for i, path, language, text in zip(b.doc_id, b.path, b.language, b.text):
                lines = [x.removesuffix("\r") for x in text.split("\n")]
                out += [(i, *r) for r in function(lines, language, path or "")]
            yield pd.DataFrame(out, columns=["doc_id", *names])

    return docs.select("doc_id", "path", "language", "text").mapInPandas(run, f"doc_id long, {schema}")


def comment_lines(spark, d):
    """How many lines of each source file are comments or docstrings, and how many are code."""
    def count(lines, language, path):
        mask = C.prose(lines, language)
        blank = sum(not x.strip() for x in lines)
        return [(sum(mask), len(lines) - sum(mask) - sum(not x.strip() and not m for x, m in zip(lines, mask)), blank)]

    return each(sources(spark, d), count, "comments int, code int, blank int")


def outlines(spark, d):
    def rows(lines, language, path):
        return [(i + 1, lines[i].strip()[: C.SCOPE_WIDTH], C.declared(lines[i]) or C.method(lines[i])) for i in C.outline(lines, language, bool(pd.Series([path]).str.contains("test|spec", case=False)[0]))]

    return each(sources(spark, d), rows, "line_no int, line string, name string")


def declarations(spark, d):
    """Every declaration of the corpus with its block."""
    def rows(lines, language, path):
        mask = C.prose(lines, language)
        return [(name, i + 1, C.block_end(lines, i, language) + 1) for i, x in enumerate(lines) if not mask[i] and (name := C.declared(x) or C.method(x))]

    return each(sources(spark, d), rows, "name string, first_line int, last_line int")


def hit_scopes(spark, d):
    """Search hits outside comments with the declaration that encloses them."""
    docs = sources(spark, d)
    hits = search.search(docs, search.PATTERN).groupBy("doc_id").agg(F.collect_list("line_no").alias("hits"))

    def run(batches):
        for b in batches:
            out = []
            for i, language, text, numbers in zip(b.doc_id, b.language, b.text, b.hits):
                lines = [x.removesuffix("\r") for x in text.split("\n")]
                mask = C.prose(lines, language)
                out += [(i, int(n), C.scope(lines, n - 1)) for n in sorted(numbers) if not mask[n - 1]]
            yield pd.DataFrame(out, columns=["doc_id", "line_no", "scope"])

    return docs.join(hits, "doc_id").select("doc_id", "language", "text", "hits").mapInPandas(run, "doc_id long, line_no int, scope string")


def blocks_of(docs, symbols):
    """(doc_id, symbol, first_line, last_line, body) of the declarations of these symbols."""
    def rows(lines, language, path):
        return [(s, a + 1, z + 1, "\n".join(lines[a : z + 1])) for s in symbols for a, z in C.definitions(lines, s, language)]

    holds = F.lit(False)
    for s in symbols:
        holds |= F.contains("text", F.lit(s))
    return each(docs.where(holds), rows, "symbol string, first_line int, last_line int, body string")


def defined_blocks(spark, d):
    """The bodies of the five names declared most often."""
    top = declarations(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(5).collect()
    return blocks_of(sources(spark, d), [r.name for r in top])


def imported(spark, d):
    def rows(lines, language, path):
        return [(name, module, "|".join(C.module_paths(module, path, language))) for name, module in C.imports(lines, language)]

    return each(sources(spark, d), rows, "name string, module string, paths string")


def import_targets(spark, d):
    """Relative imports with the file of the same repository they mean: the first of their paths that exists."""
    docs = sources(spark, d)
    own = docs.select("doc_id", "repo_id")
    tried = imported(spark, d).where("paths <> ''").join(own, "doc_id").select("doc_id", "repo_id", "name", F.posexplode(F.split("paths", r"\|")).alias("rank", "path"))
    there = docs.select("repo_id", "path", F.col("doc_id").alias("target")).dropDuplicates(["repo_id", "path"])
    return tried.join(there, ["repo_id", "path"]).groupBy("doc_id", "name").agg(F.min_by("target", "rank").alias("target"), F.min_by("path", "rank").alias("path"))


def helpers(spark, d):
    """For each file and declaration of it, the other declarations of the same file that its body names."""
    def rows(lines, language, path):
        mask = C.prose(lines, language)
        names = {}
        for i, x in enumerate(lines):
            name = None if mask[i] else C.declared(x)
            if name:
                names.setdefault(name, (i, C.block_end(lines, i, language)))
        return [(n, m) for n, (a, z) in names.items() for m in C.identifiers("\n".join(lines[a + 1 : z + 1])) if m in names and m != n]

    return each(sources(spark, d), rows, "name string, uses string")


def changelogs(spark, d) -> DataFrame:
    return read(spark, d, "documents").where("source = 'changelog' and text is not null and doc_id is not null").select("doc_id", "repo_id", F.col("path"), F.lit("markdown").alias("language"), "text")


def changelog_releases(spark, d):
    """Every release of every changelog, in order."""
    def rows(lines, language, path):
        return [(n, v, t, a + 1, z + 1) for n, (v, t, a, z) in enumerate(L.releases("\n".join(lines)))]

    return each(changelogs(spark, d), rows, "number int, version string, title string, first_line int, last_line int")


def latest_releases(spark, d):
    def rows(lines, language, path):
        text = "\n".join(lines)
        r = L.latest(text, L.releases(text))
        return [(r[0], "\n".join(s for x in lines[r[2] + 1 : r[3] + 1] if (s := L.summary(x))))] if r else []

    return each(changelogs(spark, d), rows, "version string, summary string")


def manifest_versions(spark, d):
    """The version a root manifest declares: of at most 64 characters, starting with a digit, not 0.0.0."""
    files = read(spark, d, "prepared_files").where("path in ('package.json', 'Cargo.toml', 'pyproject.toml') and content is not null and file_id is not null")
    section = F.regexp_extract("content", r"(?ms)^\[(?:package|workspace\.package|project|tool\.poetry)\]\s*$(.*?)(?=^\[|\z)", 1)
    version = F.when(F.col("path") == "package.json", F.get_json_object("content", "$.version")).otherwise(F.regexp_extract(section, r'(?m)^version\s*=\s*"([^"]*)"', 1))
    usable = F.length("version").between(1, 64) & (F.col("version") != "0.0.0") & F.col("version").rlike("^[0-9]")
    return files.withColumn("version", version).where(usable).select("file_id", "repo_id", "version").distinct()


QUERIES = {f.__name__: f for f in (comment_lines, outlines, declarations, hit_scopes, defined_blocks, imported, import_targets, helpers, changelog_releases, latest_releases, manifest_versions)}
SQL = {
    "manifest_versions": "SELECT DISTINCT file_id, repo_id, version FROM (SELECT file_id, repo_id, CASE WHEN path = 'package.json' THEN json_extract_string(content, '$.version') ELSE regexp_extract(content, '(?ms)^\\[(?:package|workspace\\.package|project|tool\\.poetry)\\]\\s*$[^\\[]*?^version\\s*=\\s*\"([^\"]*)\"', 1) END AS version FROM prepared_files WHERE path IN ('package.json', 'Cargo.toml', 'pyproject.toml') AND content IS NOT NULL AND file_id IS NOT NULL) WHERE len(version) BETWEEN 1 AND 64 AND version <> '0.0.0' AND regexp_matches(version, '^[0-9]')",
}
