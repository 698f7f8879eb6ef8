"""Filters over stored files, with a query for each."""
from pyspark.sql import functions as F

from corpusmill.functions import paths as P
from corpusmill.operators.core import read


def language_of_paths(spark, d):
    return read(spark, d, "documents").select("doc_id", P.language_of(F.col("path")).alias("language"))


def canonical_languages(spark, d):
    return read(spark, d, "documents").select("doc_id", P.canonical_language(F.col("language")).alias("language"))


def should_index_paths(spark, d):
    path, size = F.col("path"), F.col("raw_size")
    return read(spark, d, "documents").select("doc_id", P.should_index(path, size).alias("kept"), P.should_index(path, size, True).alias("kept_with_tests"))


def test_directories(spark, d):
    """Directory names of all paths that name a test suite, with their files."""
    seg = F.explode(P.directories(F.col("path"))).alias("segment")
    return read(spark, d, "documents").select(seg).groupBy("segment").agg(F.count(F.lit(1)).alias("files")).where(P.is_test_directory(F.col("segment")))


def test_paths(spark, d):
    return read(spark, d, "documents").select("doc_id", F.coalesce(P.is_test_path(F.col("path")), F.lit(False)).alias("is_test"))


def hidden_chars(spark, d):
    return read(spark, d, "documents").select("doc_id", P.has_hidden_text(F.col("text")).alias("hidden"), P.is_binary(F.col("text")).alias("binary"))


GLOBS = {"path_glob_directory": "core", "path_glob_any_depth": "**/query/*.py", "path_glob_prefix": "lib/**/?*_*.py", "path_glob_suffix": "*.rs"}


def glob_query(value):
    def query(spark, d):
        return read(spark, d, "documents").where(P.matches_glob(F.col("path"), P.path_filter(value))).select("doc_id", "path")

    return query


def refiltered(spark, d):
    """What a rule change keeps: indexable documents, and repositories that still have one."""
    kept = read(spark, d, "documents").where(P.should_index(F.col("path"), F.col("raw_size"))).groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"))
    return read(spark, d, "repos").select("repo_id", "name").join(kept, "repo_id")


def segment_words(spark, d):
    """The words of the file names' stems, and the first suspect one."""
    name = P.stem(P.file_name(F.col("path")))
    return read(spark, d, "documents").select("doc_id", F.array_join(P.words(name), " ").alias("words"), P.suspect_word(name).alias("suspect"))


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _map(mapping):
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in mapping.items()) + "}"


NAME, DIRS = "string_split(path, '/')[-1]", "string_split(path, '/')[:-2]"
LANGUAGE = f"{_map(P.EXTENSIONS)}[CASE WHEN contains(path, '.') THEN lower(string_split(path, '.')[-1]) END]"
KEEP = f"raw_size BETWEEN {P.LEAST} AND {P.MOST} AND {LANGUAGE} IS NOT NULL AND len(list_filter({DIRS}, lambda x: list_contains({_list(P.SKIP_DIRECTORIES)}, lower(x)))) = 0 AND NOT regexp_matches(path, '(^|/)\\.') AND NOT regexp_matches(lower({NAME}), '{P.quoted(P.SKIP_NAMES)}')"
BARE = "regexp_replace(lower({}), '^_+|_+$', '', 'g')"
TESTS = f"NOT regexp_matches(lower({NAME}), '{P.quoted(P.TEST_NAMES)}') AND NOT regexp_matches(regexp_replace({NAME}, '\\.[^.]*$', ''), 'Tests?$') AND len(list_filter({DIRS}, lambda x: regexp_matches({BARE.format('x')}, '{P.TEST_DIRECTORY}'))) = 0"
WORDS = f"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({NAME}, '\\.[^.]*$', ''), '([\\p{{Ll}}0-9])(\\p{{Lu}})', '\\1_\\2', 'g')), '[_.-]+'), lambda w: w <> '')"

QUERIES = {f.__name__: f for f in (language_of_paths, canonical_languages, should_index_paths, test_directories, test_paths, hidden_chars, refiltered, segment_words)} | {k: glob_query(v) for k, v in GLOBS.items()}
SQL = {
    "language_of_paths": f"SELECT doc_id, {LANGUAGE} AS language FROM documents",
    "canonical_languages": f"SELECT doc_id, coalesce({_map(P.ALIASES)}[lower(trim(language))], lower(trim(language))) AS language FROM documents",
    "should_index_paths": f"SELECT doc_id, coalesce({KEEP} AND {TESTS}, false) AS kept, coalesce({KEEP}, false) AS kept_with_tests FROM documents",
    "test_directories": f"SELECT segment, count(*) AS files FROM (SELECT unnest({DIRS}) AS segment FROM documents) WHERE regexp_matches({BARE.format('segment')}, '{P.TEST_DIRECTORY}') GROUP BY segment",
    "test_paths": "SELECT doc_id, coalesce(regexp_matches(lower(path), 'test|spec'), false) AS is_test FROM documents",
    "hidden_chars": f"SELECT doc_id, coalesce(regexp_matches(text, '{P.HOSTILE}') OR len(regexp_extract_all(text, '{P.INVISIBLE}')) > {P.INVISIBLE_MOST}, false) AS hidden, coalesce(contains(text, chr(0)) AND strlen(split_part(text, chr(0), 1)) < 8192, false) AS binary FROM documents",
    "refiltered": f"SELECT r.repo_id, r.name, k.files FROM repos r JOIN (SELECT repo_id, count(*) AS files FROM documents WHERE {KEEP} AND {TESTS} GROUP BY repo_id) k ON k.repo_id = r.repo_id",
    "segment_words": f"SELECT doc_id, array_to_string({WORDS}, ' ') AS words, list_filter({WORDS}, lambda w: list_contains({_list(P.SUSPECT_WORDS)}, w))[1] AS suspect FROM documents",
    "path_glob_directory": "SELECT doc_id, path FROM documents WHERE path LIKE 'core/%' OR path = 'core'",
    "path_glob_any_depth": "SELECT doc_id, path FROM documents WHERE (path LIKE '%/query/%.py' OR path LIKE 'query/%.py')",
    "path_glob_prefix": "SELECT doc_id, path FROM documents WHERE path LIKE 'lib/%_\\_%.py' ESCAPE '\\'",
    "path_glob_suffix": "SELECT doc_id, path FROM documents WHERE path LIKE '%.rs'",
}
