"""Search: lines of stored files that match a pattern, narrowed by the trigram index, ranked and spread over repositories.

Texts and lines are matched by the JVM's expressions; a literal that every match needs is a cheaper predicate before them,
and through the index a semi-join that keeps most texts from being read. Null texts and paths match nothing.
"""
from pyspark.sql import DataFrame, Window as W, functions as F

from corpusmill.functions import patterns as R
from corpusmill.operators import index
from corpusmill.operators.core import read

BUDGET = 20_000  # fixed value: candidates looked at where nothing narrows a search
PATTERN = r"(return|defer)\s+\w+Encoder|read_parser\w*\("


def narrowed(docs: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """docs with the literals that a branch of the pattern needs; all docs if a branch needs none."""
    runs = [R.literal_runs(b) for b in R.alternatives(pattern)]
    if ignore_case or R.has_case_flag(pattern) or not all(runs):
        return docs
    keep = F.lit(False)
    for r in runs:
        one = F.lit(True)
        for literal in r:
            one &= F.contains("text", F.lit(literal))
        keep |= one
    return docs.where(keep)


def candidates(pairs: DataFrame, pattern: str, stop: DataFrame | None = None, ignore_case: bool = False):
    """(doc_id) of documents with the grams of a branch, or None if a branch has none to narrow by. pairs: (doc_id, gram) of the index; grams in stop are not in it and are passed over."""
    out = None
    for branch in R.alternatives(pattern):
        wanted = sorted({g for run in R.literal_runs(branch) for g in R.byte_grams(run)})
        sets = [R.case_variants(g) if ignore_case or R.has_case_flag(pattern) else [g] for g in wanted]
        sets = [s for s in sets if s]
        if stop is not None and sets:
            stopped = {r.gram for r in stop.where(F.col("gram").isin(sorted({g for s in sets for g in s}))).collect()}  # at most the pattern's grams
            sets = [s for s in sets if not stopped & set(s)]
        if not sets:
            return None
        of = F.create_map(*[F.lit(x) for i, s in enumerate(sets) for g in s for x in (g, i)]) if len({g for s in sets for g in s}) == sum(map(len, sets)) else None
        if of is not None:
            hit = pairs.where(F.col("gram").isin(sorted({g for s in sets for g in s}))).select("doc_id", of[F.col("gram")].alias("i")).distinct()
            one = hit.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(sets)).select("doc_id")
        else:  # variants that overlap: one semi-join a gram
            one = pairs.select("doc_id").distinct()
            for s in sets:
                one = one.join(pairs.where(F.col("gram").isin(s)).select("doc_id").distinct(), "doc_id", "left_semi")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def lines(docs: DataFrame) -> DataFrame:
    """One row a line, numbered from 1, without line ends."""
    parts = F.split("text", "\n")
    return docs.where("text is not null").select("doc_id", "repo_id", "path", F.posexplode(parts).alias("i", "raw"), parts.alias("all")).select("doc_id", "repo_id", "path", (F.col("i") + 1).alias("line_no"), F.regexp_replace("raw", "\r$", "").alias("line"), "all")


def search(docs: DataFrame, pattern: str, ignore_case: bool = False, fixed: bool = False) -> DataFrame:
    """(doc_id, repo_id, path, line_no, line) of every matching line."""
    if fixed:
        return lines(docs.where(F.contains("text", F.lit(pattern)))).drop("all").where(F.contains("line", F.lit(pattern)))
    regex = ("(?iu)" if ignore_case else "") + R.checked(pattern)
    if R.needs_line_break(pattern):
        return lines(docs.limit(0)).drop("all")
    kept = narrowed(docs, pattern, ignore_case).where(F.col("text").rlike("(?m)" + regex))
    return lines(kept).drop("all").where(F.col("line").rlike(regex))


def ranked(hits: DataFrame, limit: int, per_repo: int | None = None) -> DataFrame:
    """The limit best hits: within a repository by relevance, repositories by their best, one after another in turns."""
    scored = hits.withColumn("relevance", R.relevance(F.col("line"), F.coalesce("path", F.lit(""))))
    own = W.partitionBy("repo_id").orderBy(F.desc("relevance"), "doc_id", "line_no")
    scored = scored.withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= (per_repo or limit))  # a window-group limit: each task keeps that many a repository
    first = scored.where("turn = 1").select("repo_id", F.col("relevance").alias("best"), F.col("doc_id").alias("first_doc"))
    got = scored.join(first, scored.repo_id.eqNullSafe(first.repo_id)).drop(first.repo_id)
    return got.orderBy("turn", F.desc("best"), "first_doc").limit(limit).select("repo_id", "doc_id", "path", "line_no", "line", "relevance", "turn")


def spread(docs: DataFrame, budget: int) -> DataFrame:
    """Candidates in fair order: the first of each repository, then the second, up to the budget; a repository's share is twice an even one."""
    repos = docs.select("repo_id").distinct().count()
    share = (budget // max(repos, 1) + 1) * 2
    turn = F.row_number().over(W.partitionBy("repo_id").orderBy("doc_id"))
    return docs.select("repo_id", "doc_id").withColumn("turn", turn).where(F.col("turn") <= share).orderBy("turn", "repo_id").limit(budget)


def collapsed(hits: DataFrame, around: int) -> DataFrame:
    """Hits whose line isn't in the context of the hit kept before them in the file."""
    numbers = hits.groupBy("doc_id").agg(F.array_sort(F.collect_list("line_no")).alias("n"))  # a file's own lines
    fold = F.aggregate("n", F.array().cast("array<int>"), lambda kept, x: F.when((F.size(kept) == 0) | (x > F.element_at(kept, -1) + around), F.concat(kept, F.array(x))).otherwise(kept)) if around else F.col("n")
    return numbers.select("doc_id", F.explode(fold).alias("line_no"))


def search_lines(spark, d):
    return search(read(spark, d, "documents"), PATTERN)


def search_ignore_case(spark, d):
    return search(read(spark, d, "documents"), r"ENCODER\w*\(", ignore_case=True).select("doc_id", "line_no")


def search_fixed(spark, d):
    return search(read(spark, d, "documents"), "[i] ", fixed=True).select("doc_id", "line_no")


def search_anchored(spark, d):
    """Anchors hold for lines, with CRLF or LF."""
    return search(read(spark, d, "documents"), r"^\s*return -1;$").select("doc_id", "line_no")


def search_scope(spark, d):
    """A search within a language, a path and repositories with a tag."""
    docs = read(spark, d, "documents").where("language = 'go' and path like '%e%'")
    repos = read(spark, d, "repos").where(F.array_contains("tags", "cli")).select("repo_id")
    return search(docs.join(repos, "repo_id", "left_semi"), "return").select("doc_id", "line_no")


def search_ranked(spark, d):
    return ranked(search(read(spark, d, "documents"), r"\w+Encoder\("), 30, 3)


def search_more(spark, d):
    """Whether there are more hits than the limit, and how many repositories they are in."""
    hits = search(read(spark, d, "documents"), r"\w+Encoder\(")
    return hits.agg((F.count(F.lit(1)) > 30).alias("more"), F.countDistinct("repo_id").alias("repos"))


def search_files(spark, d):
    """Hits a file, with their lines in order."""
    return search(read(spark, d, "documents"), PATTERN).groupBy("doc_id", "path").agg(F.count(F.lit(1)).alias("hits"), F.array_join(F.array_sort(F.collect_list("line_no")), ",").alias("lines"))


def search_context(spark, d):
    """Each hit with two lines before and after, as far as the file has them."""
    hits = lines(narrowed(read(spark, d, "documents"), PATTERN)).where(F.col("line").rlike(PATTERN))
    low = F.greatest(F.col("line_no") - 2, F.lit(1))
    high = F.least(F.col("line_no") + 2, F.size("all"))
    return hits.select("doc_id", "line_no", low.alias("first_line"), F.array_join(F.slice("all", low, high - low + 1), "\n").alias("context"))


def search_collapsed(spark, d):
    return collapsed(search(read(spark, d, "documents"), "return"), 2)


def search_prose(spark, d):
    """Matching lines that are comments or lone strings."""
    return search(read(spark, d, "documents"), "Encoder").where(F.col("line").rlike(R.PROSE)).select("doc_id", "line_no")


def narrowed_search(spark, d):
    """The search through the index: candidates by trigrams outside the stop list, then the same matching."""
    docs = read(spark, d, "documents")
    pairs, n = index.grams(docs), docs.count()
    stop = index.stop_list(index.frequencies(pairs), n)
    ids = candidates(pairs.join(stop, "gram", "left_anti"), PATTERN, stop)
    return search(docs if ids is None else docs.join(ids, "doc_id", "left_semi"), PATTERN)


def candidate_spread(spark, d):
    return spread(read(spark, d, "documents").where("repo_id is not null"), 400)


def define_symbol(spark, d):
    """Lines that define some symbols: definitions only, without bindings, imports and mentions in strings."""
    docs, out = read(spark, d, "documents"), None
    for symbol in ("applySeries", "readParser", "read_parser", "cursorPool"):
        hits = search(docs, R.definition(symbol)).where(~R.binds_only(F.col("line"), symbol))
        hits = hits.select(F.lit(symbol).alias("symbol"), "doc_id", "line_no", "line")
        out = hits if out is None else out.unionByName(hits)
    return out


def reference_counts(spark, d):
    """How often some names occur as whole words, at most a line each."""
    docs, out = read(spark, d, "documents"), None
    for symbol in ("gateLoop", "index_loop", "nosuchname"):
        hits = search(docs, rf"\b{symbol}\b").agg(F.count(F.lit(1)).alias("lines")).select(F.lit(symbol).alias("symbol"), "lines")
        out = hits if out is None else out.unionByName(hits)
    return out


def token_budget(spark, d):
    """The longest start of the ranked hits whose estimated tokens stay within 200; always the first."""
    hits = ranked(search(read(spark, d, "documents"), r"\w+Encoder\("), 60, 60).withColumn("tokens", R.estimated_tokens(F.col("line")))
    upto = F.sum("tokens").over(W.orderBy("turn", F.desc("relevance"), "doc_id", "line_no").rowsBetween(W.unboundedPreceding, 0))  # at most 60 rows
    return hits.withColumn("upto", upto).where("upto <= 200 or upto = tokens").select("doc_id", "line_no", "tokens", "upto")


MISSED = r"applySeriesOnTheMoon|writeNothingAtAll"


def diagnosis(spark, d):
    """Why a pattern finds nothing: for each literal it needs whether it occurs, and its longest start that does (at least six characters and 60 %)."""
    docs = read(spark, d, "documents")
    out = None
    for literal in sorted({r for b in R.alternatives(MISSED) for r in R.literal_runs(b)}, key=lambda x: (-len(x), x))[:3]:
        least = max(6, int(0.6 * len(literal)))
        starts = [literal[:n] for n in range(least, len(literal) + 1)]
        got = docs.agg(*[F.coalesce(F.max(F.contains("text", F.lit(s))), F.lit(False)).alias(f"p{len(s)}") for s in starts])
        near = F.coalesce(*[F.when(F.col(f"p{len(s)}"), F.lit(s)) for s in reversed(starts[:-1])])
        row = got.select(F.lit(literal).alias("literal"), F.col(f"p{len(literal)}").alias("known"), near.alias("nearest"))
        out = row if out is None else out.unionByName(row)
    return out


LINES = "SELECT doc_id, repo_id, path, unnest(l) AS line0, generate_subscripts(l, 1) AS line_no, l FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)"
HITS = f"SELECT doc_id, repo_id, path, CAST(line_no AS INT) AS line_no, line, l FROM (SELECT *, regexp_replace(line0, chr(13) || '$', '') AS line FROM ({LINES}))"


def _starts(words):
    return "'^(" + "|".join(w.replace("(", "\\(") for w in words) + ")'"


SCORED = f"SELECT *, greatest(0, greatest(0, {R.BASE} + CASE WHEN regexp_matches(ltrim(line), {_starts(R.DEFINING)}) OR regexp_matches(ltrim(line), '{R.FUNCTION_BINDING}') THEN {R.DEFINES} ELSE 0 END - CASE WHEN regexp_matches(ltrim(line), {_starts(R.NAMING)}) THEN {R.NAMES} ELSE 0 END) + {R.SHORT} - least(strlen(line), {R.SHORT}) - CASE WHEN regexp_matches(path, 'test|spec') THEN {R.TEST} ELSE 0 END) AS relevance FROM ({HITS}) WHERE regexp_matches(line, '\\w+Encoder\\(')"


def _ranked(limit, per_repo):
    turns = f"SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY relevance DESC, doc_id, line_no) AS turn FROM ({SCORED})"
    return f"SELECT repo_id, doc_id, path, line_no, line, CAST(relevance AS INT) AS relevance, CAST(turn AS INT) AS turn FROM (SELECT *, max(relevance) OVER (PARTITION BY repo_id) AS best, min(CASE WHEN turn = 1 THEN doc_id END) OVER (PARTITION BY repo_id) AS first_doc FROM ({turns})) WHERE turn <= {per_repo} ORDER BY turn, best DESC, first_doc LIMIT {limit}"


QUERIES = {f.__name__: f for f in (search_lines, search_ignore_case, search_fixed, search_anchored, search_scope, search_ranked, search_more, search_files, search_context, search_collapsed, search_prose, narrowed_search, candidate_spread, define_symbol, reference_counts, token_budget, diagnosis)}
FOUND = f"SELECT doc_id, repo_id, path, line_no, line FROM ({HITS}) WHERE regexp_matches(line, '{PATTERN}')"
SQL = {
    "search_lines": FOUND,
    "narrowed_search": FOUND,
    "search_ignore_case": f"SELECT doc_id, line_no FROM ({HITS}) WHERE regexp_matches(line, '(?i)ENCODER\\w*\\(')",
    "search_fixed": f"SELECT doc_id, line_no FROM ({HITS}) WHERE contains(line, '[i] ')",
    "search_anchored": f"SELECT doc_id, line_no FROM ({HITS}) WHERE regexp_matches(line, '^\\s*return -1;$')",
    "search_scope": f"SELECT doc_id, line_no FROM ({HITS}) WHERE contains(line, 'return') AND doc_id IN (SELECT doc_id FROM documents WHERE language = 'go' AND path LIKE '%e%' AND repo_id IN (SELECT repo_id FROM repos WHERE list_contains(tags, 'cli')))",
    "search_ranked": _ranked(30, 3),
    "search_more": f"SELECT count(*) > 30 AS more, count(DISTINCT repo_id) AS repos FROM ({SCORED})",
    "search_files": f"SELECT doc_id, path, count(*) AS hits, string_agg(line_no, ',' ORDER BY line_no) AS lines FROM ({FOUND}) GROUP BY doc_id, path",
    "search_context": f"SELECT doc_id, line_no, greatest(line_no - 2, 1) AS first_line, array_to_string(l[greatest(line_no - 2, 1):line_no + 2], chr(10)) AS context FROM ({HITS}) WHERE regexp_matches(line, '{PATTERN}')",
    "search_collapsed": f"WITH RECURSIVE h AS MATERIALIZED (SELECT doc_id, line_no FROM ({HITS}) WHERE contains(line, 'return')), k AS (SELECT doc_id, min(line_no) AS line_no FROM h GROUP BY doc_id UNION ALL SELECT k.doc_id, min(h.line_no) FROM k JOIN h ON h.doc_id = k.doc_id AND h.line_no > k.line_no + 2 GROUP BY k.doc_id) SELECT * FROM k",
    "search_prose": f"SELECT doc_id, line_no FROM ({HITS}) WHERE contains(line, 'Encoder') AND regexp_matches(line, '{R.PROSE.replace(chr(39), chr(39) * 2)}')",
    "candidate_spread": "SELECT repo_id, doc_id, CAST(turn AS INT) AS turn FROM (SELECT repo_id, doc_id, row_number() OVER (PARTITION BY repo_id ORDER BY doc_id) AS turn FROM documents WHERE repo_id IS NOT NULL) WHERE turn <= (400 // (SELECT count(DISTINCT repo_id) FROM documents WHERE repo_id IS NOT NULL) + 1) * 2 ORDER BY turn, repo_id LIMIT 400",
    "define_symbol": " UNION ALL ".join(f"SELECT '{s}' AS symbol, doc_id, line_no, line FROM ({HITS}) WHERE regexp_matches(line, '{R.definition(s)}') AND NOT regexp_matches(ltrim(line), {_starts(R.BINDING)}) AND len(regexp_extract_all(split_part(line, '{s}', 1), '[\"`]')) % 2 = 0" for s in ("applySeries", "readParser", "read_parser", "cursorPool")),
    "reference_counts": " UNION ALL ".join(f"SELECT '{s}' AS symbol, count(*) AS lines FROM ({HITS}) WHERE regexp_matches(line, '\\b{s}\\b')" for s in ("gateLoop", "index_loop", "nosuchname")),
    "token_budget": f"SELECT doc_id, line_no, tokens, upto FROM (SELECT *, CAST(sum(tokens) OVER (ORDER BY turn, relevance DESC, doc_id, line_no) AS BIGINT) AS upto FROM (SELECT *, greatest(len(list_filter(string_split_regex(line, '\\s+'), lambda w: w <> '')) * 13 // 10, len(line) // 4) AS tokens FROM ({_ranked(60, 60)}))) WHERE upto <= 200 OR upto = tokens",
    "diagnosis": " UNION ALL ".join(f"SELECT '{s}' AS literal, (SELECT coalesce(bool_or(contains(text, '{s}')), false) FROM documents) AS known, (SELECT max_by(p, n) FROM (SELECT substring('{s}', 1, n) AS p, n FROM range({max(6, int(0.6 * len(s)))}, {len(s)}) t(n)) WHERE EXISTS (SELECT 1 FROM documents WHERE contains(text, p))) AS nearest" for s in ("applySeriesOnTheMoon", "writeNothingAtAll")),
}
