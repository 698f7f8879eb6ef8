"""What a caller reads: a file or a range of it, symbols with the helpers they use, outlines, folders; hits as text, compact text or JSON. The rows come from Spark, bounded by a repository's or a page's size."""
import json

from pyspark.sql import DataFrame, functions as F

from corpusmill.functions import code as C, paths as P
from corpusmill.operators import search

# Sizes in characters and lines of what is shown.
OUTLINE_FROM, SYMBOLS_MOST, RANGE_LINES, FILE_LINES, LINE_WIDTH = 6_000, 16_000, 120, 400, 400
HELPERS_LEAST, HELPERS_MOST, HELPER_LINES, HELPER_OUTLINE, DEPTH, TRIED = 1_500, 5_000, 60, 12, 2, 80


def clamp(line, width=LINE_WIDTH):
    return line if len(line) <= width else f"{line[:width]} … {len(line) - width} more characters"


def numbered(lines, first, last):
    return "\n".join(f"{i + 1:>5}  {clamp(lines[i])}" for i in range(first, last + 1))


def without_comments(lines, language, first, last):
    """The runs of lines outside comments."""
    mask = C.prose(lines, language)
    runs, start = [], None
    for i in range(first, last + 2):
        if i <= last and not mask[i]:
            start = i if start is None else start
        elif start is not None:
            runs.append((start, i - 1))
            start = None
    return runs


def show(text, language, path="", lines_from=None, lines_to=None, symbols=(), outline=False, full=False, comments=True):
    """A file as text: a range of lines, the blocks of symbols, an outline, or all of it; a long file comes as its outline unless it is asked for in full. Raises LookupError for a symbol that isn't declared."""
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    is_test = "test" in path.lower() or "spec" in path.lower()
    if symbols:
        out, used = [], 0
        for s in symbols:
            found = C.definitions(lines, s, language)
            if not found:
                raise LookupError(f"{s} isn't declared in {path or 'the file'}")
            for first, last in found:
                body = "\n".join(numbered(lines, a, z) for a, z in (without_comments(lines, language, first, last) if not comments else [(first, last)]))
                if used and used + len(body) > SYMBOLS_MOST:
                    out.append(f"… {s} at line {first + 1} is left out")
                    continue
                used += len(body)
                out.append(body)
        return "\n\n".join(out)
    if lines_from:
        last = min(lines_to or lines_from + RANGE_LINES - 1, len(lines))
        return numbered(lines, lines_from - 1, last - 1)
    if outline or not full and len(text) > OUTLINE_FROM:
        return "\n".join(f"{i + 1:>5}  {clamp(lines[i].rstrip())}" for i in C.outline(lines, language, is_test))
    last = len(lines) if full else min(len(lines), FILE_LINES)
    shown = "\n".join(numbered(lines, a, z) for a, z in (without_comments(lines, language, 0, last - 1) if not comments else [(0, last - 1)]))
    return shown + (f"\n… {len(lines) - last} more lines" if last < len(lines) else "")


def folder(docs: DataFrame, repo_id, directory, most=OUTLINE_FROM):
    """(shown, omitted): outlines of a folder's files by path while they fit, and the paths of the others. The scan is restricted to the repository and the folder."""
    prefix = directory.strip("/") + "/" if directory.strip("/") else ""
    rows = docs.where((F.col("repo_id") == repo_id) & F.col("path").startswith(prefix)).select("path", "language", "text").orderBy("path")
    shown, omitted, used = [], [], 0
    for r in rows.toLocalIterator():
        part = f"{r.path}\n{show(r.text or '', r.language or '', r.path, outline=True)}"
        if shown and used + len(part) > most:
            omitted.append(r.path)
        else:
            shown.append(part)
            used += len(part)
    return "\n\n".join(shown), omitted


def helpers(files: dict, path, symbol, skip=()):
    """Declarations that a symbol's block uses, in its file or in files it imports: (hop, path, name, text), the nearer first, long ones as outlines, within a size; small ones come last. files: path to (language, text) of one repository."""
    def lines_of(p):
        return [x.removesuffix("\r") for x in files[p][1].split("\n")]

    language, seen, queue, found = files[path][0], {(path, symbol)}, [(0, path, symbol)], []
    while queue and len(found) < TRIED:
        hop, p, name = queue.pop(0)
        lines, language = lines_of(p), files[p][0]
        blocks = C.definitions(lines, name, language)
        if not blocks:
            continue
        body = "\n".join(lines[blocks[0][0] : blocks[0][1] + 1])
        if hop:
            short = blocks[0][1] - blocks[0][0] + 1 <= HELPER_LINES
            text = body if short else "\n".join(lines[i] for i in C.outline(lines, language) if blocks[0][0] <= i <= blocks[0][1])
            text = text if short else "\n".join(text.split("\n")[:HELPER_OUTLINE])
            found.append((hop, p, name, text))
        if hop == DEPTH:
            continue
        there = dict(C.imports(lines, language))
        for other in C.identifiers(body):
            targets = [q for q in C.module_paths(there[other], p, language) if q in files][:1] if other in there else [p]
            for q in targets:
                if (q, other) not in seen and other not in skip and C.definitions(lines_of(q), other, files[q][0]):
                    seen.add((q, other))
                    queue.append((hop + 1, q, other))
    room = max(HELPERS_LEAST, min(HELPERS_MOST, len(files[path][1])))
    out = []
    for row in sorted(found, key=lambda r: (r[3].count("\n") < 2, r[0])):
        if len(row[3]) <= room:  # greedy: what doesn't fit is passed over
            out.append(row)
            room -= len(row[3])
    return out


def define(docs: DataFrame, symbol: str, limit: int = 20):
    """(repo_id, path, line_no, line) of a symbol's definitions, ranked; what only binds it in a function counts if nothing else is found."""
    from corpusmill.functions import patterns as R

    if len(symbol) < 2:
        raise ValueError("a symbol has at least two characters")
    hits = search.search(docs, R.definition(symbol)).where(~R.binds_only(F.col("line"), symbol))
    local = F.col("line").rlike(r"^\s+(?:let|var|const)\s|:=") & ~F.ltrim("line").rlike(R.FUNCTION_BINDING) & ~F.ltrim("line").startswith("func")
    rows = search.ranked(hits, limit).withColumn("local", local).collect()
    outer = [r for r in rows if not r.local]
    return [(r.repo_id, r.path, r.line_no, r.line) for r in outer or rows]


def render_text(hits):
    """Hits grouped by file, with line numbers."""
    out, last = [], None
    for r in hits:
        if (r["repo_id"], r["path"]) != last:
            last = (r["repo_id"], r["path"])
            out.append(f"{r['repo_id']}:{r['path']}")
        out.append(f"{r['line_no']:>5}  {clamp(r['line'])}")
    return "\n".join(out)


def render_compact(hits):
    return "\n".join(f"{r['repo_id']}:{r['path']}:{r['line_no']}: {clamp(r['line'].strip(), SYMBOLS_WIDTH)}" for r in hits)


SYMBOLS_WIDTH = 120


def render_json(hits, more=False):
    return json.dumps({"matches": [dict(r) for r in hits], "more_available": more}, ensure_ascii=False)


def hits_json(hits: DataFrame) -> DataFrame:
    """The same as JSON lines, made by Spark."""
    return hits.select(F.to_json(F.struct(*hits.columns)).alias("value"))


def within_budget(rows, tokens):
    """The longest start of rendered rows within a number of tokens, always one row."""
    if tokens < 50:
        raise ValueError("at least 50 tokens")
    used, out = 0, []
    for r in rows:
        text = r["line"]
        used += max(len(text.split()) * 13 // 10, len(text) // 4)
        if out and used > tokens:
            break
        out.append(r)
    return out


def human(n):
    for unit, size in (("GB", 10**9), ("MB", 10**6), ("KB", 10**3)):
        if n >= size:
            return f"{n / size:.1f} {unit}"
    return f"{n} B"


def grouped_paths(docs: DataFrame, repo_id, most=OUTLINE_FROM):
    """A repository's paths by directory: names, or counts where the names would be too long."""
    rows = docs.where(F.col("repo_id") == repo_id).where("path is not null").select(F.regexp_replace("path", "[^/]*$", "").alias("directory"), P.file_name(F.col("path")).alias("name")).orderBy("directory", "name").collect()
    by = {}
    for r in rows:
        by.setdefault(r.directory, []).append(r.name)
    text = "\n".join(f"{k or './'} {' '.join(v)}" for k, v in by.items())
    return text if len(text) <= most else "\n".join(f"{k or './'} {len(v)}" for k, v in by.items())
