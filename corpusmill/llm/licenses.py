"""Licenses of code files and repositories.

What a text declares: a reference text that stands in it, an SPDX expression, a license line or field, or a sentence that
puts the work under a named license. Candidate reference texts come from an inverted index of their rare token shingles;
an alignment of the token sequences then gives the coverage and the clauses that were altered, dropped or added.

A file's header is what stands above its code: comments, blank lines and metadata lines. A repository is judged by the
license files and manifests in its root. Null and empty contents declare nothing; a repository without root files is
UNKNOWN; a null file_id has no row, a null repo_id belongs to no repository. Rows of one file_id count once (the first
that arrived). Extra columns are ignored. license_refs is collected to the driver and may hold at most MAX_REFS rows.
"""
import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F

from corpusmill.llm.common import table

MAX_REFS = 5000
SHINGLE = 3
COVERAGE = 0.85
TOKEN = re.compile(r"[a-z0-9]+(?:'[a-z]+)?")
# Families of license names with the version that tells them apart; the first that fits counts.
FAMILIES = (
    (r"agpl|affero", {"3": "AGPL-3.0-only"}, "3"),
    (r"lgpl|lesser", {"2.1": "LGPL-2.1-only"}, None),
    (r"gpl|general public", {"2": "GPL-2.0-only", "3": "GPL-3.0-only"}, None),
    (r"apache|\basl\b", {"2": "Apache-2.0"}, "2"),
    (r"mpl|mozilla", {"2": "MPL-2.0"}, "2"),
    (r"epl|eclipse", {"2": "EPL-2.0"}, "2"),
    (r"\bbsd\b", {"3": "BSD-3-Clause", "2": "BSD-2-Clause"}, None),
    (r"\bunlicense\b", {"": "Unlicense"}, ""),
    (r"\bisc\b", {"": "ISC"}, ""),
    (r"\bmit\b|\bexpat\b", {"": "MIT"}, ""),
)
ROOT_LICENSE = re.compile(r"(?i)(?:licen[cs]e|copying|unlicense)(?:[-.][\w.-]+)?")
MANIFEST = re.compile(r"(?i)package\.json|cargo\.toml|pyproject\.toml|setup\.cfg|composer\.json|pom\.xml|[\w.-]+\.gemspec")
FIELD = re.compile(r"""(?im)^\s*["']?licen[cs]e["']?\s*[:=]\s*(?:\{\s*(?:text|type|"type")\s*[:=]\s*)?["']?([^"'\n{}]+)""")
COMMENT = re.compile(r"\s*(?:#(?!\s*(?:include|define|undef|if|ifdef|ifndef|else|endif|pragma|import|error)\b)|//|/\*|\*|--|;|<!--|%|'''|\"\"\"|=begin|=end)")
METADATA = re.compile(r"\s*(?:__\w+__\s*=|(?:package|use strict)\b.*;\s*$|<\?php)")
PREFIX = re.compile(r"^\s*(?:#+!?|//+!?|/\*+!?|\*+/?|--+|;+|<!--|%+)?\s?(.*?)\s*(?:\*/|-->)?\s*$")
LINE = re.compile(r"(?i)^\W*(?:SPDX-License-Identifier|@?licen[cs]e|__licen[cs]e__)\s*[:=]\s*[\"']?(.+?)[\"']?[\s.;,]*$")
SENTENCE = re.compile(r"(?i)\b(?:licensed|released|distributed|available|published|made available|provided)\s+under\s+(?:the\s+terms\s+of\s+)?(.+?)(?:,?\s+at\s+your\s+option|;|\.\s|\.$|$)|\bis\s+(?:governed|covered)\s+by\s+(.+?)(?:;|\.\s|\.$|$)")
NAME = re.compile(r"(?ix)^(?:the\s+)?(?:gnu\s+)?(?:lesser\s+|affero\s+)?(?:agpl|lgpl|gpl|general\s+public\s+licen[cs]e|apache(?:\s+software)?|asl|mpl|mozilla\s+public|epl|eclipse\s+public|(?:new|revised|modified|simplified|[23]-clause)?\s*bsd|unlicense|isc|mit|expat)\b|^(?:the\s+)?(?:agpl|lgpl|gpl|mpl|epl)v?\d")


def license_of_name(name, known):
    """The id that a license name or identifier means, or None."""
    n = " ".join(name.lower().strip(" .,;\"'()").split())
    if name.strip() in known:
        return name.strip()
    if len(n) > 70 or not NAME.match(n):
        return None
    for family, versions, default in FAMILIES:
        if re.search(family, n):
            if "bsd" in family:
                v = "3" if re.search(r"3|new|revised|modified", n) else "2" if re.search(r"2|simplified", n) else None
            else:
                m = re.search(r"(\d+(?:\.\d+)?)", n)
                v = (m[1] if m[1] in versions else m[1].split(".")[0]) if m and "" not in versions else default
            got = versions.get(v)
            return got if got in known else None
    return None


def expression(text, known):
    """Declarations of an SPDX-like expression or of names joined by or / and: OR makes one choice, AND several."""
    out = set()
    for part in re.split(r"\s+(?i:and)\s+", text.strip().strip("()")):
        ids = [license_of_name(x.strip("() "), known) for x in re.split(r"\s+(?i:or)\s+|\s*\|\|?\s*", part)]
        ids = sorted({i for i in ids if i})
        if ids:
            out.add(" OR ".join(ids))
    return out


class References:
    """The reference texts with an inverted index of their rare shingles."""

    def __init__(self, rows):
        self.ids = {i for i, _, _ in rows}
        self.tokens = {i: TOKEN.findall((body or "").lower()) for i, _, body in rows}
        self.titles = {" ".join(TOKEN.findall((title or "").lower())): i for i, title, _ in rows if title}
        index = {}
        for i, t in self.tokens.items():
            for k in range(len(t) - SHINGLE + 1):
                index.setdefault(tuple(t[k : k + SHINGLE]), set()).add(i)
        self.index = {s: ids for s, ids in index.items() if len(ids) <= 2}

    def aligned(self, text):
        """(id, coverage, altered clauses) of each reference text of which a rare shingle occurs."""
        t = TOKEN.findall(text.lower())
        at = {}
        for k in range(len(t) - SHINGLE + 1):
            for i in self.index.get(tuple(t[k : k + SHINGLE]), ()):
                at.setdefault(i, []).append(k)
        out = []
        for i, places in at.items():
            ref = self.tokens[i]
            best = None
            done = 0  # the end of the last window
            for k in places:  # windows around every hit: one ends a text's length behind the last hit it covers
                if best and k + len(ref) <= done:
                    continue
                lo, hi = max(0, k - 2 * len(ref)), k + 2 * len(ref)
                done = hi
                m = SequenceMatcher(None, ref, t[lo:hi], autojunk=False)
                got = sum(b.size for b in m.get_matching_blocks())
                ops = [(tag, " ".join(ref[a:b]), " ".join(t[lo:hi][c:d])) for tag, a, b, c, d in m.get_opcodes() if tag != "equal" and not (tag == "insert" and a in (0, len(ref)))]
                if best is None or got > best[0]:
                    best = (got, ops)
            out.append((i, best[0] / max(1, len(ref)), best[1]))
        return out


def declared(lines, refs, whole):
    """The declarations in lines of text (comment marks taken off); whole: the text is a license file, where a title alone counts."""
    out = {i for i, coverage, _ in refs.aligned(" ".join(lines)) if coverage >= COVERAGE}
    for line in lines:
        m = LINE.match(line)
        if m:
            out |= expression(m[1], refs.ids)
            continue
    for m in SENTENCE.finditer(" ".join(lines)):
        out |= expression(m[1] or m[2], refs.ids)
    if whole and not out:
        for line in lines:
            title = " ".join(TOKEN.findall(line.lower()))
            if title in refs.titles:
                out.add(refs.titles[title])
    return out


def header(text):
    """The lines above the code, without comment marks."""
    out, inside = [], None
    for line in text.split("\n"):
        if inside:
            out.append(line)
            if inside in line:
                inside = None
        elif not line.strip() or COMMENT.match(line) or METADATA.match(line) or line.startswith("﻿"):
            out.append(line)
            start = re.match(r"\s*(/\*|\"\"\"|'''|<!--|=begin)", line)
            if start:
                end = {"/*": "*/", "<!--": "-->", "=begin": "=end"}.get(start[1], start[1])
                if end not in line[start.end() :]:
                    inside = end
        else:
            break
    return [PREFIX.match(x.rstrip("\r"))[1] if PREFIX.match(x.rstrip("\r")) else x for x in out]


def of_file(kind, path, text, refs):
    if not text:
        return set()
    if kind == "header":
        return declared(header(text), refs, False)
    name = path.rpartition("/")[2]
    if MANIFEST.fullmatch(name):
        return set().union(*(expression(m[1], refs.ids) for m in FIELD.finditer(text)))
    return declared([PREFIX.match(x.rstrip("\r"))[1] for x in text.split("\n")], refs, True)


def references(refs):
    rows = [(r.license_id, r.title, r.body) for r in refs.select("license_id", "title", "body").limit(MAX_REFS + 1).collect() if r.license_id is not None]
    if len(rows) > MAX_REFS:
        raise ValueError(f"license_refs holds more than {MAX_REFS} rows")
    return rows


def declarations(files, refs):
    """files (file_id, repo_id, path, language, content, arrived_at) to (file_id, repo_id, kind, licenses): kind header for files with a language, root for license files and manifests in the root; licenses is the sorted list of declarations."""
    rows = references(refs)
    name = F.element_at(F.split("path", "/"), -1)
    root = ~F.contains("path", F.lit("/")) & (F.col("path").rlike(f"^(?:{ROOT_LICENSE.pattern})$") | F.col("path").rlike(f"^(?:{MANIFEST.pattern})$"))
    kind = F.when(F.col("language").isNotNull(), "header").when(F.coalesce(root, F.lit(False)), "root")
    picked = files.withColumn("kind", kind).where("kind is not null and file_id is not null").select("file_id", "repo_id", "kind", "path", "content", "arrived_at")

    def run(batches):
        ref = References(rows)
        for b in batches:
            out = [sorted(of_file(k, p, t, ref)) for k, p, t in zip(b.kind, b.path, b.content)]
            yield pd.DataFrame({"file_id": b.file_id, "repo_id": pd.array(b.repo_id, dtype="Int64"), "kind": b.kind, "arrived_at": b.arrived_at, "licenses": out})

    got = picked.mapInPandas(run, "file_id long, repo_id long, kind string, arrived_at timestamp_ntz, licenses array<string>" if dict(files.dtypes).get("arrived_at") == "timestamp_ntz" else "file_id long, repo_id long, kind string, arrived_at timestamp, licenses array<string>")
    return got.groupBy("file_id").agg(F.min_by(F.struct("repo_id", "kind", "licenses"), F.struct("arrived_at", "licenses")).alias("_p")).select("file_id", "_p.*")


def licenses_of(files, repos, refs):
    """(scope, id, license, flag), see TESTDATA.md."""
    found = declarations(files, refs)
    root = found.where("kind = 'root'").select("repo_id", F.explode("licenses").alias("x")).groupBy("repo_id").agg(F.sort_array(F.collect_set("x")).alias("root"))  # as many as there are licenses and choices
    none = F.array().cast("array<string>")

    def row(scope, id_, own, all_):
        flag = F.when(F.size(all_) > 1, "conflict").when(F.size(own) == 0, "unknown").otherwise("ok")
        return F.lit(scope).alias("scope"), F.col(id_).alias("id"), F.when(F.size(own) == 0, "UNKNOWN").otherwise(F.array_join(own, "|")).alias("license"), flag.alias("flag")

    per_repo = repos.select("repo_id").join(root, "repo_id", "left").withColumn("root", F.coalesce("root", none))
    per_file = found.where("kind = 'header'").join(root, "repo_id", "left").withColumn("root", F.coalesce("root", none))
    own = F.when(F.size("licenses") > 0, F.col("licenses")).otherwise(F.col("root"))
    return per_repo.select(*row("repo", "repo_id", F.col("root"), F.col("root"))).unionByName(per_file.select(*row("file", "file_id", own, F.array_union("licenses", "root"))))


def p4_found(spark, d):
    return licenses_of(table(spark, d, "prepared_files"), table(spark, d, "repos"), table(spark, d, "license_refs"))


def p4_matches(spark, d):
    """(file_id, license_id, coverage, altered): alignment of every license file and header with the reference texts it shares a rare shingle with; altered lists the clauses that differ."""
    files, rows = table(spark, d, "prepared_files"), references(table(spark, d, "license_refs"))

    def run(batches):
        ref = References(rows)
        for b in batches:
            out = []
            for i, lang, t in zip(b.file_id, b.language, b.content):
                text = " ".join(header(t)) if lang is not None else " ".join(PREFIX.match(x.rstrip("\r"))[1] for x in t.split("\n"))
                out += [(i, x, c, [f"{k}: {p} -> {q}" for k, p, q in ops]) for x, c, ops in ref.aligned(text)]
            yield pd.DataFrame(out, columns=["file_id", "license_id", "coverage", "altered"])

    picked = files.where("file_id is not null and content is not null").select("file_id", "language", "content")
    return picked.mapInPandas(run, "file_id long, license_id string, coverage double, altered array<string>").groupBy("file_id", "license_id").agg(F.max("coverage").alias("coverage"), F.max_by("altered", "coverage").alias("altered"))


QUERIES = {"p4_found": p4_found, "p4_matches": p4_matches}
