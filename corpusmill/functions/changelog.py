"""A changelog's headings, releases and lines. Plain functions over a text, for use inside Arrow batches."""
import re

NAMES = ["changelog", "changes", "history", "releases", "news"]  # fixed values: file names by preference
SUFFIXES = ["", ".md", ".markdown", ".rst", ".txt"]


def rank(path):
    """The preference of a root file as the changelog, the lowest first; None for other files."""
    name = path.lower()
    return next((i for i, n in enumerate(NAMES) for s in SUFFIXES if name == n + s), None)


def version_in(text):
    """The first dotted version that opens a word, or follows a v; None without one."""
    m = re.search(r"(?<![\w.-])v?(\d+(?:\.\d+)+(?:[-+.]?[A-Za-z][\w.+-]*)?|\d+\.\d+)", text)
    return m[1].rstrip(".") if m else None


def headings(text):
    """(line, depth, title), lines from 0: Markdown and underlined headings outside fences; underlines rank by first use."""
    lines, out, fence, marks = text.split("\n"), [], None, []
    for i, line in enumerate(x.rstrip("\r") for x in lines):
        t = line.strip()
        if m := re.match(r"(```+|~~~+)", t):
            fence = None if fence and t.startswith(fence) else fence or m[1]
            continue
        if fence:
            continue
        if m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line):
            out.append((i, len(m[1]), m[2]))
        elif i and re.fullmatch(r"([=\-~^])\1{2,}", t) and lines[i - 1].strip() and not lines[i - 1].lstrip().startswith(("#", "-", "*", ">")):
            if t[0] not in marks:
                marks.append(t[0])
            out.append((i - 1, marks.index(t[0]) + 1, lines[i - 1].strip()))
    return out


def releases(text):
    """(version, title, first line, last line) of each release: sections at the heading depth with most versions, the lesser of equal ones."""
    heads = headings(text)
    counts = {}
    for _, depth, title in heads:
        if version_in(title) or "unreleased" in title.lower():
            counts[depth] = counts.get(depth, 0) + bool(version_in(title))
    if not counts:
        return []
    depth = min(counts, key=lambda d: (-counts[d], d))
    total, out = len(text.split("\n")), []
    for k, (i, d, title) in enumerate(heads):
        if d == depth and (version_in(title) or "unreleased" in title.lower()):
            end = next((j for j, e, _ in heads[k + 1 :] if e <= depth), total)
            out.append((version_in(title) or "unreleased", title, i, end - 1))
    return out


def found(rows, wanted):
    """The release of a version: the same one, else the first that starts with it; a leading v doesn't matter."""
    w = wanted.lower().lstrip("v")
    return next((r for r in rows if r[0] == w), None) or next((r for r in rows if r[0].startswith(w)), None)


def latest(text, rows):
    """The first release that isn't an empty unreleased one."""
    lines = text.split("\n")
    return next((r for r in rows if r[0] != "unreleased" or any(x.strip() for x in lines[r[2] + 1 : r[3] + 1])), None)


def without_links(line):
    """Images dropped, links replaced by their labels."""
    return re.sub(r"\[([^\]]*)\](?:\([^)]*\)|\[[^\]]*\])", r"\1", re.sub(r"!\[[^\]]*\]\([^)]*\)", "", line))


def summary(line, width=90):
    """The first sentence of an item, cut to a width; None for nested lines, tables and blank lines."""
    if not line.strip() or line.startswith((" ", "\t")) or line.lstrip().startswith("|"):
        return None
    t = without_links(re.sub(r"^[-*+]\s+", "", line.strip()))
    m = re.search(r"(?<=.{20})[.!?](?=\s)", t)
    t = t[: m.end()] if m else t
    return t if len(t) <= width else t[: width - 1].rstrip() + "…"
