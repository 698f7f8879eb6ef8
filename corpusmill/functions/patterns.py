"""Regular expressions analysed on the driver: what text a match needs, and forms of definitions and of lines."""
import re

from pyspark.sql import Column, functions as F

# Line starts that define, and that only name, a thing.
DEFINING = ["def ", "class ", "func ", "fn ", "type ", "struct ", "interface ", "impl ", "enum ", "trait ", "pub fn ", "export ", "async def ", "public ", "private ", "function ", "async function "]
NAMING = ["import ", "from ", "use ", "#include", "require(", "@"]
BINDING = ["if let ", "match ", "case ", "var _", "let _", "return ", "import ", "from ", "use "]
BASE, DEFINES, NAMES, SHORT, TEST = 1000, 7000, 600, 200, 300
FUNCTION_BINDING = r"^(?:export\s+)?(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|class\b|\([^)]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>|\($)"
PROSE = r"^\s*(?:#|//|/\*|--|\"\"\"|''')|^\s*\"[^\"]*\"\s*$"
MOST_BYTES = 512


def checked(pattern: str) -> str:
    """The pattern, if it may be searched for."""
    if not pattern:
        raise ValueError("the pattern is empty")
    if len(pattern.encode()) > MOST_BYTES:
        raise ValueError(f"the pattern is longer than {MOST_BYTES} bytes")
    if re.search(r"(?<!\\)\(\?(?:[=!]|<[=!])", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise ValueError("look-around and back-references aren't supported")
    re.compile(pattern)
    return pattern


def alternatives(pattern: str) -> list[str]:
    """The branches of a pattern: split at | outside groups and classes."""
    out, depth, inside, start, i = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def literal_runs(branch: str, least: int = 3) -> list[str]:
    """Runs of at least three characters that every match of a branch holds; groups, classes and escapes of classes end a run, what may be absent isn't in one."""
    out, run, i = [], "", 0

    def close():
        nonlocal run
        if len(run) >= least:
            out.append(run)
        run = ""

    while i < len(branch):
        c = branch[i]
        if c == "\\":
            i += 1
            if i < len(branch) and not branch[i].isalnum():
                run += branch[i]
            else:
                close()
        elif c in "*?{":
            run = run[:-1]
            close()
            if c == "{":
                i = branch.find("}", i) if "}" in branch[i:] else len(branch)
        elif c == "+":
            close()
        elif c in "[(":
            close()
            depth, inside = (1, False) if c == "(" else (0, True)
            while i + 1 < len(branch) and (depth or inside):
                i += 1
                if branch[i] == "\\":
                    i += 1
                elif inside:
                    inside = branch[i] != "]"
                elif branch[i] == "[":
                    inside = True
                else:
                    depth += {"(": 1, ")": -1}.get(branch[i], 0)
            if i + 1 < len(branch) and branch[i + 1] in "*?+{":
                i += 1
                if branch[i] == "{":
                    i = branch.find("}", i) if "}" in branch[i:] else len(branch)
        elif c in ".^$)":
            close()
        else:
            run += c
        i += 1
    close()
    return out


def has_case_flag(pattern: str) -> bool:
    """Whether (?i) or the like is in the pattern."""
    return any("i" in m[1].split("-")[0] for m in re.finditer(r"(?<!\\)\(\?([a-zA-Z-]+)[:)]", pattern))


def needs_line_break(pattern: str) -> bool:
    """Whether every branch needs a line end outside a class, so that no single line can match."""
    def branch_needs(b):
        return re.search(r"(?<!\\)(?:\\\\)*(?:\\n|\n)(?![*?]|\{0)", re.sub(r"\[(?:\\.|[^\]\\])*\]", "", b)) is not None

    return all(branch_needs(b) for b in alternatives(pattern))


def byte_grams(literal: str) -> list[int]:
    b = literal.encode()
    return sorted({b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)})


def case_variants(gram: int) -> list[int] | None:
    """The grams that match a gram in any case; none if a byte isn't ASCII or folds with other characters (k and s)."""
    options = [[]]
    for shift in (16, 8, 0):
        c = chr(gram >> shift & 255)
        if ord(c) > 127 or c in "kKsS":
            return None
        options = [[*o, x] for o in options for x in sorted({c.lower(), c.upper()})]
    return sorted(ord(a) << 16 | ord(b) << 8 | ord(c) for a, b, c in options)


def definition(symbol: str) -> str:
    """A pattern of lines that define a symbol: a keyword, the name and what opens a body; an assigned function or class; a method with a receiver."""
    name = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in symbol)
    keywords = "def|class|func|fn|function\\*?|type|struct|interface|impl|enum|trait|const|var|let|export|public"
    opened = rf"(?:\s*(?:[(:=<{{\[]|$)|\s+(?:where|extends|implements|struct|interface|\{{))"
    return rf"\b(?:{keywords})\s+(?:async\s+)?{name}\b{opened}|\b{name}\s*:?=\s*(?:function|async|[({{]|class)|^\s*func\s+\([^)]*\)\s+{name}\s*[\[(]"


def starts(line: Column, words) -> Column:
    return line.rlike("^(?:" + "|".join(re.sub(r"([(#])", r"\\\1", w) for w in words) + ")")


def binds_only(line: Column, symbol: str) -> Column:
    """A line that matches a definition but binds, matches or imports the name, or holds it inside a string."""
    before = F.substring_index(line, symbol, 1)
    return starts(F.ltrim(line), BINDING) | (F.regexp_count(before, F.lit('["`]')) % 2 == 1)


def relevance(line: Column, path: Column) -> Column:
    """How likely a matching line is what was looked for; definitions first, imports and tests last, short lines before long ones."""
    trimmed = F.ltrim(line)
    score = F.lit(BASE) + F.when(starts(trimmed, DEFINING) | trimmed.rlike(FUNCTION_BINDING), DEFINES).otherwise(0)
    score = F.greatest(F.lit(0), score - F.when(starts(trimmed, NAMING), NAMES).otherwise(0))
    score = score + F.lit(SHORT) - F.least(F.octet_length(line), F.lit(SHORT))
    return F.greatest(F.lit(0), score - F.when(path.rlike("test|spec"), TEST).otherwise(0))


def estimated_tokens(text: Column) -> Column:
    """The greater of 1.3 tokens a word and a token for four characters."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.greatest(F.floor(n * 13 / 10), F.floor(F.length(text) / 4)).cast("long")
