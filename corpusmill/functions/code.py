"""One file's lines: comments and docstrings, enclosing scopes, where a block ends, definitions, outlines, imports. Plain functions over a list of lines, for use inside Arrow batches."""
import re

HASH_COMMENT = {"python", "ruby", "shell", "elixir"}
DASH_COMMENT = {"sql", "lua"}
BRACES = {"javascript", "typescript", "go", "rust", "java", "kotlin", "scala", "c", "cpp", "csharp", "php", "swift", "zig"}
# How long an open block comment or docstring may last before it is taken for something else.
BLOCK_MOST, DOCSTRING_MOST, OPEN_WITHIN, SCOPE_WIDTH = 60, 200, 12, 120
MODIFIERS = re.compile(r"^(?:(?:pub(?:\([^)]*\))?|public|private|protected|internal|static|final|abstract|async|export|default|override|virtual|inline|extern|unsafe|const(?=\s+fn\b)|open|sealed|data|suspend)\s+)*")
KEYWORD = re.compile(r"(?:def|class|func|fn|function\*?|type|struct|interface|impl|enum|trait|module|namespace|object|union|protocol)\b")
ASSIGNED = re.compile(r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|class\b|\([^)]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>|\($)")
METHOD = re.compile(r"(?:[\w<>\[\],.*&?:]+\s+)*?([A-Za-z_$][\w$]*)\s*\([^;{}=]*\)?[^;={}]*\{\s*$|(?:[\w<>\[\],.*&?:]+\s+)+([A-Za-z_$][\w$]*)\s*\([^;]*$")
NO_METHOD = {"if", "for", "while", "switch", "catch", "return", "else", "do", "with", "match", "when", "until", "elif", "foreach", "lock", "using", "sizeof", "new", "throw", "await", "yield", "in", "and", "or", "not"}


def indent(line):
    """The width of leading white space, a tab counting four."""
    return sum(4 if c == "\t" else 1 for c in line[: len(line) - len(line.lstrip())])


def prose(lines, language):
    """A flag a line: in a comment or a docstring."""
    out, inside, since = [False] * len(lines), None, 0
    mark = ("#",) if language in HASH_COMMENT else ("--",) if language in DASH_COMMENT else ("//",)
    for i, line in enumerate(lines):
        t = line.strip()
        if inside:
            end = t.find(inside)
            if end >= 0:
                for k in range(since, i + 1):
                    out[k] = True
                inside = None
            elif i - since >= (DOCSTRING_MOST if len(inside) == 3 else BLOCK_MOST):
                inside = None
            continue
        if t.startswith(mark):
            out[i] = True
        elif language == "python" and t[:3] in ('"""', "'''"):
            if t.find(t[:3], 3) >= 3:
                out[i] = True
            else:
                inside, since = t[:3], i
        elif language in BRACES and t.startswith("/*"):
            if t.find("*/", 2) >= 0:
                out[i] = t.endswith("*/")
            else:
                inside, since = "*/", i
    return out


def declared(line):
    """The name a line declares, or None: after a keyword, assigned to a function or class, or of a method's head."""
    t = line.strip()
    rest = t[MODIFIERS.match(t).end() :]
    m = KEYWORD.match(rest)
    if m:
        after = rest[m.end() :].strip()
        receiver = re.match(r"\([^)]*\)\s*([A-Za-z_]\w*)", after) if m[0] == "func" else None
        if m[0] == "impl":
            after = re.sub(r"^<[^>]*>\s*", "", after)
            after = after.partition(" for ")[2] or after
        name = receiver or re.match(r"([A-Za-z_$][\w$]*)", after)
        return name[1] if name else None
    m = ASSIGNED.match(rest)
    return m[1] if m else None


def method(line):
    """The name in a method's head without keyword, or None."""
    t = line.strip()
    if not t.endswith("{") or t.startswith(("}", "//", "*", "#")):
        return None
    head = t[MODIFIERS.match(t).end() : -1].strip()
    m = re.match(r"(?:[\w<>\[\],.*&?:]+\s+)*?(?P<n>~?[A-Za-z_$][\w$]*)\s*\((?:[^()]|\([^()]*\))*\)[^()=;]*$", head)
    return m["n"] if m and m["n"] not in NO_METHOD and not re.match(r"(?:return|throw|else|new|await)\b", head) else None


def scope(lines, at):
    """The nearest line above with a smaller indent that declares something, cut to a width; None at the top."""
    ceiling = indent(lines[at])
    for i in range(at - 1, -1, -1):
        line = lines[i]
        if not line.strip():
            continue
        n = indent(line)
        if n < ceiling:
            if declared(line) or method(line):
                return line.strip()[:SCOPE_WIDTH]
            if not re.match(r"\s*[)\]}]", line):
                ceiling = n
    return None


def stripped(line, state):
    """The line without strings and comments; state: the open string or comment from the line before, or None. Returns both."""
    out, i = [], 0
    while i < len(line):
        if state:
            end = line.find("*/", i) if state == "*/" else -1
            if state != "*/":
                while i < len(line) and line[i] != state:
                    i += 2 if line[i] == "\\" else 1
                end = i if i < len(line) else -1
            if end < 0:
                break
            i, state = end + len(state), None
            continue
        two, c = line[i : i + 2], line[i]
        if two == "//":
            break
        if two == "/*":
            state, i = "*/", i + 2
        elif c in "\"`":
            state, i = c, i + 1
        elif c == "'":
            m = re.match(r"'(?:\\.[^']*|[^'\\])'", line[i:])
            if m:
                i += m.end()
            elif re.match(r"'[a-zA-Z_]\w*\b(?!')", line[i:]):  # a lifetime
                i += 1
            else:
                state, i = c, i + 1
        else:
            out.append(c)
            i += 1
    return "".join(out), state if state in ("*/", "`") else None


def block_end(lines, start, language):
    """The last line of the block that starts here: by braces, or by indentation in Python and where no brace opens soon."""
    if language != "python":
        depth, opened, state = 0, False, None
        round_ = 0
        for i in range(start, len(lines)):
            text, state = stripped(lines[i], state)
            for c in text:
                round_ += {"(": 1, "[": 1, ")": -1, "]": -1}.get(c, 0)
                if c == "{":
                    depth, opened = depth + 1, True
                elif c == "}":
                    depth -= 1
            if opened and depth <= 0:
                if round_ <= 0:
                    return i
                continue
            if not opened and round_ <= 0 and text.rstrip().endswith(";"):
                return i
            if not opened and i - start >= OPEN_WITHIN:
                break
        if opened:
            return len(lines) - 1
    base, last, head = indent(lines[start]), start, 0
    for i in range(start, len(lines)):
        line = lines[i]
        if i > start and head <= 0 and line.strip() and indent(line) <= base:
            if language in ("ruby", "shell", "lua", "elixir") and re.match(r"\s*(?:end|fi|done|esac)\b", line):
                return i
            break
        if line.strip():
            last = i
        if i == start or head > 0:
            head += sum({"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(c, 0) for c in re.sub(r"\"[^\"]*\"|'[^']*'", "", line))
    return last


def definitions(lines, symbol, language):
    """(start, end) of the blocks, from line 0, that declare the symbol."""
    mask = prose(lines, language)
    out = []
    for i, line in enumerate(lines):
        if symbol in line and not mask[i] and symbol in (declared(line), method(line)):
            out.append((i, block_end(lines, i, language)))
    return out


def outline(lines, language, is_test=False):
    """Line numbers, from 0, of declarations: at the top and of members; of a test file only the outer ones."""
    mask = prose(lines, language)
    out, ceiling = [], 4 if is_test else 1 << 30
    for i, line in enumerate(lines):
        if mask[i] or not line.strip():
            continue
        if declared(line) and indent(line) < ceiling or method(line) and 0 < indent(line) <= 8:
            out.append(i)
    return out


def imports(lines, language):
    """(name, module) of what a file imports: JavaScript, TypeScript and Python."""
    text = "\n".join(lines)
    out = []
    if language == "python":
        for m in re.finditer(r"(?m)^\s*from\s+([.\w]+)\s+import\s+(\([^)]{0,2000}\)|[^\n#]+)|^\s*import\s+([^\n#]+)", text):
            if m[1]:
                for part in m[2].strip("()").replace("\n", " ").split(","):
                    name = part.split(" as ")[-1].strip()
                    if name and name != "*":
                        out.append((name, m[1]))
            else:
                out += [(p.split(" as ")[-1].strip().split(".")[0], p.split(" as ")[0].strip()) for p in m[3].split(",") if p.strip()]
    elif language in ("javascript", "typescript"):
        for m in re.finditer(r"(?:^|\n)\s*(?:import|export)\s+(?:type\s+)?([^;'\"]{0,2000}?)\s*from\s*['\"]([^'\"]+)['\"]|(?:const|let|var)\s+(\{[^}]*\}|[\w$]+)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]", text):
            what, module = (m[1], m[2]) if m[2] else (m[3], m[4])
            for part in re.sub(r"[{}\n]", ",", what).split(","):
                name = re.split(r"\s+as\s+|:", part.strip())[-1].strip()
                if name and name != "*":
                    out.append((name, module))
    return out


def normalise(path):
    """The path with . and .. resolved; None if it leaves the root."""
    out = []
    for part in path.split("/"):
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def module_paths(module, path, language):
    """Paths that a relative import may mean, most likely first; none for other packages."""
    base = path.rpartition("/")[0]
    if language == "python":
        dots = len(module) - len(module.lstrip("."))
        if not dots:
            return []
        for _ in range(dots - 1):
            if not base and _ < dots - 1:
                return []
            base = base.rpartition("/")[0]
        at = normalise("/".join(x for x in (base, module[dots:].replace(".", "/")) if x))
        return [f"{at}.py", f"{at}/__init__.py"] if at else []
    if not module.startswith("."):
        return []
    at = normalise(f"{base}/{module}")
    if at is None:
        return []
    bare = re.sub(r"\.(?:js|jsx|mjs)$", "", at)
    return list(dict.fromkeys([at, *[f"{bare}.{e}" for e in ("ts", "tsx", "js", "jsx", "mjs", "cjs")], *[f"{at}/index.{e}" for e in ("ts", "tsx", "js", "jsx", "mjs")]]))


def identifiers(text):
    """Names used in a text, not those behind a dot, once each, in order."""
    return list(dict.fromkeys(re.findall(r"(?<![\w.$])[A-Za-z_$][\w$]*", text)))
