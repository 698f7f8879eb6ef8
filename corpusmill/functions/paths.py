"""What a path, a size and a content say about a file, as column expressions. Null paths have no language and aren't indexable; null sizes aren't either."""
from pyspark.sql import Column, functions as F

# Extensions and their languages.
EXTENSIONS = {"py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "scala": "scala", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "sh": "shell", "bash": "shell", "sql": "sql", "ex": "elixir", "exs": "elixir", "lua": "lua", "zig": "zig"}
# Other spellings of languages.
ALIASES = {"ts": "typescript", "js": "javascript", "py": "python", "c++": "cpp", "c#": "csharp", "cs": "csharp", "sh": "shell", "bash": "shell", "golang": "go", "rs": "rust", "kt": "kotlin", "rb": "ruby"}
# Directories without original work, in lower case.
SKIP_DIRECTORIES = ["node_modules", "vendor", "vendors", "vendored", "third_party", "thirdparty", "dist", "build", "target", "out", ".git", ".github", "testdata", "test_data", "fixtures", "__fixtures__", "samples", "__generated__", "stories", "__pycache__", "site-packages", "bower_components", "docs", "doc", "generated", "gen", ".venv", "venv", "migrations"]
# Parts of the names of generated, minified and lock files.
SKIP_NAMES = [".min.", ".bundle.", "_pb2.", ".pb.", "_generated.", ".generated.", ".g.dart", "-lock.", ".lock.", ".d.ts", ".stories.", ".gen."]
# Parts of the names of tests, and directories of tests.
TEST_NAMES = ["test_", "_test.", "_tests.", "-test.", "-tests.", ".test.", ".tests.", ".spec.", "conftest.", ".test-d."]
TEST_DIRECTORIES = ["test", "tests", "spec", "specs", "e2e", "testing", "mocks", "jstests", "testsuite", "testutil", "testutils", "fake", "fakes"]
# The sizes kept, in bytes, both included.
LEAST, MOST = 64, 200 * 1024
# Words that make a name suspect.
SUSPECT_WORDS = ["test", "tests", "testing", "testdata", "testutil", "testutils", "spec", "specs", "mock", "mocks", "fixture", "fixtures", "sample", "samples", "demo", "demos", "generated", "gen", "vendor", "vendors", "vendored", "snapshot", "snapshots", "bench", "benches", "benchmark", "benchmarks", "stub", "stubs", "fake", "fakes", "dummy", "e2e", "dist"]
# Characters that hide text, and those that few may be of.
HOSTILE = r"[\x{E0000}-\x{E007F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
INVISIBLE = r"[\x{200B}\x{2060}-\x{2064}\x{00AD}\x{FEFF}]"
INVISIBLE_MOST = 8

TEST_DIRECTORY = rf"^(?:{'|'.join(TEST_DIRECTORIES)})$|[_.-](?:test|testing|e2e)s*$|^tests?[_-]|^test.*projects$|^testfixtures"


def quoted(words) -> str:
    """A regular expression of any of these words."""
    return "|".join(w.replace(".", r"\.") for w in words)


def literals(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def language_of(path: Column) -> Column:
    """By the extension; none for other files and for names without a dot."""
    return F.try_element_at(literals(EXTENSIONS), F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1))))


def canonical_language(name: Column) -> Column:
    plain = F.lower(F.trim(name))
    return F.coalesce(F.try_element_at(literals(ALIASES), plain), plain)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def stem(name: Column) -> Column:
    """The name up to its last dot."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def is_test_directory(segment: Column) -> Column:
    return F.regexp_replace(F.lower(segment), "^_+|_+$", "").rlike(TEST_DIRECTORY)


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike("test|spec")


def should_index(path: Column, size: Column, include_tests: bool = False) -> Column:
    """Whether a path and its size earn a place: a code file of a fitting size, not hidden, generated, vendored or, unless wanted, a test."""
    name, dirs = file_name(path), directories(path)
    lower = F.lower(name)
    keep = size.between(LEAST, MOST) & language_of(path).isNotNull()
    keep &= ~F.exists(dirs, lambda d: F.lower(d).isin(SKIP_DIRECTORIES)) & ~path.rlike(r"(?:^|/)\.") & ~lower.rlike(quoted(SKIP_NAMES))
    if not include_tests:
        keep &= ~lower.rlike(quoted(TEST_NAMES)) & ~stem(name).rlike("Tests?$") & ~F.exists(dirs, is_test_directory)
    return F.coalesce(keep, F.lit(False))


def has_hidden_text(text: Column) -> Column:
    """Any character that hides or turns text, or more than a few that show nothing; none in a null text."""
    return F.coalesce(text.rlike(HOSTILE) | (F.regexp_count(text, F.lit(INVISIBLE)) > INVISIBLE_MOST), F.lit(False))


def is_binary(text: Column) -> Column:
    """A NUL in the first 8,192 bytes."""
    nul = F.lit("\0")
    return F.coalesce(F.contains(text, nul) & (F.octet_length(F.substring_index(text, "\0", 1)) < 8192), F.lit(False))


def words(segment: Column) -> Column:
    """The lower-case words of a name: cut at _ - . and before a capital after a small letter or digit."""
    cut = F.regexp_replace(segment, r"(?<=[\p{Ll}0-9])(?=\p{Lu})", "_")
    return F.filter(F.split(F.lower(cut), "[_.-]+"), lambda w: w != "")


def suspect_word(segment: Column) -> Column:
    return F.get(F.filter(words(segment), lambda w: w.isin(SUSPECT_WORDS)), F.lit(0))


def glob_regex(glob: str) -> str:
    """A glob as a regular expression: * and ** cross /, **/ stands for any number of directories, ? for one character, the rest for itself; a trailing /** also matches the directory."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i] == "*":
            while i < len(glob) and glob[i] == "*":
                i += 1
            out += ".*"
        else:
            out += "." if glob[i] == "?" else glob[i] if glob[i].isalnum() or glob[i] in "_/" or ord(glob[i]) > 127 else "\\" + glob[i]
            i += 1
    bare = glob_regex(glob[:-3]).removeprefix("(?s)^").removesuffix("$") if glob.endswith("/**") and len(glob) > 3 else None
    return "(?s)^" + (f"(?:{out}|{bare})" if bare else out) + "$"


def path_filter(value: str) -> str:
    """What a user types as a path, as a glob: without a glob character it is a directory."""
    value = value.strip().lstrip("/")
    if not value:
        raise ValueError("a path filter must not be empty")
    if any(c in value for c in "*?["):
        if value.count("**/") > 4:
            raise ValueError("a path filter may hold at most four '**/'")
        return value
    return value.rstrip("/") + "/**"


def matches_glob(path: Column, glob: str) -> Column:
    """The glob as a predicate; its literal start goes to the scan as a prefix."""
    literal = glob[: min([glob.find(c) for c in "*?" if c in glob] or [len(glob)])]
    if glob.endswith("/**") and literal.endswith("/"):
        literal = literal[:-1]
    got = path.rlike(glob_regex(glob))
    return path.startswith(literal) & got if literal else got
