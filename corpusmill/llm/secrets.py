"""Credentials in source text: keyword automaton, issuer formats, structure checks, same-length placeholders.

Null content gives no findings and stays null; redelivered file ids count once; extra columns are ignored.
"""
import re

import pandas as pd
from pyspark.sql import functions as F

# Prefilter words; each alternative of VALUE needs one of them on its line.
WORDS = ("pass", "pwd", "_pw", "secret", "token", "key", "auth", "bearer", "jwt", "begin ", "://", "ghp_", "npm_", "sk_live_", "sg.", "akia", "asia", "glpat-", "xox", "aiza", "_pat_", "-u", "--user", "login", "connect(", "connection", "connstr", "conn_str", "conn-str", "hooks.", "eyj")
ISSUER = re.compile(r"\b(?:ghp_[A-Za-z0-9]{36}|npm_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}|SG\.[\w-]{16,}\.[\w-]{30,}|(?:AKIA|ASIA)[A-Z0-9]{16}|glpat-[\w-]{20,}|xox[a-z]-[A-Za-z0-9-]{20,}|AIza[\w-]{35}|[a-z][a-z0-9]+_pat_(?=\w*\d)(?:[a-f0-9]{32,}|[A-Za-z0-9]{22,}(?:_[A-Za-z0-9]{20,})?)|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})")
# Issuers not named above: prefix, separator and a body of both cases and digits. It has no word to prefilter by and is searched in every text.
GENERAL = re.compile(r"(?<![\w+/=.-])(?!(?i:sha|md)\d)[A-Za-z][A-Za-z0-9]{1,9}(?:_[a-z]{2,6})?[_-](?=[a-z0-9]*[A-Z])(?=[A-Z0-9]*[a-z])(?=[A-Za-z]*\d)[A-Za-z0-9]{20,}(?![\w+/=-])")
BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
ROW = re.compile(r"(?:\\r)?\\n|\r?\n")  # line ends of a key, written out or real
KEPT = re.compile(r"(?:gh[a-z]_|npm_|sk_live_|SG\.|AKIA|ASIA|glpat-|xox[a-z]-|AIza|[a-z][a-z0-9]+_pat_|eyJ)(?=[\w.-]{12})")
NAMES = r"passw(?:or)?d|passphrase|_pass|pwd|_pw|secret|token|(?:api|signing|account|access|secret|x-api)[_-]?key"
VALUE = re.compile(
    r"""(?ix)
    \b\w*(?:NAMES)\w*["']?\s*(?::=|=|:)\s*["']?(?P<a>(?!:)[^\s"';,(){}\[\]<>$]{8,}+[$!?]?)(?![(\[]|\))
    | \bauthorization["']?\]?\s*[:=]\s*["']?(?:basic|bearer|token)\s+(?P<b>[\w+/=.-]{16,})
    | \b\w*(?:NAMES)\w*["']?\s*(?::=|=|:)\s*["'](?P<j>[^\s"';,(){}\[\]<>$]{1,7})["']\s*(?:\\$|\+|\.\.?|&|<>)
    | \b\w*(?:connection|conn)[_-]?str(?:ing)?\w*["']?\]?\s*(?::=|=|:)\s*["']?(?P<h>[a-z0-9+/_-]{32,}={0,2})(?![\w+/=.-])
    | ://[^\s/:@"']+:(?P<c>[^\s/@"'${}]{6,})@
    | (?:^|\s)(?:-u|--user)\s+[^\s:]+:(?P<d>\S{6,})
    | \b(?:login|connect|authenticate|set_password)\(\s*["'][^"']*["']\s*,\s*["'](?P<e>[^"']{8,})["']
    | \blogin\ for\ .{1,40}\ is\ \S+\ /\ (?P<f>\S{6,})
    | \bhttps?://hooks\.[^\s/]+/services/(?P<g>[\w/]{20,})""".replace("NAMES", NAMES)
)

MORE = re.compile(r"""["'](?:\s*(?:\+|\.\.?|&|<>|\\)\s*|[ \t]+)["']([\w+/=.!@#%^&*-]+)(?=["'])""")
NO_SECRET = re.compile(r"(?i)your|example|xxxx|\*\*\*|environ|getenv|process\.env|change_?me|placeholder|redacted|dummy|insert_?|replace_?|pass(?:word|wd|phrase)?$|(?:secret|token|pwd|key|user|name)$")


def looks_random(v: str) -> bool:
    """Letters of both cases that don't read as an identifier of words: short humps, some of them without a vowel or all capitals."""
    humps = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", v)
    odd = any(len(h) > 1 and (h.isupper() or not re.search("(?i)[aeiouy]", h)) for h in humps)
    return v.isalpha() and not v.islower() and not v.isupper() and len(humps) > 2 and odd and len(v) < 5 * len(humps)


def letters_only(v: str) -> bool:
    """A password of letters in both cases; names of fields and other placeholders fail."""
    return v.isalpha() and not v.islower() and not v.isupper() and len(set(v)) >= 6 and not NO_SECRET.search(v)


def joined(text: str, end: int) -> tuple[str, int]:
    """The further pieces of a literal whose first one ends here, as one text, and where they end."""
    v = ""
    while m := MORE.match(text, end):
        v, end = v + m[1], m.end(1)
    return v, end


def is_secret(kind: str, v: str, text: str, start: int, end: int) -> bool:
    """Judges a value in its place: a piece together with the pieces that follow."""
    if masked_already(v):
        return False
    if kind == "b" or kind != "j" and looks_secret(v):
        return True
    if kind == "c":
        return letters_only(v)
    if kind not in "aj":
        return False
    more, _ = joined(text, end)
    if more and "://" not in v + more:
        return len(v + more) >= 8 and (looks_secret(v + more) or looks_random(v + more) and letters_only(v + more))
    quoted = text[start - 1] in "\"'" and text[end : end + 1] == text[start - 1]
    setting = len(v) >= 16 and text[start - 1] == "=" and text[end : end + 1] in ("", "\r", "\n")
    return kind == "a" and (quoted or setting) and looks_random(v) and letters_only(v)


def looks_secret(v: str) -> bool:
    """Mixed classes and enough distinct characters; masks, placeholders and plain identifiers fail."""
    kinds = sum(bool(re.search(p, v)) for p in ("[a-z]", "[A-Z]", r"\d", r"[^\w]"))
    return kinds >= 2 and len(set(v)) >= 6 and not re.search(r"(?i)your|example|xxxx|\*\*\*|environ|getenv|process\.env|\w\.\w+\(", v) and bool(re.search(r"\d", v) or kinds >= 3)


def key_rows(text, at):
    """The ranges of the key text in a block whose BEGIN mark ends here, and the block's end: its END mark, or where the last row of key letters ends."""
    rows, end = [], at
    while at <= len(text):
        m = ROW.search(text, at)
        stop = m.start() if m else len(text)
        if e := END.search(text, at, stop):
            for k in re.finditer(r"[A-Za-z0-9+/=]{16,}", text[at : e.start()]):
                rows.append((at + k.start(), at + k.end()))
            return rows, e.end()
        k = re.fullmatch(r"[\s\"'`+,;#*/.]*?(?P<k>[A-Za-z0-9+/]+={0,2})?[\s\"'`+,;\\.]*", text[at:stop])
        if not k and not re.fullmatch(r"[\s#*/]*(?:Proc-Type|DEK-Info|Version|Comment|Hash): .*", text[at:stop]):
            break
        if k and k["k"]:
            if len(k["k"]) < 16 and not rows:
                break
            rows.append((at + k.start("k"), at + k.end("k")))
            end = rows[-1][1]
            if len(k["k"]) < 16:
                break
        if not m:
            break
        at = m.end()
    return rows, end


def masked_already(v):
    """Nothing but what mask() leaves of letters and digits."""
    return not re.search(r"[A-WYZa-wyz1-9]", KEPT.sub("", v, count=1))


def spans(text, automaton):
    """Start and end of each secret, in order, without overlap."""
    if not text:
        return []
    out = [m.span() for m in GENERAL.finditer(text) if not masked_already(m[0])]
    if not out and next(automaton.iter(text.lower()), None) is None:
        return []
    for m in BEGIN.finditer(text):
        rows, end = key_rows(text, m.end())
        if rows and not all(masked_already(text[s:e]) for s, e in rows):
            out.append((m.start(), end))
    out += [m.span() for m in ISSUER.finditer(text) if len(set(m[0])) >= 9 and not masked_already(m[0])]
    at = 0
    for line in text.split("\n"):
        for m in VALUE.finditer(line) if next(automaton.iter(line.lower()), None) is not None else ():
            k = m.lastgroup
            if is_secret(k, m[k], text, at + m.start(k), at + m.end(k)):
                out.append((at + m.start(k), at + m.end(k)))
        at += len(line) + 1
    kept, end = [], -1
    for s, t in sorted(out):
        if s >= end:
            kept.append((s, t))
            end = t
    return kept


def mask(v: str) -> str:
    """Same length, same alphabet by character class; line ends, ASCII punctuation, the issuer's prefix and a key's BEGIN and END marks stay. What isn't ASCII becomes a letter or digit too."""
    if m := BEGIN.match(v):
        for s, e in key_rows(v, m.end())[0]:
            v = v[:s] + letters(v[s:e]) + v[e:]
        return v
    m = KEPT.match(v)
    n = m.end() if m else 0
    return v[:n] + letters(v[n:])


def letters(v):
    v = re.sub(r"[^\x00-\x7f\s]", lambda m: "0" if m[0].isnumeric() else "X" if m[0].isupper() else "x", v)
    return re.sub("[0-9]", "0", re.sub("[A-Z]", "X", re.sub("[a-z]", "x", v)))


def redacted(text, automaton):
    """The text with each secret masked, the further pieces of a joined one too."""
    for s, e in spans(text, automaton):
        end = joined(text, e)[1] if s and text[s - 1] in "\"'" else e
        text = text[:s] + mask(text[s:end]) + text[end:]
    return text


def build():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in WORDS:
        a.add_word(w, w)
    a.make_automaton()
    return a


def find_secrets(files):
    def run(batches):
        a = build()
        for b in batches:
            rows = {(f, t.count("\n", 0, s) + 1) for f, t in zip(b.file_id, b.content) for s, _ in spans(t, a)}
            yield pd.DataFrame(sorted(rows), columns=["file_id", "line_no"]).astype("int64")

    return files.where("content is not null and file_id is not null").select("file_id", "content").mapInPandas(run, "file_id long, line_no long").distinct()


def redact(files):
    @F.pandas_udf("string")
    def f(col: pd.Series) -> pd.Series:
        a = build()
        return pd.Series([redacted(t, a) for t in col], dtype=object)

    return files.withColumn("content", f("content"))


def p2_found(spark, d):
    return find_secrets(spark.read.parquet(f"{d}/prepared_files.parquet"))


def p2_redacted(spark, d):
    """All files, with or without findings, null and empty ones included; of a redelivered file_id the first arrived row."""
    files = spark.read.parquet(f"{d}/prepared_files.parquet").withColumn("_lone", F.when(F.col("file_id").isNull(), F.monotonically_increasing_id()))
    first = F.min_by(F.struct(*[c for c in files.columns if c != "_lone"]), F.struct("arrived_at", "content"))
    return redact(files.groupBy("file_id", "_lone").agg(first.alias("_p")).select("_p.*"))


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted}
