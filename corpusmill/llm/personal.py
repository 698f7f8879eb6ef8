"""Personal data in free text: email addresses, phone numbers, identity numbers, street addresses and names.

Formats give the items that tell themselves. Names and identity numbers are found by bootstrapping: seed items (names
before an address in trailers, numbers behind a document's name) induce patterns (the words to the left and right, the
given name, the surname); Spark scores patterns by the known share of their different items and items by their patterns,
round by round, and items of patterns with high confidence become known. A context without a word (the start of a line, a
comment mark) is no pattern, and an item is no name where most of its mentions share a word with a known one ("As Ada" in
"As Ada Zander").

Source files are searched in their comments, other texts whole. An item over more lines counts at its first. Null, empty
and blank texts have no rows, nor have null doc_ids; rows of one doc_id count once. Extra columns are ignored.
"""
import re

import pandas as pd
from pyspark.sql import functions as F

from corpusmill.llm.common import checkpoints, table

# Local parts that name a role or a machine.
ROLES = frozenset("abuse admin administrator alerts bot bots build builds ci contact daemon dev devnull enquiries feedback git help hello hostmaster info jenkins list lists mail mailer mailer-daemon maintainers marketing news newsletter no-reply noreply notifications office ops postmaster press privacy root sales security service support sysadmin system team webmaster".split())
AT = r"(?:@|\s?[\[(]\s?at\s?[\])]\s?|\s?&#64;\s?|%40)"
DOT = r"(?:\.|\s?[\[(]\s?(?:dot|punkt|point)\s?[\])]\s?)"
EMAIL = re.compile(rf"(?i)(?<![\w.+-])(?P<local>[\w][\w.+-]*?)(?:{AT}(?P<domain>[\w-]+(?:{DOT}[\w-]+)*{DOT}[a-z]{{2,24}})|\sat\s[\w-]+(?:\sdot\s[\w-]+)*\sdot\s[a-z]{{2,24}})(?![\w@])(?!:[\w~/]|/[\w.-]+\.git)")
PHONE = re.compile(r"""(?x)(?<![\w.+/$\#-])(?:
    (?:\+|00)[1-9]\d{0,2}[ .-]?(?:\(0\)[ .-]?)?\d{1,4}(?:[ .-]?\d{1,5}){1,5}
    | \(0?\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}
    | [2-9]\d{2}(?P<s>[ .-])\d{3}(?P=s)\d{4}
    | 0[1-9](?:[ .]\d{2}){4}
    | 0[1-9]\d{2,3}[ -/]\d{5,8}
    )(?:\s?(?:ext\.?|x)\s?\d{1,5})?(?![\w]|[.-]\d)""")
DIGITS = re.compile(r"\D")
# What documents with a personal number are called.
DOCUMENT = r"(?:passport|pasaporte|passeport|reisepass|ssn|social\ security|national\ id(?:entity)?|identity\ card|id\ card|personalausweis|ausweis|dni|nie|nif|n°\ s[ée]cu|s[ée]curit[ée]\ sociale|steuer-?id|steuernummer|tax\ id|tin|driver'?s?'?\s?licen[cs]e|driving\ licen[cs]e|führerschein|permis\ de\ conduire|insurance\ n(?:o|umber)|nino)"
NUMBER = r"(?=[\dA-Z -]{0,8}\d)(?:[A-Z]{1,6}[- ]?)?\d[\dA-Z]*(?:[ .-][\dA-Z]+)*"
ID = re.compile(rf"(?<!\w)(?:(?i:{DOCUMENT})(?i:\s*(?:no|nr|number|num|n°|º)\b\.?)?[\s:=#.]{{0,3}})(?P<v>{NUMBER})(?!\w)".replace(r"\ ", " "))
STREETS = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.?|Court|Gardens|Terrace|Way|Blvd|Boulevard|Place|Square|Close|Crescent|Mews|Parkway|Highway)"
BREAK = r"(?:,\s*|[ \t]*\r?\n[ \t]*(?:(?://|\#|--|\*)[ \t]*)?)"
ADDRESS = re.compile(rf"""(?x)(?<![\w.-])(?:
    (?:(?:Flat|Unit|Apt\.?|Suite|Apartment)\ \d+[A-Za-z]?{BREAK})?\d{{1,5}}[A-Za-z]?\ (?:[A-ZÀ-Þ][\w'’-]+\ ){{1,3}}{STREETS}(?!\w)
    | \d{{1,4}}(?:\ ?(?:bis|ter))?,?\ (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route)\ (?:(?:de\ la|des|du|de)\ |de\ l['’]|d['’])?[A-ZÀ-Þ][\w'’-]+
    | (?:Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Carretera|C/)\ (?:(?:de\ la|de\ los|de\ las|del|de)\ )?[A-ZÀ-Þ][\w'’-]+,?\ (?:n\.?º\ ?)?\d{{1,4}}
    | [A-ZÄÖÜ][\wäöüß-]+(?:weg|stra(?:ß|ss)e|str\.|gasse|platz|allee|damm)\ \d{{1,4}}\ ?[a-z]?(?!\w)
    | (?:P\.?\ ?O\.?\ ?Box|Postfach|Apartado(?:\ de\ correos)?|Boîte\ postale|Casilla)\ \d+
    )""")
WORDS = r"[A-ZÀ-ÞŁŚŠŽČ][\w'’]+(?:-[A-ZÀ-ÞŁŚŠŽČ][\w'’]+)*"
NAMEPAIR = re.compile(rf"(?<![\w@.'’`-])(?=(?P<x>{WORDS})(?P<m>(?:\ [A-Z]\.)*)(?P<sep>,?\ |[ \t]*\r?\n[ \t]*)(?P<y>{WORDS})(?![\w'’@`(-]|\.\w))")
TRAILER = re.compile(r"(?i)(?:[\w-]+-by|authors?|maintainers?|written by|cc|from|contributors?|developers?|reported by|reviewed by)\s*:\s*$")
TOKEN = re.compile(r"[\w'’-]+|[^\w\s]")
COMMENT = re.compile(r"\s*(?://|#(?!\s*(?:include|define|if|ifdef|ifndef|endif|pragma)\b)|/\*|\*|--|;|<!--|'''|\"\"\")|.*?\s(?://|#|--)\s")
OPENS = ("//", "#", "*", "--", ";", '"""', "'''", "{-", "=begin")
TRAILING = re.compile(r"(?!\s*(?://|#|/\*|\*|--|;|<!--|'''|\"\"\"))")  # the line begins with code
# Strings of one line, and what begins a comment outside them.
CODE = re.compile(r"""(?x)(?P<triple>\"{3}|'{3}) | "(?:\\.|[^"\\])*" | '(?:\\.|(?!\s//\s)[^'\\])*' | `[^`]*`
    | (?P<block>/\*|<!--|\{-(?=[\s|\#-])|\(\*(?=\s)|--\[=*\[) | (?P<line>(?<![:\w/])//|(?<=\s)(?://|\#(?![\w]*["{\[!])|(?:--|;+)(?=\s))|(?<=[,;)])[ \t]*--(?=\S))""")
CLOSE = {"/*": "*/", "<!--": "-->", "{-": "-}", "(*": "*)"}
ROUNDS, SUPPORT = 4, 2


def email_ok(m):
    local = m["local"].lower().lstrip("._+-")
    return local.split("+")[0] not in ROLES and not re.fullmatch(r"v?\d[\d.]*", local)


def phone_ok(v):
    n = len(DIGITS.sub("", re.split(r"\s?(?:ext|x)", v)[0]))
    return 9 <= n <= 15


def context(text, start, end):
    """Two tokens to the left and right, digits masked; the ends of a line count as tokens."""
    left = text[max(0, start - 60) : start].rpartition("\n")
    right = text[end : end + 60].partition("\n")
    a = TOKEN.findall(left[2])
    b = TOKEN.findall(right[0])
    mask = lambda w: re.sub(r"\d+", "0", w)
    return " ".join((["^"] + [mask(w) for w in a])[-2:]), " ".join(([mask(w) for w in b] + ["$"])[:2])


def commented(line, at, inside, text):
    """(column where comments begin in a line, or None; what closes the block that stays open; whether the block is a string of data). at: the line's offset in text; inside: the open block as (what closes it, data)."""
    begin, k = None, 0
    if inside:
        close, data = inside
        p = line.find(close)
        if not data:
            begin = 0
        elif COMMENT.match(line) and not line.lstrip().startswith(close):
            begin = 0
        if p < 0 or close == "=end" and p > 0:
            return begin, inside
        k = p + len(close)
    elif COMMENT.match(line) and not TRAILING.match(line):
        begin = 0
        if re.match(r"\s*(?://|#(?!\[)|;|--(?!\[=*\[))", line):
            return 0, ("=end", False) if line.startswith("=begin") else None
    if line.startswith("=begin"):
        return 0, ("=end", False)
    while m := CODE.search(line, k):
        k = m.end()
        kind, first = m.lastgroup, not line[: m.start()].strip(" \trRuUbBfF")
        if kind == "line":
            return (k if m[0].endswith("--") else m.start()) if begin is None else begin, None  # "--x@y" is no address
        if kind in ("block", "triple"):
            close = CLOSE.get(m[kind], m[kind]) if not m[kind].startswith("--[") else m[kind][2:].replace("[", "]")
            data = kind == "triple" and not first
            p = line.find(close, k)
            joined = not first and m.start() and re.match(r"[\w./*~$-]", line[m.start() - 1])
            if p < 0 and (text.find(close, at + k) < 0 and not (first and m[kind] == "/*") or joined and kind == "block"):
                continue  # a glob or an operator: nothing closes it
            if not data and begin is None:
                begin = m.start()
            if p < 0:
                return begin, (close, data)
            k = p + len(close)
    return begin, None


def segments(text, source):
    """(offset, part) of what is searched: whole texts, and of a source file its comments, those of successive lines as one."""
    if source != "tarball":
        return [(0, text)]
    out, inside, at, start = [], None, 0, None
    for line in text.split("\n"):
        begin = None
        if inside or any(x in line for x in OPENS):
            begin, inside = commented(line, at, inside, text)
        if start is not None and begin != 0:
            out.append((start, text[start:at]))
            start = None
        if start is None and begin is not None:
            start = at + begin
        at += len(line) + 1
    if start is not None:
        out.append((start, text[start:]))
    return out


MARKS = ("@", "at)", "at]", "at )", "at ]", " dot ", "64;", "%40", "AT)", "AT]")
NINE = re.compile(r"\d(?:[ .()/-]{0,3}\d){8}")
FIVE = re.compile(r"(?:\d\D{0,12}){5}")
STREET = re.compile(rf"(?:weg|stra(?:ß|ss)e|str\.|gasse|platz|allee|damm) \d|\b(?:{STREETS}|rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|Calle|Avenida|Avda|Plaza|Paseo|Camino|Carretera|C/|Box|Postfach|Apartado|postale|Casilla)(?!\w)")


def scan(text, source):
    """(kind, start, end, item, left, right, given, surname, seed, rival) of what formats find, and of candidates for names and numbers (item not null); rival: the next candidate, if it begins with this one's last word."""
    out = []
    for offset, part in segments(text, source):
        taken, at = [], 0

        def take(kind, pattern, lo, hi, ok):
            for m in pattern.finditer(part, lo, hi):
                s, e = m.span("v") if kind == "id_number" else m.span()
                if (ok is None or ok(m)) and not any(a < e and s < b for a, b in taken):
                    taken.append((s, e))
                    left, right = context(part, s, e) if kind == "id_number" else (None, None)
                    out.append((kind, offset + s, offset + e, m["v"].lower() if kind == "id_number" else None, left, right, None, None, True, None))

        before = 0
        for line in part.split("\n"):
            end = at + len(line)
            if any(w in line for w in MARKS):
                take("email", EMAIL, at, end, email_ok)
            if any(c in line for c in "0123456789"):
                if STREET.search(line):
                    take("address", ADDRESS, before, end, None)
                if FIVE.search(line):
                    take("id_number", ID, at, end, lambda m: len(DIGITS.sub("", m["v"])) >= 5)
                if NINE.search(line):
                    take("phone", PHONE, at, end, lambda m: phone_ok(m[0]))
            before, at = at, end + 1
        names = []
        for m in NAMEPAIR.finditer(part):
            x, y, sep = m["x"], m["y"], m["sep"]
            s, e = m.start("x"), m.end("y")
            flipped = sep.startswith(",")
            if flipped and m["m"] or any(a < e and s < b for a, b in taken):  # words of an address or another item are no name
                continue
            left, right = context(part, s, e)
            given, surname = (y, x) if flipped else (x, y)
            seed = bool(re.match(r"\s*<", part[e : e + 3])) and bool(TRAILER.search(part[max(0, s - 40) : s]))
            names.append(("name", offset + s, offset + e, f"{given} {surname}".lower(), left, right, given.lower(), surname.lower().rpartition("-")[2], seed))
        out += [(*x, y[3] if y and y[1] < x[2] else None) for x, y in zip(names, [*names[1:], None])]
    return out


SCAN = "doc_id long, line_no long, kind string, s int, e int, item string, l string, r string, g string, n string, seed boolean, rival string"


def candidates(docs):
    def run(batches):
        for b in batches:
            out = []
            for i, text, source in zip(b.doc_id, b.text, b.source):
                for kind, s, e, *rest in scan(text, source):
                    out.append((i, text.count("\n", 0, s) + 1, kind, s, e, *rest))
            yield pd.DataFrame(out, columns=["doc_id", "line_no", "kind", "s", "e", "item", "l", "r", "g", "n", "seed", "rival"])

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text", "source").mapInPandas(run, SCAN)


def known_names(found):
    """The items of found (kind name) that bootstrapping makes known, as rows (item)."""
    checkpoints(found.sparkSession)
    names = found.where("kind = 'name'")
    parts = F.explode(F.array(*[F.concat(F.lit(f"{p}:"), F.col(p)) for p in "lrgn"], F.concat(F.lit("b:"), F.col("l"), F.lit(" _ "), F.col("r"))))
    told = F.col("pattern").rlike("^[gn]:") | F.regexp_replace(F.substring("pattern", 3, 1 << 30), " _ ", " ").rlike(r"\p{L}")
    edges = names.select("item", parts.alias("pattern")).where("pattern is not null").where(told).distinct().checkpoint()
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size")).where(f"size >= {SUPPORT}")
    edges = edges.join(sizes, "pattern").checkpoint()  # (pattern, item, size): the graph
    mentions = names.select("doc_id", "s", "item", "rival").distinct()
    beside = mentions.where("rival is not null").select("item", "rival")
    beside = beside.unionByName(beside.select(F.col("rival").alias("item"), F.col("item").alias("rival"))).groupBy("item", "rival").agg(F.count(F.lit(1)).alias("shared"))
    beside = beside.join(mentions.groupBy("item").agg(F.countDistinct("doc_id", "s").alias("mentions")), "item").checkpoint()
    known = names.where("seed").select("item").distinct().checkpoint()
    for _ in range(ROUNDS):
        good = edges.join(known, "item", "left_semi").groupBy("pattern", "size").agg(F.count(F.lit(1)).alias("hits"))
        good = good.select("pattern", "hits", (F.col("hits") / F.col("size")).alias("p")).where("hits >= 2")
        kind = F.when(F.col("pattern").startswith("g:"), "g").when(F.col("pattern").startswith("n:"), "n").otherwise("c")
        best = [F.coalesce(F.max(F.when(F.col("t") == t, F.col("p"))), F.lit(0.0)).alias(t) for t in "cgn"]
        score = edges.join(good, "pattern").withColumn("t", kind).groupBy("item").agg(*best, F.coalesce(F.max(F.when((F.col("t") == "c") & (F.col("p") >= 0.8), F.col("hits"))), F.lit(0)).alias("h"))
        more = score.where("g >= 0.25 or g >= 0.1 and greatest(n, c) >= 0.1 or n >= 0.25 and c >= 0.25 or c >= 0.8 and h >= 5").select("item")
        part = beside.join(known.withColumnRenamed("item", "rival"), "rival", "left_semi").groupBy("item").agg(F.sum("shared").alias("shared"), F.max("mentions").alias("mentions")).where("2 * shared >= mentions")
        known = known.unionByName(more.join(part, "item", "left_anti")).distinct().checkpoint()
    return known


def personal(docs):
    """docs (doc_id, text, source) to (doc_id, line_no, kind, s, e): every item once, with its range in code points."""
    found = candidates(docs).checkpoint()
    names = found.where("kind = 'name'").join(known_names(found), "item", "left_semi")
    return found.where("kind <> 'name'").unionByName(names.select(*found.columns)).select("doc_id", "line_no", "kind", "s", "e").distinct()


def p9_found(spark, d):
    checkpoints(spark)
    return personal(table(spark, d, "documents")).select("doc_id", "line_no", "kind").distinct()


def p9_redacted(spark, d):
    """(doc_id, text): every document with typed placeholders for its items; of overlapping items the first and longest counts. Null texts stay null; rows without doc_id are left out, as nothing names them."""
    checkpoints(spark)
    docs = table(spark, d, "documents").where("doc_id is not null").select("doc_id", "text", "source")
    spans = personal(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", (-F.col("e")).alias("e"), "kind"))).alias("items"))  # bounded by one text

    def fill(text: pd.Series, items: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(text, items):
            parts, at = [], 0
            for x in found if found is not None and t is not None else ():
                if x["s"] >= at:
                    parts += [t[at : x["s"]], f"[{x['kind'].upper()}]"]
                    at = -x["e"]
            out.append(t if t is None else "".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    return docs.dropDuplicates(["doc_id"]).join(spans, "doc_id", "left").select("doc_id", F.pandas_udf(fill, "string")("text", "items").alias("text"))


QUERIES = {"p9_found": p9_found, "p9_redacted": p9_redacted}
