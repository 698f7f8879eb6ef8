"""Long exact spans shared between records, by difference-cover anchors.

Positions modulo a period belong to a difference cover, so any two equal runs of at least the least length have a pair of
covered positions at the same offset within less than a period. Windows are hashed only there. Hashes are packed into blobs
by (batch, bucket) and compared bucket by bucket; the buckets' number grows with the data. (What decides are 64-bit hashes
of whole windows.) Records with a repeated anchor go on: windows of the full
length are compared at the covered positions near anchors, which settles the inside of long runs. Anchors that open
positions depend on are then looked up in all records, and windows are compared at every open position and around those
anchors, which finds the exact ends. No pairs of records are formed at any point.

Null ids or contents have no rows; a null group is a group of its own; rows of one id are taken to hold the same content
and count once. Contents below the least length share nothing. Extra columns are ignored.
"""
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corpusmill.llm.common import checkpoints, table

# Perfect difference sets by their period.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27), 57: (0, 1, 3, 13, 32, 36, 43, 52), 73: (0, 1, 3, 7, 15, 31, 36, 54, 63), 133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109), 183: (0, 1, 3, 16, 23, 28, 42, 76, 82, 86, 119, 137, 154, 175)}
WINDOWS_A_BUCKET = 600_000
HOT = 8
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
POWERS = {}


def powers(n):
    """BASE and its inverse to the powers below n, kept by the worker."""
    if len(POWERS.get("p", ())) < n:
        m = max(n, 1 << 16)
        for k, b in (("p", BASE), ("i", BASE_INVERSE)):
            a = np.full(m, b, np.uint64)
            a[0] = 1
            POWERS[k] = np.cumprod(a)
    return POWERS["p"][:n], POWERS["i"][:n]


def points(text):
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def window_hashes(prefix, at, width):
    """64-bit hashes of the windows of this width at these positions; prefix comes from prefixes()."""
    _, inverse = powers(len(prefix))
    x = (prefix[at + width] - prefix[at]) * inverse[at]
    x ^= x >> np.uint64(32)  # mixed: the low bits of a polynomial depend on low bits only
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def prefixes(text):
    a = points(text).astype(np.uint64) + np.uint64(1)
    p, _ = powers(len(a) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(a * p[: len(a)])])


def period_for(least):
    """The largest period of COVERS up to half the least length: longer windows are repeated less, shorter periods have more of them."""
    return max([p for p in COVERS if p <= least / 2], default=1)


def covered(n, period):
    """Ascending covered positions below n."""
    if n <= 0:
        return np.empty(0, np.int64)
    cover = np.array(sorted(COVERS.get(period, (0,))), np.int64)
    at = (np.arange(0, n, period, dtype=np.int64)[:, None] + cover).ravel()
    return at[at < n]


def ranges(at, width):
    """Maximal ranges (starts, ends) covered by windows of this width at ascending positions."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.flatnonzero(at[1:] > at[:-1] + width)
    return at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + width


def before(at, n, least, period):
    """Ranges of the starts below n - least + 1 whose windows can hold one of these anchors."""
    lo, hi = ranges(at - (period - 1), period)
    return np.maximum(lo, 0), np.minimum(hi, n - least + 1)


def open_starts(anchors, shared, n, least, period):
    """Starts that anchors allow and whose windows aren't inside what is known to be shared."""
    s, e = ranges(shared, least)
    at = np.concatenate([np.arange(a, b, dtype=np.int64) for a, b in zip(*before(anchors, n, least, period)) if b > a] or [np.empty(0, np.int64)])
    if not len(s):
        return at
    k = np.searchsorted(s, at, "right") - 1
    return at[(k < 0) | (at + least > e[np.maximum(k, 0)])]


def wanted(stage, row, n, least, period):
    """Positions to hash, width of their windows, and flags of those that are asked for (stage "ask" only)."""
    if stage == "anchors":
        return covered(n - (least - period), period), least - period + 1, None
    anchors = as_array(row["anchors"])
    if stage == "near":
        at = covered(n - least + 1, period)
        lo, hi = before(anchors, n, least, period)
        k = np.searchsorted(lo, at, "right") - 1
        return at[(k >= 0) & (at < hi[np.maximum(k, 0)])], least, None
    starts = open_starts(anchors, as_array(row["shared"]), n, least, period)
    if stage == "ask":
        return anchors, least - period + 1, np.searchsorted(starts, anchors, "right") > np.searchsorted(starts, anchors - (period - 1), "left")
    more = [np.arange(a, b, dtype=np.int64) for a, b in zip(*before(as_array(row["asked"]), n, least, period)) if b > a]
    return np.unique(np.concatenate([starts, *more])), least, None


def as_array(b, kind=np.int32):
    return np.frombuffer(b, kind).astype(np.int64) if b is not None else np.empty(0, np.int64)


def repeated(df, least, period, buckets, stage):
    """(id, at): of each row, the packed wanted positions whose window also occurs in another group; in stage "ask", those whose window is asked for anywhere.

    A batch sends a window that it has more than HOT times as two occurrences, those of its least and greatest group; the
    others stay pending in a row of the batch and are joined by hash with the windows found, so no bucket grows with a hot
    window.
    """
    wide = stage in ("near", "rest")  # these say what is shared: whole hashes; the others only choose what is looked at
    kind = np.uint64 if wide else np.uint32
    columns = ["bucket", "h", "r", "at", "ids", "g", "gk", "f"]

    def names(h, bucket):
        return h.astype(np.int64) if wide else (h & np.uint64(0xFFFFFFFF)).astype(np.int64) | bucket.astype(np.int64) << 32

    def emit(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 20
        for b in batches:
            number += 1
            groups, gk = pd.factorize(b.group)
            gk, keys = gk.to_numpy(np.int64), b["id"].to_numpy(np.int64)
            hs, rows, ats, fs = [], [], [], []
            extra = {c: b[c].tolist() for c in ("anchors", "shared", "asked") if c in b}
            for i, text in enumerate(b.content):
                text = text if isinstance(text, str) else zlib.decompress(text).decode("utf-8", "surrogatepass")
                at, width, flags = wanted(stage, {c: v[i] for c, v in extra.items()}, len(text), least, period)
                if len(at):
                    hs.append(window_hashes(prefixes(text), at, width))
                    rows.append(np.full(len(at), i, np.uint32))
                    ats.append(at.astype(np.uint32))
                    fs.append(np.zeros(len(at), np.uint8) if flags is None else flags.astype(np.uint8))
            if not hs:
                continue
            h, r, at, f = np.concatenate(hs), np.concatenate(rows), np.concatenate(ats), np.concatenate(fs)
            order = np.lexsort((groups[r], h)) if len(b) else np.empty(0, np.int64)
            h, r, at, f = h[order], r[order], at[order], f[order]
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # ascending, as h is
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[start, len(h)])
            out = []
            if (size > HOT).any():
                hot = np.repeat(size > HOT, size)
                ends = np.zeros(len(h), bool)
                ends[start] = ends[start + size - 1] = True
                f = np.where(hot, np.repeat(np.maximum.reduceat(f, start), size) | 2, f).astype(np.uint8)
                name = names(h[hot], bucket[hot])
                cuts = np.flatnonzero(np.diff(name)) + 1
                for x, y in zip(np.r_[0, cuts], np.r_[cuts, len(name)]):
                    out.append((-number, name[x : x + 1].tobytes(), b"", at[hot][x:y].astype(np.int32).tobytes(), keys[r[hot][x:y]].tobytes(), b"", b"", b""))
                keep = ~hot | ends
                h, r, at, f, bucket = h[keep], r[keep], at[keep], f[keep], bucket[keep]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for x, y in zip(np.r_[0, cuts], np.r_[cuts, len(h)]):
                used, code = np.unique(r[x:y], return_inverse=True)
                used_groups, g = np.unique(groups[used], return_inverse=True)
                out.append((int(bucket[x]), h[x:y].astype(kind).tobytes(), code.astype(np.uint16 if len(used) <= 65536 else np.uint32).tobytes(), at[x:y].astype(np.uint16 if at[x:y].max() < 65536 else np.uint32).tobytes(), keys[used].tobytes(), g.astype(np.uint32).tobytes(), gk[used_groups].tobytes(), f[x:y].tobytes() if f[x:y].any() else b""))
            yield pd.DataFrame(out, columns=columns)

    def made(out):
        id_, at, name, found = zip(*out) if out else ((), (), (), ())
        return pd.DataFrame({"id": pd.array(id_, dtype="Int64"), "at": pd.Series(at, dtype=object), "name": pd.array(name, dtype="Int64"), "found": pd.Series(found, dtype=bool)})

    def match(frame):
        out = []
        if frame.bucket.iloc[0] < 0:  # what a batch keeps pending
            for h, at, ids in zip(frame.h, frame["at"], frame.ids):
                name, at, ids = int(np.frombuffer(h, np.int64)[0]), np.frombuffer(at, np.int32), np.frombuffer(ids, np.int64)
                order = np.argsort(ids, kind="stable")
                cuts = np.flatnonzero(np.diff(ids[order])) + 1
                out += [(int(ids[order[p]]), at[order[p:q]].tobytes(), name, False) for p, q in zip(np.r_[0, cuts], np.r_[cuts, len(ids)])]
            return made(out)
        hs, gs, fs = [], [], []
        for h, r, g, gk, f in zip(frame.h, frame.r, frame.g, frame.gk, frame.f):
            h = np.frombuffer(h, kind)
            r = np.frombuffer(r, np.uint16 if len(r) == 2 * len(h) else np.uint32)
            hs.append(h)
            gs.append(np.frombuffer(gk, np.int64)[np.frombuffer(g, np.uint32)][r])
            fs.append(np.frombuffer(f, np.uint8) if f else np.zeros(len(h), np.uint8))
        h, g, f = np.concatenate(hs), np.concatenate(gs), np.concatenate(fs)
        order = np.argsort(h, kind="stable")
        sh, sg, sf = h[order], g[order], f[order]
        start = np.flatnonzero(np.r_[True, sh[1:] != sh[:-1]])
        many = np.maximum.reduceat(sf & 1, start) > 0 if stage == "ask" else np.minimum.reduceat(sg, start) != np.maximum.reduceat(sg, start)
        found = sh[start[many & (np.bitwise_or.reduceat(sf, start) & 2 > 0)]].astype(np.uint64)
        out += [(None, None, int(n), True) for n in names(found, np.full(len(found), frame.bucket.iloc[0], np.uint64))]
        hit = np.empty(len(h), bool)
        hit[order] = np.repeat(many, np.diff(np.r_[start, len(sh)]))
        hit &= f & 2 == 0
        x = 0
        for raw, r, at, ids in zip(frame.h, frame.r, frame["at"], frame.ids):
            n = len(raw) // kind().nbytes
            k = np.flatnonzero(hit[x : x + n])
            x += n
            if len(k):
                r = np.frombuffer(r, np.uint16 if len(r) == 2 * n else np.uint32)[k]
                at = np.frombuffer(at, np.uint16 if len(at) == 2 * n else np.uint32)[k].astype(np.int32)
                order = np.argsort(r, kind="stable")
                r, at, ids = r[order], at[order], np.frombuffer(ids, np.int64)
                cuts = np.flatnonzero(np.diff(r)) + 1
                out += [(int(ids[r[p]]), at[p:q].tobytes(), None, False) for p, q in zip(np.r_[0, cuts], np.r_[cuts, len(r)])]
        return made(out)

    blobs = df.mapInPandas(emit, "bucket long, h binary, r binary, at binary, ids binary, g binary, gk binary, f binary")
    got = blobs.groupBy("bucket").applyInPandas(match, "id long, at binary, name long, found boolean").checkpoint()
    known = got.where("name is null").select("id", "at")
    later = got.where("name is not null and not found").join(got.where("found").select("name").distinct(), "name").select("id", "at")
    return known.unionByName(later).groupBy("id").agg(F.collect_list("at").alias("at"))  # bounded by one content


def shared_spans(df, least=300):
    """df (id, group, content) to (id, span_start, span_end): the maximal ranges, in code points, of positions that lie in a run of at least `least` that occurs verbatim in a row of another group."""
    checkpoints(df.sparkSession)
    period = period_for(least)
    rows = df.where("id is not null and content is not null").select(F.col("id").cast("long"), F.coalesce(F.col("group").cast("long"), F.lit(-(2**63))).alias("group"), "content")
    rows = rows.where(F.length("content") >= least)
    total = rows.agg(F.sum(F.length("content"))).first()[0] or 0
    size = len(COVERS.get(period, (0,)))
    buckets = max(1, int(total * size / period / WINDOWS_A_BUCKET))

    def sort(name):
        @F.pandas_udf("binary")
        def f(col: pd.Series) -> pd.Series:
            return pd.Series([np.unique(np.concatenate([np.frombuffer(x, np.int32) for x in v])).tobytes() for v in col], dtype=object)

        return f("at").alias(name)

    anchors = repeated(rows, least, period, buckets, "anchors").select("id", sort("anchors"))
    def pack(col: pd.Series) -> pd.Series:
        return pd.Series([zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in col], dtype=object)

    packed = F.pandas_udf(pack, "binary")  # checkpoints aren't compressed
    near = rows.join(anchors, "id").dropDuplicates(["id"]).withColumn("content", packed("content")).checkpoint()
    few = max(1, buckets // 4)
    shared = repeated(near, least, period, few, "near").select("id", sort("shared"))
    open_ = near.join(shared, "id", "left").checkpoint()
    asked = open_.join(repeated(open_, least, period, few, "ask").select("id", sort("asked")), "id", "left")
    rest = repeated(asked, least, period, few, "rest").select("id", sort("rest"))

    def finish(batches):
        for b in batches:
            out = []
            for i, shared, rest in zip(b["id"], b.shared, b.rest):
                at = np.union1d(as_array(shared), as_array(rest))
                out += [(i, int(s), int(e)) for s, e in zip(*ranges(at, least))]
            yield pd.DataFrame(out, columns=["id", "span_start", "span_end"])

    return open_.select("id", "shared").join(rest, "id", "left").mapInPandas(finish, "id long, span_start long, span_end long")


def spans_of(spark, d):
    files = table(spark, d, "prepared_files").select(F.col("file_id").alias("id"), F.col("repo_id").alias("group"), "content")
    return shared_spans(files)


def p3_found(spark, d):
    return spans_of(spark, d).withColumnRenamed("id", "file_id")


def p3_shares(spark, d):
    """(file_id, n_chars, shared_chars, share): how much of each file is shared elsewhere; null and empty contents have no share of their own and get 0."""
    files = table(spark, d, "prepared_files").where("file_id is not null").select("file_id", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("n_chars")).groupBy("file_id").agg(F.max("n_chars").alias("n_chars"))
    sums = p3_found(spark, d).groupBy("file_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    got = files.join(sums, "file_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return got.withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))


QUERIES = {"p3_found": p3_found, "p3_shares": p3_shares}
