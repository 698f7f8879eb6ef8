"""Filling containers of fixed capacity with texts sized in tokens.

Sizes are whole numbers up to the capacity, so the instance is a histogram of at most that many classes, however many
texts there are: Spark counts it, and only the histogram reaches the driver. Martello-Toth reduction fixes, from the largest
size down, sets of up to three items that dominate every other way to use their container; what is left goes best-fit
decreasing. Both work on whole classes and give patterns with multiplicities. A text finds its container by its rank within
its size class, which partitions number by themselves and a table of their counts makes global: no class meets in one task.

A text beyond the capacity is split into pieces of the whole capacity and a rest, an item like others. Null and empty texts
have no tokens and go, spread evenly, to the ends of the containers made (to container 0 if there is none). Every row has
its own result, also where doc_id repeats or is null. Extra columns are ignored.
"""
import base64
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Window as W, functions as F

from corpusmill.llm.common import checkpoints, table

PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the tokenizer's split pattern
MAX_PLAN = 500_000
MAX_CAPACITY = 1 << 20  # of the histogram on the driver


def largest(sizes, most):
    """The largest of the ascending sizes up to most, or 0."""
    k = bisect_right(sizes, most)
    return sizes[k - 1] if k else 0


class Stock:
    """Items by size, with their number."""

    def __init__(self, histogram):
        self.n = {s: c for s, c in histogram.items() if s > 0 and c > 0}
        self.sizes = sorted(self.n)

    def take(self, parts, times):
        for s in parts:
            self.n[s] -= times
            if not self.n[s]:
                del self.n[s]
                self.sizes.pop(bisect_right(self.sizes, s) - 1)

    def times(self, parts):
        return min(self.n[s] // parts.count(s) for s in set(parts))

    def without(self, parts, k):
        """The k smallest items besides these, ascending."""
        out = []
        for s in self.sizes:
            out += [s] * min(k - len(out), self.n[s] - parts.count(s))
            if len(out) == k:
                break
        return out

    def fits(self, parts, most):
        """The largest size up to most of which an item is left besides these, or 0."""
        k = bisect_right(self.sizes, most)
        while k:
            s = self.sizes[k - 1]
            if self.n[s] > parts.count(s):
                return s
            k -= 1
        return 0


def dominating(stock, capacity, j):
    """A set with an item of size j that dominates every feasible set with it, or None."""
    room = capacity - j
    k = stock.fits((j,), room)
    if not k:
        return (j,)
    least = stock.without((j,), 3)
    if k == room or len(least) < 2 or least[0] + least[1] > room:
        return (j, k)  # a full container, or one further item at most
    if len(least) < 3 or sum(least) > room:  # two further items at most
        best, at = 0, None
        for a in reversed(stock.sizes[: bisect_right(stock.sizes, room)]):
            if 2 * a <= best:
                break
            b = stock.fits((j, a), min(a, room - a)) if stock.n[a] > (a == j) else 0
            if b and a + b > best:
                best, at = a + b, (a, b)
        if k >= best:
            return (j, k)  # the two items of any pair fit where k would go
        a, b = at
        if a == k and b == stock.fits((j, a), room - a):
            rest = [s for s in stock.without((j,), len(stock.sizes) + 4) if s > b][:2]
            if len(rest) < 2 or sum(rest) > room:
                return (j, a, b)  # of any pair one item fits where a is and the other where b is
    return None


def packed(histogram, capacity):
    """Patterns (sizes, times): every item of the histogram (size: number, sizes up to the capacity) in one place."""
    stock, patterns, changed = Stock(histogram), defaultdict(int), True
    while changed:  # each pass takes at least one set out, by all that are alike
        changed = False
        for j in sorted(stock.sizes, reverse=True):
            while j in stock.n and (parts := dominating(stock, capacity, j)):
                times = stock.times(parts)
                patterns[tuple(sorted(parts, reverse=True))] += times
                stock.take(parts, times)
                changed = True
    rest = stock.n
    open_ = defaultdict(lambda: defaultdict(int))  # room: pattern: times
    rooms = []
    for s in sorted(rest, reverse=True):
        n = rest[s]
        while n:
            k = bisect_right(rooms, s - 1)
            if k == len(rooms):  # a new container, filled with as many as fit
                each = min(n, capacity // s)
                times, parts, room = n // each, (s,) * each, capacity - s * each
                n -= times * each
            else:
                room = rooms[k]
                parts, have = open_[room].popitem()
                times = min(n, have)
                if have > times:
                    open_[room][parts] = have - times
                if not open_[room]:
                    rooms.pop(k)
                    del open_[room]
                parts, room, n = (*parts, s), room - s, n - times
            if room not in open_:
                rooms.insert(bisect_right(rooms, room), room)
            open_[room][parts] += times
    for by in open_.values():
        for parts, times in by.items():
            patterns[parts] += times
    return sorted(patterns.items(), reverse=True)


def sized(docs, capacity, path):
    """docs (doc_id, text) to items (doc_id, piece, start_token, tokens, part, local): a piece's number, first token and size; part and local number the items of a size."""
    with open(path, "rb") as f:
        raw = f.read()

    def run(batches):
        import tiktoken
        from pyspark import TaskContext

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        part, local = TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            out = []
            for i, t in zip(b.doc_id, b.text):
                n = len(e.encode_ordinary(t)) if t else 0
                for piece, start in enumerate(range(0, max(n, 1), capacity)):
                    size = min(capacity, n - start)
                    out.append((None if pd.isna(i) else int(i), piece, start, size, part, local[size]))
                    local[size] += 1
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start_token", "tokens", "part", "local"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, piece int, start_token long, tokens int, part int, local long")


def fill(docs, capacity, path):
    """docs (doc_id, text) to (doc_id, piece, start_token, tokens, container, position, at): position counts within the container, at is the tokens before."""
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"the capacity must be within 1 and {MAX_CAPACITY}")
    spark = docs.sparkSession
    checkpoints(spark)
    items = sized(docs, capacity, path).checkpoint()
    counts = items.groupBy("tokens", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("tokens").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).checkpoint()
    histogram = {r.tokens: r.n for r in before.groupBy("tokens").agg(F.sum("n").alias("n")).collect()}  # at most capacity + 1 rows
    rows, base, done, fills = [], 0, defaultdict(int), []
    for parts, times in packed(histogram, capacity):
        at = 0
        for position, s in enumerate(parts):
            rows.append((s, done[s], done[s] + times, base - done[s], position, at))
            done[s] += times
            at += s
        fills.append((base, base + times, len(parts), at))
        base += times
    # the plan's size depends on the sizes that occur, not on the number of texts; it is broadcast up to MAX_PLAN rows and joined by shuffle beyond
    plan = spark.createDataFrame(pd.DataFrame(rows, columns=["tokens", "lo", "hi", "shift", "position", "at"]), "tokens int, lo long, hi long, shift long, position int, at int")
    ranked = items.join(F.broadcast(before.drop("n")) if before.count() < 100_000 else before.drop("n"), ["tokens", "part"]).withColumn("rank", F.col("before") + F.col("local"))
    own = ranked.where("tokens > 0").join(F.broadcast(plan) if len(rows) <= MAX_PLAN else plan, "tokens").where("rank >= lo and rank < hi")
    columns = ["doc_id", "piece", "start_token", "tokens"]
    own = own.select(*columns, (F.col("rank") + F.col("shift")).alias("container"), "position", "at")
    fills = np.array(fills or [(0, 1, 0, 0)])

    def end(container: pd.Series) -> pd.DataFrame:
        k = np.searchsorted(fills[:, 0], container.to_numpy(), "right") - 1
        return pd.DataFrame({"size": fills[k, 2].astype(np.int32), "at": fills[k, 3].astype(np.int32)})

    none = ranked.where("tokens = 0").withColumn("container", F.col("rank") % max(base, 1)).withColumn("turn", F.floor(F.col("rank") / max(base, 1)))
    none = none.withColumn("end", F.pandas_udf(end, "size int, at int")("container")).select("*", "end.size", "end.at")
    none = none.select(*columns, "container", (F.col("size") + F.col("turn")).cast("int").alias("position"), "at")
    return own.unionByName(none)


def p8_packed(spark, d, path="/opt/tokenizers/byte_bpe_50k.tiktoken"):
    """Every text of documents in containers of the standard capacity."""
    capacity = table(spark, d, "containers").where("container = 'standard'").agg(F.max("capacity")).first()[0]
    return fill(table(spark, d, "documents"), int(capacity), path)


def p8_containers(spark, d):
    """(container, texts, tokens): what each container of p8_packed holds."""
    return p8_packed(spark, d).groupBy("container").agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("tokens"))


QUERIES = {"p8_packed": p8_packed, "p8_containers": p8_containers}
