"""Corpus encoding through a distinct-word table, and decoding through an id-to-piece table.

Documents are cut into blocks of bounded size where they are read. A block keeps its own list of distinct words, and each
document as numbers into that list. Only (block, word) pairs are shuffled and joined with the table in which each distinct
word is encoded once; the block then turns its numbers into ids by position. No word has more than one row a block, and
texts aren't shuffled.

Null and empty texts have an empty id list; blank texts are encoded as they are. Each row has its own result, also where
document ids repeat or are null. Extra columns are ignored.
"""
import base64

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corpusmill.llm.common import checkpoints

# Fixed value: the vocabulary's split pattern, with Unicode white space named.
WORD = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
BLOCK_PARTS = 2_000_000  # words or ids after which a block is closed


def pack(numbers):
    """uint32 numbers as bytes: two bytes each below 65,536, else four; the first byte tells which."""
    a = np.asarray(numbers, dtype=np.uint32)
    return b"\2" + a.astype(np.uint16).tobytes() if not len(a) or a.max() < 65536 else b"\4" + a.tobytes()


def unpack(b):
    return np.frombuffer(b, np.uint16 if b[0] == 2 else np.uint32, offset=1)


def blocks(df, column, split, kind):
    """Rows (block, doc_ids, codes, parts) of df (doc_id, column): split makes a value's parts, parts lists the block's distinct ones by first use."""

    def run(batches):
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0

        def row():
            return pd.DataFrame({"block": [(task << 32) + number], "doc_ids": [ids], "codes": [codes], "parts": [list(seen)]})

        ids, codes, seen, size = [], [], {}, 0
        for b in batches:
            for i, v in zip(b.doc_id, b[column]):
                p = [] if v is None else split(v)
                size += len(p)
                ids.append(None if pd.isna(i) else int(i))
                codes.append(pack([seen.setdefault(w, len(seen)) for w in p]))
                if size >= BLOCK_PARTS:
                    yield row()
                    ids, codes, seen, size, number = [], [], {}, 0, number + 1
        if ids:
            yield row()

    # checkpoint: a block's number must not change when its rows are made again
    return df.select("doc_id", column).mapInPandas(run, f"block long, doc_ids array<long>, codes array<binary>, parts array<{kind}>").checkpoint()


def filled(made, table, value, finish, schema):
    """Joins each block's parts with table (part, value) and has finish(doc_ids, codes, values by code) make the rows."""
    parts = made.select("block", F.posexplode("parts").alias("code", "part"))
    known = parts.join(table, "part", "left").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("code", F.coalesce(value, F.raise_error(F.lit("no piece or ids for a part")).cast(table.schema[value].dataType)).alias("v")))).alias("known"))  # a block's parts are bounded
    rows = made.select("block", "doc_ids", "codes").join(known.select("block", F.col("known.v").alias("v")), "block", "left")

    def run(batches):
        for b in batches:
            for ids, codes, v in zip(b.doc_ids, b.codes, b.v):
                yield finish(ids, codes, [] if v is None else v)

    return rows.mapInPandas(run, schema)


def encode(docs, path):
    """docs (doc_id, text) to (doc_id, ids); path: a .tiktoken rank file, read on the driver and sent with the function (fixed size)."""
    checkpoints(docs.sparkSession)
    with open(path, "rb") as f:
        raw = f.read()

    def split(text):
        return pattern().findall(text)

    def run(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        e = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"part": b.part, "word_ids": [e.encode_ordinary(w) for w in b.part]})

    def finish(doc_ids, codes, values):
        n = np.array([len(x) for x in values], dtype=np.int64)
        flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in values]) if len(n) else np.empty(0, np.int32)
        start = np.cumsum(n) - n
        out = []
        for c in codes:
            c = unpack(c)
            if not len(c):
                out.append(np.empty(0, np.int32))
                continue
            m = n[c]
            at = np.repeat(start[c] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            out.append(flat[at])
        return pd.DataFrame({"doc_id": pd.array(list(doc_ids), dtype="Int64"), "ids": out})

    made = blocks(docs, "text", split, "string")
    table = made.select(F.explode("parts").alias("part")).distinct().mapInPandas(run, "part string, word_ids array<int>")
    return filled(made, table, "word_ids", finish, "doc_id long, ids array<int>")


def pattern():
    """The compiled split pattern, made once a worker."""
    import regex

    return regex.compile(WORD)


def decode(encoded, path):
    """(doc_id, ids) to (doc_id, text) by a join with the id-to-piece table of path (fixed size); an unknown id is an error, an empty or null list is an empty text."""
    checkpoints(encoded.sparkSession)
    with open(path, "rb") as f:
        pieces = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, f.read().splitlines())]
    table = encoded.sparkSession.createDataFrame(pieces, "part int, piece binary")

    def finish(doc_ids, codes, values):
        values = [bytes(v) for v in values]
        texts = [b"".join([values[i] for i in unpack(c)]).decode("utf-8", "replace") for c in codes]  # joined before decoding: a piece may end within a character
        return pd.DataFrame({"doc_id": pd.array(list(doc_ids), dtype="Int64"), "text": texts})

    made = blocks(encoded, "ids", lambda ids: [int(i) for i in ids], "int")
    return filled(made, F.broadcast(table), "piece", finish, "doc_id long, text string")


def p7_ids(spark, d, path="/opt/tokenizers/byte_bpe_50k.tiktoken"):
    return encode(spark.read.parquet(f"{d}/documents.parquet"), path)


def p7_text(spark, d, path="/opt/tokenizers/byte_bpe_50k.tiktoken"):
    """The round trip: every document's text from its ids; null texts come back empty."""
    return decode(p7_ids(spark, d, path), path)


QUERIES = {"p7_ids": p7_ids, "p7_text": p7_text}
