"""What the operators of this subpackage share."""
from pyspark.sql import DataFrame, functions as F


def checkpoints(spark):
    """Sets the session's checkpoint folder: the one named in spark.checkpoint.dir; where that is unset a local session gets a temporary folder, and a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        d = tempfile.mkdtemp(prefix="corpusmill-")
    sc.setCheckpointDir(d)


def table(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of edges (a, b): the smallest node that each node is connected with, by alternating large-star and small-star.

    Each round is cut by a checkpoint; it ends when a round changes no edge, after a number of rounds that grows with the
    logarithm of the largest component. Nodes without an edge have no row; loops, nulls and repeated edges are left out.
    """
    checkpoints(edges.sparkSession)
    pair = F.struct(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = edges.where("a <> b").select(pair.alias("e")).select("e.*").distinct().checkpoint()  # u > v
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        # large-star: each greater neighbour to the least of the neighbourhood
        large = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select("w", F.least("m", "u").alias("m")).distinct()
        # small-star: each smaller neighbour and the node itself to the least of them
        small = large.groupBy("w").agg(F.min("m").alias("least"))
        linked = large.join(small, "w")
        after = linked.select(F.col("m").alias("u"), F.col("least").alias("v")).unionByName(small.select(F.col("w").alias("u"), F.col("least").alias("v"))).where("u <> v").distinct().checkpoint()
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        now, before = after, state
    roots = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
