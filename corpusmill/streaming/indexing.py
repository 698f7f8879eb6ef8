"""The index kept up to date by a stream: every batch of new documents becomes a frame of postings; frames are merged when a rebuild is due."""
from pyspark.sql import DataFrame, functions as F

from corpusmill.operators import index


def append_postings(documents: DataFrame, folder: str, checkpoint: str, stop: DataFrame | None = None):
    """Starts a query that appends (gram, bucket, doc_ids, batch) of the stream's documents to the folder, all that is there, then ends. A batch written twice after a failure replaces itself."""

    def write(batch: DataFrame, number: int):
        pairs = index.grams(batch.dropDuplicates(["doc_id"]))
        none = batch.sparkSession.createDataFrame([], "gram int")
        frame = index.postings(pairs, none if stop is None else stop)
        frame.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark, folder: str) -> DataFrame:
    """All frames as one index: (gram, bucket, doc_ids), ids once."""
    ids = spark.read.parquet(folder).select("gram", "bucket", F.explode("doc_ids").alias("doc_id")).distinct()
    return ids.groupBy("gram", "bucket").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))


def late_counts(events: DataFrame, time: str, key: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by key and tumbling window of a stream, with late rows taken in for a while."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"))
