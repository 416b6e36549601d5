"""The extraction queue as a stream: arrivals to a queue without repeats, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.operators.ingest import queue_candidates, without


def arrivals(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    """Ingest results as files arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def queue_stream(results: DataFrame, queue_path: str, checkpoint: str) -> StreamingQuery:
    """Keep the queue at ``queue_path`` (``pmcid, row_id, at``) up to date with the stream.

    Every candidate counts, however late its event time, and each article is queued once,
    however long ago it came before: a batch adds the articles that no other batch has
    written.  A batch is written under its number, replacing what an earlier try left, so
    a restart repeats nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        first = queue_candidates_with_time(batch)
        without(first, _queued(first, queue_path).where(F.col("batch") != number), "pmcid").write.mode("overwrite").parquet(f"{queue_path}/batch={number}")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def queue_candidates_with_time(results: DataFrame) -> DataFrame:
    """Candidates with their place and time, each article once at its first place."""
    timed = F.struct("row_id", F.col("run_at").cast("timestamp").alias("at"))
    picked = queue_candidates(results.withColumn("row_id", timed)).select("pmcid", "row_id.*")
    return picked.groupBy("pmcid").agg(F.min("row_id").alias("row_id"), F.min_by("at", "row_id").alias("at"))


def _queued(like: DataFrame, queue_path: str) -> DataFrame:
    """``pmcid, batch`` of the queue so far; empty before its first batch."""
    spark = like.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(queue_path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    return spark.read.schema(f"pmcid {like.schema['pmcid'].dataType.simpleString()}, batch bigint").parquet(queue_path)
