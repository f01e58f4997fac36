"""The job queue as a stream: a directory of job rows instead of a polled table.

A single writer with a checkpoint takes the place of the conditional update that locks a job; a batch is complete when all
its files are, which is a stateful aggregation with complete output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

JOBS = "id long, batch_id long, status string, created_at timestamp"


def read_jobs(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(JOBS).option("maxFilesPerTrigger", per_trigger).parquet(path)


def next_job(jobs: DataFrame) -> DataFrame:
    """Oldest queued job."""
    return jobs.where("status = 'queued'").orderBy("created_at", "id").limit(1)


def batch_barrier(jobs: DataFrame) -> DataFrame:
    """Whether all jobs of each batch have ended, and whether one failed.  Works on a stream and on a table."""
    return jobs.groupBy("batch_id").agg(F.count("*").alias("jobs"), F.bool_and(F.col("status") != "queued").alias("ready"), F.bool_or(F.col("status") == "failed").alias("failed"))


def run_queue(spark: SparkSession, path: str, checkpoint: str, work: Callable[[DataFrame, int], None], seconds: int = 2) -> StreamingQuery:
    """Hands each new set of queued jobs to work(rows, batch number) once, in order of creation."""

    def each(rows: DataFrame, number: int) -> None:
        work(rows.where("status = 'queued'").orderBy("created_at", "id"), number)

    return read_jobs(spark, path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def backoff_seconds(attempt: int) -> float:
    """Wait before a retry: 1, 2, 4 ... at most 30 seconds."""
    return float(min(30, 2**attempt))
