"""The phases of a job as keyed state: locks, retries and a time-out, in Structured Streaming.

A job goes through PHASES.  In each it is queued, locked by whoever starts it first, and then ends well (the next phase is queued, or the
job is complete) or fails (it is queued again until MOST attempts have failed).  A lock that is older than the time-out counts as a
failure at that moment; a timer in event time sees to it if no event follows.

The events of one job are ordered by time within a micro-batch; what is older than the state has seen is late and only counted.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Phases in their order, the lock's time-out in minutes, failed attempts of a phase before the job fails.
PHASES, TIMEOUT_MINUTES, MOST = ["CONVERT", "EXTRACT", "MAP", "GENERATE"], 25, 3
STATE = "phase int, status string, attempts int, locked_us long, seen_us long, conflicts long, retries long, timeouts long, late long, steps long"
RESULT = "job long, phase string, status string, attempts int, conflicts long, retries long, timeouts long, late long, steps long"


@dataclasses.dataclass
class Job:
    """Times are microseconds of event time; locked_us is 0 without a lock.  steps counts what changed the state."""

    phase: int = 0
    status: str = "queued"
    attempts: int = 0
    locked_us: int = 0
    seen_us: int = 0
    conflicts: int = 0
    retries: int = 0
    timeouts: int = 0
    late: int = 0
    steps: int = 0

    def fail(self) -> None:
        self.status, self.locked_us = ("failed", 0) if self.attempts >= MOST else ("queued", 0)
        self.retries += self.status == "queued"
        self.steps += 1

    def expire(self, now_us: int, limit_us: int) -> None:
        """What the clock does: a lock that is older than the limit is a failure."""
        if self.status == "processing" and now_us > self.locked_us + limit_us:
            self.timeouts += 1
            self.fail()

    def take(self, kind: str, at_us: int, limit_us: int) -> None:
        """What an event does: start, finish, fail, or queue again what has ended."""
        if at_us < self.seen_us:
            self.late += 1
            return
        self.seen_us = at_us
        self.expire(at_us, limit_us)
        if kind == "start" and self.status == "processing":
            self.conflicts += 1
        elif kind == "start" and self.status == "queued":
            self.status, self.locked_us, self.attempts, self.steps = "processing", at_us, self.attempts + 1, self.steps + 1
        elif kind == "finish" and self.status == "processing":
            last = self.phase == len(PHASES) - 1
            self.status, self.locked_us, self.steps = "completed" if last else "queued", 0, self.steps + 1
            self.phase, self.attempts = (self.phase, self.attempts) if last else (self.phase + 1, 0)
        elif kind == "fail" and self.status == "processing":
            self.fail()
        elif kind == "queue" and self.status in ("failed", "completed"):
            self.phase = self.phase if self.status == "failed" else 0
            self.status, self.attempts, self.steps = "queued", 0, self.steps + 1


def _advance(limit_us: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = Job(*state.get) if state.exists else Job()
        if state.hasTimedOut:
            job.expire(state.getCurrentWatermarkMs() * 1000 + 1000, limit_us)
        else:
            rows = [(int(a), k) for f in frames for a, k in zip(f["us"], f["kind"], strict=True)]
            for at, kind in sorted(rows):
                job.take(kind, at, limit_us)
        state.update(dataclasses.astuple(job))
        if job.status == "processing":  # timers are in milliseconds and must lie behind the watermark
            state.setTimeoutTimestamp(max((job.locked_us + limit_us) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], PHASES[job.phase], job.status, job.attempts, job.conflicts, job.retries, job.timeouts, job.late, job.steps)], columns=[c.split()[0] for c in RESULT.split(", ")])

    return step


def job_states(events: DataFrame, limit: timedelta = timedelta(minutes=TIMEOUT_MINUTES), delay: str = "0 seconds") -> DataFrame:
    """The states of jobs (RESULT) as a stream of updates; events: job, kind, at, as a stream."""
    limit_us = limit // timedelta(microseconds=1)
    keyed = events.select(F.col("job").cast("long").alias("job"), "kind", "at", F.unix_micros("at").alias("us")).withWatermark("at", delay).groupBy("job")
    return keyed.applyInPandasWithState(_advance(limit_us), RESULT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def replay(events: DataFrame, folder: str, limit: timedelta = timedelta(minutes=TIMEOUT_MINUTES)) -> DataFrame:
    """Runs all there is of a stream of events and gives the last state of each job.

    Each micro-batch's updates go to a folder of their own under `folder`, in the shared storage; a batch that is run again after a failure
    overwrites it, so every update counts once.
    """
    spark, base = events.sparkSession, f"{folder}/jobs-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/states/batch={number}")

    query = job_states(events, limit).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    names = [c.split()[0] for c in RESULT.split(", ")]
    states = spark.read.schema(f"{RESULT}, batch long").option("basePath", f"{base}/states").parquet(f"{base}/states")
    return states.groupBy("job").agg(F.max_by(F.struct(*names[1:]), "batch").alias("s")).select("job", "s.*")
