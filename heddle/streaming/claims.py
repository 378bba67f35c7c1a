"""Chunks of jobs that several workers share: claimed under a lease, taken over when it runs out, counted once.

Each chunk has a log of its own whose entries only one writer can create (see ingest.Log). A worker decides on the log as it
stands and writes the next entry; if another was first, that entry exists, and the worker reads on and decides anew. So no
two workers hold a chunk at a time, and what a worker brings after its lease was taken over is refused.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.streaming.ingest import Log

#: Claims of a chunk after which it has failed for good.
ATTEMPTS = 3


@dataclass(frozen=True)
class Claim:
    job: str
    chunk: int
    attempt: int
    worker: str


class Chunks:
    """The chunks 0 .. n - 1 of jobs below a path. now: seconds since 1970, for tests; leases are in seconds."""

    def __init__(self, spark: SparkSession, path: str, lease: float = 600, attempts: int = ATTEMPTS):
        self.spark, self.path, self.lease, self.attempts = spark, path.rstrip("/"), lease, attempts

    def _log(self, job: str, chunk: int) -> Log:
        return Log(self.spark, f"{self.path}/job={job}/chunk={chunk}")

    def create(self, job: str, chunks: int) -> bool:
        """Registers a job; False if it is there already, whatever its state: a job that is finished doesn't open again."""
        try:
            Log(self.spark, f"{self.path}/job={job}/chunk=jobs").append(1, {"chunks": chunks})
        except RuntimeError:
            return False
        return True

    def size(self, job: str) -> int:
        entry = Log(self.spark, f"{self.path}/job={job}/chunk=jobs").entry(1)
        if entry is None:
            raise ValueError(f"no such job: {job}")
        return entry["chunks"]

    @staticmethod
    def _claimable(last: dict | None, now: float, attempts: int) -> int:
        """The attempt that a claim would be, or 0."""
        if last is None:
            return 1
        if last["status"] == "complete" or last["attempt"] >= attempts:
            return 0
        return last["attempt"] + 1 if last["status"] == "failed" or last["expires"] <= now else 0

    def claim(self, job: str, worker: str, now: float | None = None) -> Claim | None:
        """The first chunk that is free: never claimed, failed, or with a lease that has run out; None if there is none."""
        now = time.time() if now is None else now
        for chunk in range(self.size(job)):
            log = self._log(job, chunk)
            while True:
                number, last = log.last()
                attempt = self._claimable(last, now, self.attempts)
                if not attempt:
                    break
                try:
                    log.append(number + 1, {"status": "running", "attempt": attempt, "worker": worker, "at": now, "expires": now + self.lease})
                except RuntimeError:  # another was first
                    continue
                return Claim(job, chunk, attempt, worker)
        return None

    def _end(self, claim: Claim, entry: dict) -> bool:
        log = self._log(claim.job, claim.chunk)
        number, last = log.last()
        if last is None or last["status"] != "running" or (last["attempt"], last["worker"]) != (claim.attempt, claim.worker):
            return False
        try:
            log.append(number + 1, {"attempt": claim.attempt, "worker": claim.worker, "expires": 0} | entry)
        except RuntimeError:
            return False
        return True

    def renew(self, claim: Claim, now: float | None = None) -> bool:
        """A longer lease for work that goes on; False if the chunk is another's by now."""
        now = time.time() if now is None else now
        return self._end(claim, {"status": "running", "at": now, "expires": now + self.lease})

    def complete(self, claim: Claim, result: str | None = None, now: float | None = None) -> bool:
        """False if the lease was taken over or the chunk is complete: the result doesn't count then."""
        return self._end(claim, {"status": "complete", "at": time.time() if now is None else now, "result": result})

    def fail(self, claim: Claim, reason: str = "", now: float | None = None) -> bool:
        return self._end(claim, {"status": "failed", "at": time.time() if now is None else now, "result": reason})

    def log(self) -> DataFrame:
        """(job_id, chunk, number, status, attempt, worker, at, result) of all entries, read by Spark; chunks that were never claimed are pending."""
        own = self.spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "0*").text(self.path, wholetext=True)
        own = own.select(F.from_json("value", "status string, attempt int, worker string, at double, result string, chunks int").alias("e"), F.col("_metadata.file_path").alias("f"))
        own = own.select(F.regexp_extract("f", r"/job=([^/]+)/", 1).alias("job_id"), F.regexp_extract("f", r"/chunk=([^/]+)/", 1).alias("c"), F.regexp_extract("f", r"/(\d+)$", 1).cast("long").alias("number"), "e.*")
        there = own.filter("c = 'jobs'").select("job_id", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).filter("chunk >= 0")
        empty = [F.lit(None).cast(t).alias(n) for n, t in (("attempt", "int"), ("worker", "string"))]
        pending = there.select("job_id", "chunk", F.lit(0).cast("long").alias("number"), F.lit("pending").alias("status"), *empty, F.lit(0.0).alias("at"), F.lit(None).cast("string").alias("result"))
        claimed = own.filter("c <> 'jobs'").withColumn("chunk", F.col("c").cast("int"))
        return pending.unionByName(claimed.select(pending.columns)).withColumn("at", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))

    def results(self) -> DataFrame:
        """(job_id, chunk, result) of complete chunks, one row each."""
        return self.log().filter("status = 'complete'").select("job_id", "chunk", "result")
