"""Benchmark jobs that run in waves and can be cancelled: what finished waves wrote stays.

A job's files are dealt into waves; each wave is a Spark job of its own under the job's tag and commits its
rows before the next one begins. ``cancel`` interrupts whatever runs under the tag, tasks included, and no
further wave begins; a job of the same path goes on with the waves that are missing. Calls answered within
a wave that was cut short are lost to the rows but not to the ledger of ``operators.calls``.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import metrics
from quillspark.plans import benchmark
from quillspark.sources import files as storage

# States of a job.
PENDING, RUNNING, DONE, FAILED, CANCELLED = "pending", "running", "done", "failed", "cancelled"


class Job:
    """Rows (file_index, file_name, reference, runner_label, ...) through ``run``, scored, wave by wave, to Parquet in ``path``.

    ``run`` adds hypothesis, error and latency_ms. Waves take files in order of file_index, as nearly even as can be.
    """

    def __init__(self, spark: SparkSession, rows: DataFrame, run: Callable[[DataFrame], DataFrame], path: str, waves: int = 8, job_id: str | None = None):
        self.spark, self.rows_in, self.run, self.path, self.waves = spark, rows, run, path.rstrip("/"), max(1, waves)
        self.id = job_id or uuid.uuid4().hex
        self.tag, self.status, self.error = f"benchmark-{self.id}", PENDING, None
        self._cancelled, self._thread, self._lock = threading.Event(), None, threading.Lock()

    def start(self) -> Job:
        """Runs the job in a thread of its own, which carries the tag."""
        with self._lock:
            if self._thread is None:
                self._thread = InheritableThread(target=self._work, daemon=True, session=self.spark)
                self._thread.start()
        return self

    def wait(self, seconds: float | None = None) -> str:
        if self._thread is not None:
            self._thread.join(seconds)
        return self.status

    def cancel(self) -> bool:
        """Whether the job is cancelled by this or an earlier call: a job that has ended stays as it is."""
        if self.status in (PENDING, RUNNING) and not self._cancelled.is_set():
            self._cancelled.set()
            InheritableThread(target=self._interrupt, daemon=True, session=self.spark).start()
        return self._cancelled.is_set()

    def _interrupt(self) -> None:
        """Again until the job has ended: a wave may be about to begin."""
        while self._thread is not None and self._thread.is_alive():
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            self._thread.join(0.5)

    def _work(self) -> None:
        if self._cancelled.is_set():
            self.status = CANCELLED
            return
        self.status = RUNNING
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        context.setInterruptOnCancel(True)
        try:
            last = self.rows_in.agg(F.max("file_index")).first()[0]
            for wave in sorted(set(range(self.waves)) - self.finished()):
                if self._cancelled.is_set():
                    break
                low, high = (-(-(w * ((last or 0) + 1)) // self.waves) for w in (wave, wave + 1))
                mine = self.rows_in.filter((F.col("file_index") >= low) & (F.col("file_index") < high))
                benchmark.score(self.run(mine), full=True).write.mode("overwrite").parquet(f"{self.path}/wave={wave}")
            self.status = CANCELLED if self._cancelled.is_set() else DONE
        except Exception as e:
            self.error = None if self._cancelled.is_set() else f"{type(e).__name__}: {e}"
            self.status = CANCELLED if self._cancelled.is_set() else FAILED
        finally:
            context.removeJobTag(self.tag)

    def finished(self) -> set[int]:
        """The waves that have been committed."""
        system, root = storage.opened(self.path)
        return {w for w in range(self.waves) if storage.listed(system, f"{root}/wave={w}", "/_SUCCESS")}

    def progress(self) -> tuple[int, int]:
        """(rows that are done, all rows)."""
        done = self.rows()
        return 0 if done is None else done.count(), self.rows_in.count()

    def rows(self) -> DataFrame | None:
        """The rows of finished waves, of a cancelled or failed job too; None before the first."""
        done = [f"{self.path}/wave={w}" for w in sorted(self.finished())]
        return self.spark.read.parquet(*done) if done else None

    def aggregate(self) -> DataFrame | None:
        done = self.rows()
        return None if done is None else metrics.per_runner(done)


def job(files: DataFrame, references: DataFrame, runners: DataFrame, run: Callable[[DataFrame], DataFrame], path: str, waves: int = 8, job_id: str | None = None) -> Job:
    """A job of ``files`` (file_index, file_name, ...) by ``runners``; not started."""
    return Job(files.sparkSession, benchmark.jobs(benchmark.with_references(files, references), runners), run, path, waves, job_id)
