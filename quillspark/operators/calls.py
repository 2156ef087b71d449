"""Model calls that are made once: a key of what is asked, a ledger that outlives tasks, a cache that outlives runs.

A call's key is a digest of content, prompt, model and token limit. ``answered`` deals calls to tasks by what
they cost and notes each answer, a failure too, in the run's ledger before it asks the next one: a task that
takes a killed one's place finds its answers there and asks only for the rest. ``Cache`` keeps answers between
runs as Parquet: calls that it holds are left out by an anti-join, equal calls are made once, and new answers
are appended in one commit. Failures aren't cached.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillspark.operators.inference import Client
from quillspark.session import shared_dir, written
from quillspark.sources import files

#: Classes of cost with at most so many calls are dealt one by one; the calls of larger ones by their hash.
FEW = 1000
CACHED = "key string, output string, latency_ms int, asked_at timestamp"


def key(content: Column, prompt: Column, model: Column, max_tokens: Column) -> Column:
    """Digest of a call; null parts count as empty."""
    part = lambda c: F.sha2(F.coalesce(c.cast("binary"), F.lit(b"")), 256)
    return F.sha2(F.concat_ws("\n", part(content), part(prompt.cast("string")), part(model.cast("string")), part(max_tokens.cast("string"))), 256)


def deal(calls: DataFrame, tasks: int, cost: Column) -> DataFrame:
    """Adds bucket, and deals the calls (with key) to ``tasks`` tasks of about equal cost.

    All calls lie on a line as long as their total cost, by class of cost (powers of the square root of 2); each
    task gets one stretch of it. Places within a class are even, by rank where it has few calls, else by hash.
    """
    own = calls.withColumn("_cost", F.greatest(F.coalesce(cost, F.lit(1)).cast("double"), F.lit(1.0)))
    own = own.withColumn("_class", F.floor(2 * F.log2("_cost")))
    by = Window.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    line = own.groupBy("_class").agg(F.count(F.lit(1)).alias("_n"), F.sum("_cost").alias("_sum"))  # some hundred classes at most
    line = line.select("_class", "_n", "_sum", F.coalesce(F.sum("_sum").over(by), F.lit(0.0)).alias("_start"), F.sum("_sum").over(Window.partitionBy()).alias("_total"))
    few = own.select("key", "_class").join(F.broadcast(line.filter(f"_n <= {FEW}").select("_class")), "_class")
    few = few.select("key", F.row_number().over(Window.partitionBy("_class").orderBy("key")).alias("_rank"))
    spread = F.shiftrightunsigned(F.xxhash64("key"), 11) / 2.0**53
    own = own.join(F.broadcast(line), "_class").join(F.broadcast(few), "key", "left")
    place = (F.col("_start") + F.coalesce((F.col("_rank") - 0.5) / F.col("_n"), spread) * F.col("_sum")) / F.col("_total")
    bucket = F.least(F.floor(place * tasks), F.lit(tasks - 1)).cast("int")
    return own.withColumn("bucket", bucket).select(*calls.columns, "bucket").repartitionById(tasks, "bucket")


def answered(calls: DataFrame, factory: Callable[[], Client], ledger: str, tasks: int | None = None) -> DataFrame:
    """key, output, error, latency_ms, asked_at of ``calls`` (key, content, prompt, model, max_tokens; a key once).

    A call costs its content's bytes and 100 for each token it may answer with.
    """
    tasks = tasks or 2 * calls.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = files.opened(ledger)
        client, known, seen = None, {}, set()
        for batch in batches:
            for b in set(batch["bucket"]) - seen:
                seen.add(b)
                system.create_dir(f"{root}/{b}", recursive=True)
                for info in files.listed(system, f"{root}/{b}", ".json"):
                    with system.open_input_stream(info.path) as f:
                        known[info.base_name[:-5]] = json.loads(f.read())
            rows = []
            for bucket, k, content, prompt, model, most in zip(*(batch[c] for c in ("bucket", "key", "content", "prompt", "model", "max_tokens"))):
                if k not in known:
                    client = client or factory()
                    known[k] = _ask(client, content, prompt, model, most)
                    files.put(system, f"{root}/{bucket}/{k}.json", json.dumps(known[k]).encode())
                rows.append((k, *known.pop(k)))
            out = pd.DataFrame(rows, columns=["key", "output", "error", "latency_ms", "asked_at"])
            yield out.assign(asked_at=pd.to_datetime(out["asked_at"], unit="ms", utc=True))

    dealt = deal(calls.select("key", "content", "prompt", "model", "max_tokens"), tasks, F.octet_length("content") + 100 * F.col("max_tokens"))
    return dealt.mapInPandas(run, "key string, output string, error string, latency_ms int, asked_at timestamp")


def _ask(client: Client, content: bytes, prompt: str, model: str, most: int) -> list:
    """[output, error, latency_ms, asked_at]: a failing call has an error and fails nothing else."""
    begun, at = time.perf_counter(), int(1000 * time.time())
    try:
        output, error = client.run(content, prompt, model, int(most)), None
    except Exception as e:  # the call's result
        output, error = None, f"{type(e).__name__}: {e}"
    return [output, error, int(1000 * (time.perf_counter() - begun)), at]


def misses(calls: DataFrame, known: DataFrame) -> DataFrame:
    """The calls (with key) whose key ``known`` lacks, each key once."""
    return calls.dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")


class Cache:
    """Answers by key, as Parquet in ``path``, kept between runs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], CACHED).write.mode("append").parquet(path)  # so that there is something to read

    def answers(self) -> DataFrame:
        """One row per key; of two runs' answers to one call the earlier."""
        rows = self.spark.read.schema(CACHED).parquet(self.path)
        return rows.groupBy("key").agg(F.min(F.struct("asked_at", "output", "latency_ms")).alias("a")).select("key", "a.output", "a.latency_ms", "a.asked_at")

    def complete(self, calls: DataFrame, factory: Callable[[], Client], ledger: str, tasks: int | None = None) -> DataFrame:
        """The columns of ``calls`` (key, content, prompt, model, max_tokens and others) without content, and output, error, latency_ms, cached."""
        todo = written(misses(calls.select("key", "content", "prompt", "model", "max_tokens"), self.answers()), "calls")
        new = written(answered(todo, factory, ledger, tasks), "answers")
        before = written(self.answers().join(calls.select("key").distinct(), "key", "left_semi"), "known")
        new.filter("error is null").select("key", "output", "latency_ms", "asked_at").write.mode("append").parquet(self.path)
        both = new.select("key", "output", "error", "latency_ms", F.lit(False).alias("cached")).unionByName(before.select("key", "output", F.lit(None).cast("string").alias("error"), "latency_ms", F.lit(True).alias("cached")))
        return calls.drop("content").join(both, "key", "left")


def new_ledger(spark: SparkSession, run: str) -> str:
    """The folder of the run's ledger: a run of the same name goes on where the last one stopped."""
    return f"{shared_dir(spark)}/ledger-{run}"


class Digest:
    """A client for tests and benchmarks without a model: it answers with the width and height of a PNG."""

    def run(self, image: bytes, prompt: str, model: str, max_tokens: int) -> str:
        return "x".join(str(int.from_bytes(image[i : i + 4], "big")) for i in (16, 20))
