"""What the operators of this subpackage share: the cluster's shared folder, written intermediates, components."""

from __future__ import annotations

import atexit
import functools
import gc
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import textvec
from quillspark.session import shared_dir

#: Bounds of the batches that Python workers receive, unless the session sets its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": (str(64 << 20), str(8 << 20))}
#: Options of written intermediates: they are read by path at once, so nothing looks for a marker of success.
INTERMEDIATE = {"compression": "zstd", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
#: See ``tidy``.
TIDY_SECONDS, _tidied = 4.0, [0.0]
#: See ``join_hot``.
HOT_KEYS = 10_000
_made: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # the session has ended
            return


def tidy(spark: SparkSession, now: bool = False) -> None:
    """Lets the driver's collector run, and with it Spark's cleaner: shuffles and broadcasts that nothing refers to go, everywhere."""
    if now or time.monotonic() - _tidied[0] > TIDY_SECONDS:
        gc.collect()
        textvec.trim()
        spark.sparkContext._jvm.System.gc()
        _tidied[0] = time.monotonic()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**INTERMEDIATE).parquet(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, operator: str = "") -> DataFrame:
    """``df.mapInArrow``, in batches of bounded bytes; a task drops what other operators cached and ends with free memory given back."""
    _bound(df.sparkSession)

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textvec.only(operator)
        try:
            yield from run(batches)
        finally:
            textvec.trim()

    return df.mapInArrow(task, schema)


def apply_arrow(grouped: GroupedData, run: Callable[[tuple, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``grouped.applyInArrow``; free memory is given back after each group."""

    @functools.wraps(run)
    def task(key: tuple, table: pa.Table) -> pa.Table:
        textvec.only("")
        try:
            return run(key, table)
        finally:
            textvec.trim()

    return grouped.applyInArrow(task, schema)


def _bound(spark: SparkSession) -> None:
    for name, (usual, ours) in BATCH.items():
        if spark.conf.get(name, usual) in (usual, "67108864b", "64m", "64MB"):
            spark.conf.set(name, ours)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def join_hot(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``left.join(right, key, how)`` for a ``right`` with one row per key, where a few keys may hold most of the ``total`` rows of ``left``.

    Keys with more than 1 in ``HOT_KEYS`` of the rows, and a thousand at least, are at most ``HOT_KEYS``:
    their rows of ``right`` are broadcast. No other key can make a task large.
    """
    limit = max(1000, total // HOT_KEYS)
    if total <= limit:
        return left.join(right, key, how)
    hot = materialize(left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(f"_n > {limit}").select(key), "hot-keys")
    if hot.isEmpty():
        return left.join(right, key, how)
    some = left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), key, "left_semi")), key, how)
    return left.join(F.broadcast(hot), key, "left_anti").join(right, key, how).unionByName(some)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a long, b long): node, component (its smallest node).

    Alternates large-star and small-star steps (each node's neighbours link to the smallest of them);
    every step is an aggregation and an equi-join with one row per node on one side, and is written to
    the shared folder. Ends when a step leaves the edges as they were, after O(log n) rounds.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.join(least, "u")  # a hub's links are one key, which the adaptive skew join splits
        links = out.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else out.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return links.filter("a <> b")

    mark = [F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))]
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    was = e.agg(*mark).first()
    while was[0]:
        e = materialize(star(star(e, True), False).distinct(), name)
        now = e.agg(*mark).first()
        if tuple(now) == tuple(was):
            break
        was = now
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
