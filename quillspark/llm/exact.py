"""Exact dedup: a tree merge of digest runs, in DataFrame operations only.

Texts are equal when identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted. Each input
partition's rows first shrink to a run: one entry per digest, in order of digest, with the row that would
stay and a count. Runs are then merged in rounds, eight neighbours into one (binomial rounds, three at a
time): what eight runs hold of a digest meets in one task, by its hash; the task merges equal digests and
writes its part of the new run in order. Each level is written, so a lost executor costs a round at most, and a
digest that holds a third of all rows is one entry per run and round. Every level keeps the entry with the most
code points, then the smallest doc_id, and carries a second, independent hash and the length of the
normalised text; entries merge only where those agree too, so two texts with one SHA-256 would stay
apart.

Defined cases: null text counts as empty; empty texts form one group; a null doc_id sorts after others;
rows with equal doc_id are separate rows, and of full ties one row stays; an empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import HOT_KEYS, materialize, text_of

FAN_IN_BITS = 3
#: Groups of no more copies than this are joined by shuffle in any case.
HOT_COPIES = 1000
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_KEYS = ["text_sha256", "check", "size"]


def digests(docs: DataFrame) -> DataFrame:
    """row, run, doc_id, length, text_sha256, check, size: one row per document, without its text."""
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("length"), F.translate(text, _SPACE, "").alias("norm"))
    return rows.select(
        F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("run"), "doc_id", "length",
        F.sha2("norm", 256).alias("text_sha256"), F.xxhash64("norm").alias("check"), F.length("norm").alias("size"),
    )


def merged(rows: DataFrame, bits: int = FAN_IN_BITS) -> DataFrame:
    """The root of the tree: text_sha256, check, size, best (length, doc_id, row), copies."""
    rank = F.struct((-F.col("length")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    runs = _level(rows.groupBy(*_KEYS, "run").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("copies")), 0)
    last, level = rows.agg(F.max("run")).first()[0] or 0, 0
    while last:
        last, level = last >> bits, level + 1
        runs = _level(runs.withColumn("run", F.shiftright("run", bits)).groupBy(*_KEYS, "run").agg(F.min("best").alias("best"), F.sum("copies").alias("copies")), level)
    return runs.drop("run")


def _level(runs: DataFrame, level: int) -> DataFrame:
    """A level of the tree, written: the entries of each run in order of digest, parted by its hash."""
    return materialize(runs.sortWithinPartitions("run", *_KEYS), f"runs-{level}")


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialize(digests(docs), "digests")
    copies = merged(rows).filter("copies > 1").select(*_KEYS, F.col("best.row").alias("keep_row"), F.col("best.doc_id").alias("keep_id"), "copies")
    copies = materialize(copies, "copies")
    # Rows of very large groups meet their one entry by broadcast: of groups above a share of the rows there are few.
    hot = copies.filter(F.col("copies") > max(HOT_COPIES, rows.count() // HOT_KEYS))
    rest = rows.join(F.broadcast(hot.select(*_KEYS)), _KEYS, "left_anti").join(copies, _KEYS, "left")
    out = rows.join(F.broadcast(hot), _KEYS).unionByName(rest)
    alone = F.col("copies").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )
