"""Files by runners: the benchmark plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import metrics
from quillspark.sources.documents import MAX_RUNNERS

#: Runners that read a document's text as it is, for tests and benchmarks without a model.
CORRUPTIONS = {
    "identity": lambda c: c,
    "misread": lambda c: F.replace(c, F.lit("en"), F.lit("em")),
    "no_points": lambda c: F.regexp_replace(c, "[.,]", ""),
    "upper": lambda c: F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
}


def jobs(files: DataFrame, runners: DataFrame, most: int = MAX_RUNNERS) -> DataFrame:
    """Every file with every runner. No runner, or more than ``most``, is an error; so few go to all tasks."""
    n = runners.limit(most + 1).count()
    if not 1 <= n <= most:
        raise ValueError("choose a runner" if not n else f"more than {most} runners in one job")
    return files.crossJoin(F.broadcast(runners))


def corrupted(documents: DataFrame, runners: dict = CORRUPTIONS) -> DataFrame:
    """The documents once per runner: runner_label, hypothesis, reference and its distinct tokens, made once. One scan, no join."""
    made = F.array(*(F.struct(F.lit(n).alias("runner_label"), f(T.text("text")).alias("hypothesis")) for n, f in runners.items()))
    own = documents.select("doc_id", "text", T.text("text").alias("reference"), F.array_distinct(T.tokens(T.text("text"))).alias("reference_tokens"))
    return own.select("doc_id", "reference", "reference_tokens", F.inline(made))


def with_references(files: DataFrame, references: DataFrame) -> DataFrame:
    """Files with the reference of their stem, empty where there is none."""
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    own = references.select(F.regexp_replace("file_name", r"\.[^.]*$", "").alias("_stem"), F.col("text").alias("reference"))
    return files.join(own, stem == F.col("_stem"), "left").drop("_stem").withColumn("reference", F.coalesce("reference", F.lit("")))


def score(rows: DataFrame, full: bool = False) -> DataFrame:
    """Adds text_chars, text_tokens, status and the token scores, with ``full`` the error rates too; scores are null without a reference."""
    ok = F.col("hypothesis").isNotNull()
    out = rows.withColumns({"status": F.when(ok, "done").otherwise("error"), "text_chars": F.length("hypothesis"), "text_tokens": F.size(T.tokens(T.text("hypothesis")))})
    return metrics.against_reference(out, "reference", "hypothesis", rates=full).drop("reference_tokens")


def summary(scored: DataFrame) -> DataFrame:
    """Per runner: documents, mean and sample deviation of the token scores."""
    return scored.groupBy("runner_label").agg(
        F.count(F.lit(1)).alias("doc_count"), F.round(F.avg("token_precision"), 6).alias("mean_precision"), F.round(F.avg("token_recall"), 6).alias("mean_recall"),
        F.round(F.avg("token_f1"), 6).alias("mean_f1"), F.round(F.stddev_samp("token_f1"), 6).alias("stdev_f1"),
    )
