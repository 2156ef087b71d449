"""Sinks: benchmark CSV, label slugs, JSON reports, operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of a benchmark's CSV, in order.
CSV_COLUMNS = (
    "file_index", "file_name", "runner_kind", "runner_label", "status", "text_chars", "text_tokens", "latency_ms",
    "cer", "wer", "token_f1", "avg_confidence", "warnings", "error", "text", "reference",
)


def csv_cell(c: Column, kind: str = "string") -> Column:
    """Null is empty, a list is joined, and only a comma, quote or line feed calls for quotes."""
    s = F.coalesce(F.array_join(c, " | ") if kind.startswith("array") else c.cast("string"), F.lit(""))
    return F.when(s.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_lines(rows: DataFrame, columns: tuple[str, ...] = CSV_COLUMNS) -> DataFrame:
    """The columns of ``rows`` and line: the row's CSV, columns that are missing empty."""
    kinds = dict(rows.dtypes)
    return rows.withColumn("line", F.concat_ws(",", *(csv_cell(F.col(c), kinds[c]) if c in kinds else F.lit("") for c in columns)))


def write_csv(rows: DataFrame, path: str, order: tuple[str, ...] = ("file_index", "runner_label")) -> None:
    """Text files of CSV lines in order; the header is the first line of the first one."""
    head = rows.sparkSession.createDataFrame([(",".join(CSV_COLUMNS),)], "value string")
    body = csv_lines(rows.orderBy(*order)).select(F.col("line").alias("value"))
    head.coalesce(1).union(body).write.text(path)


def label_slug(label: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(label, r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("runner"))


def metric_rows(aggregate: DataFrame) -> DataFrame:
    """run, metric, value: an aggregate's numbers in long form under each runner's slug, nulls left out."""
    names = [c for c, k in aggregate.dtypes if k in ("double", "bigint", "int")]
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names))
    return aggregate.select(label_slug(F.col("runner_label")).alias("run"), F.inline(pairs)).filter("value is not null")


def as_json(rows: DataFrame, by: list[str]) -> DataFrame:
    """by..., json: the rows of a job as one object."""
    return rows.groupBy(*by).agg(F.to_json(F.struct(*by, F.collect_list(F.struct(*rows.columns)).alias("rows"))).alias("json"))


def write_operations(operations: DataFrame, path: str) -> None:
    """Appends states of operations; the latest one counts when they are read."""
    operations.write.mode("append").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("errorifexists").json(path)
