"""The flows a user calls: recognition, comparison, benchmark, evaluation. All return DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import editdist
from quillspark.functions import structured as S
from quillspark.operators import inference, matching, metrics, projection
from quillspark.plans import benchmark as plan
from quillspark.plans import pages as page_flow
from quillspark.sources import documents as sources


def ocr(documents: DataFrame, factory: Callable[[], inference.Client], prompt: str, model: str, retry_prompts: dict[str, list[str]], max_tokens: int = 4096) -> DataFrame:
    """The rows of ``documents`` (file_name, content) with text, error, latency_ms; rejected ones have an error and are not sent."""
    typed = sources.check_limits(documents).withColumn("kind", sources.effective_type(F.lit(None).cast("string"), F.col("content")))
    typed = typed.withColumn("refused", F.coalesce("error", "kind.error")).drop("error")
    asked = typed.filter("refused is null").select("file_name", "content", F.lit("ocr_text").alias("task"), F.lit(prompt).alias("prompt"), F.lit(False).alias("custom"), F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"))
    done = inference.with_retries(asked, factory, retry_prompts).select("file_name", "text", "error", "latency_ms")
    none = F.lit(None)
    return done.unionByName(typed.filter("refused is not null").select("file_name", none.cast("string").alias("text"), F.col("refused").alias("error"), none.cast("int").alias("latency_ms")))


def process_pages(pages: DataFrame, factory: Callable[[], inference.Client], prompt: str, model: str, run: str, **options) -> DataFrame:
    """Documents read page by page and region by region; see ``plans.pages.process`` for columns and options."""
    return page_flow.process(pages, factory, prompt, model, run, **options)


def project(pages: DataFrame, model_id: str = "prebuilt-read", unit: str = "textElements") -> DataFrame:
    return projection.analyze_result(pages, model_id, unit=unit)


def compare(ours: DataFrame, theirs: DataFrame, our_words: DataFrame, their_words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metrics per document, word diff per page).

    ours, theirs: doc_id, text, latency_ms, reference_text (ours); words: page_id, idx, content, polygon, confidence
    and, where a document has several pages, doc_id; without it a page is a document.
    """
    def of(words: DataFrame, name: str) -> DataFrame:
        by = F.col("doc_id" if "doc_id" in words.columns else "page_id")
        own = F.array_sort(F.collect_list(F.struct("page_id", "idx", "content", "confidence")))
        return words.groupBy(by.alias("doc_id")).agg(F.transform(own, lambda w: F.struct(w["content"], w["confidence"])).alias(name))

    both = ours.select("doc_id", F.col("text").alias("our_text"), F.col("latency_ms").alias("our_latency_ms"), "reference_text").join(theirs.select("doc_id", F.col("text").alias("their_text"), F.col("latency_ms").alias("their_latency_ms")), "doc_id")
    none = F.array().cast("array<struct<content: string, confidence: double>>")
    both = both.join(of(our_words, "our_words"), "doc_id", "left").join(of(their_words, "their_words"), "doc_id", "left")
    return metrics.compute(both.withColumns({c: F.coalesce(c, none) for c in ("our_words", "their_words")})), matching.word_diff(our_words, their_words)


def benchmark(files: DataFrame, references: DataFrame, runners: DataFrame, run: Callable[[DataFrame], DataFrame], one_at_a_time: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, one per file and runner; aggregates per runner).

    ``run`` adds hypothesis, error, latency_ms. With ``one_at_a_time`` the rows go through one task, so that
    latencies compare; otherwise they are spread.
    """
    todo = plan.jobs(plan.with_references(files, references), runners)
    todo = todo.coalesce(1) if one_at_a_time else todo.repartition()
    rows = plan.score(run(todo), full=True)
    return rows, metrics.per_runner(rows)


def evaluate(manifest: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, means): manifest records against results (sample, text, structured) by error rates or field accuracy."""
    rows = manifest.join(results.select("sample", F.col("text").alias("got"), F.col("structured").alias("got_fields")), "sample", "left")
    plain = F.col("mode") == "plain"
    rows = rows.withColumns({"_cer": editdist.cer(F.col("text"), F.col("got")), "_wer": editdist.wer(F.col("text"), F.col("got"))})
    rows = rows.withColumns({"cer": F.when(plain, F.col("_cer")), "wer": F.when(plain, F.col("_wer")), "field_accuracy": F.when(~plain, S.field_accuracy(F.col("structured"), F.coalesce("got_fields", F.create_map().cast("map<string,string>"))))}).drop("_cer", "_wer")
    return rows, metrics.evaluation(rows)
