"""Recognition by external models: the plug-in point, retries, routing, fallbacks.

A provider is a picklable factory of clients; each task makes one client and feeds it Arrow batches, so
model state lives once per Python worker. Nothing here keeps state between rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import structured as S
from quillspark.functions import text as T
from quillspark.session import written

TASKS = ("ocr_text", "describe_image", "read_scene_text", "table_markdown", "summarize_document")
# Messages that results carry.
FALLBACK_REASONS = {
    "mode": "Document-Pipeline unterstützt derzeit nur mode=plain; direkte Pipeline wurde verwendet.",
    "task": "Document-Pipeline unterstützt derzeit nur ocr_text ohne custom_prompt; direkte Pipeline wurde verwendet.",
    "gif": "GIF-Verarbeitung bleibt in der direkten Pipeline.",
    "layout": "Layout deaktiviert; direkte Pipeline wurde verwendet.",
}


class Client(Protocol):
    def list_models(self) -> list[str]: ...

    def supports_vision(self, model: str) -> bool: ...

    def run(self, image: bytes, prompt: str, model: str, max_tokens: int) -> str: ...


class Scripted:
    """A client that answers from a list, in turn, for tests."""

    def __init__(self, answers: list[str], models: tuple[str, ...] = ("fake-vl",)):
        self.answers, self.models, self.calls = list(answers), list(models), []

    def list_models(self) -> list[str]:
        return self.models

    def supports_vision(self, model: str) -> bool:
        return model in self.models

    def run(self, image: bytes, prompt: str, model: str, max_tokens: int) -> str:
        self.calls.append(prompt)
        return self.answers.pop(0) if self.answers else "ok"


def complete(requests: DataFrame, factory: Callable[[], Client], image: str = "content") -> DataFrame:
    """Adds output, error, latency_ms to rows with an image, prompt, model, max_tokens. A failing row has an error and fails nothing else."""
    import time

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", output string, error string, latency_ms int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for batch in batches:
            out, err, took = [], [], []
            for data, prompt, model, most in zip(batch[image], batch["prompt"], batch["model"], batch["max_tokens"]):
                begun = time.perf_counter()
                try:
                    out.append(client.run(data, prompt, model, int(most)))
                    err.append(None)
                except Exception as e:  # the row's result
                    out.append(None)
                    err.append(f"{type(e).__name__}: {e}")
                took.append(int(1000 * (time.perf_counter() - begun)))
            yield batch.assign(output=out, error=err, latency_ms=took)

    return requests.mapInPandas(run, schema)


def doubtful(task: Column, prompt: Column, output: Column) -> Column:
    """Why an answer calls for another try: an array of echo, empty, description, transcript."""
    tests = {
        "empty": T.is_empty_fence(output),
        "description": (task == "ocr_text") & T.image_description(output),
        "transcript": (task == "describe_image") & T.ocr_transcript(output),
        "echo": T.prompt_echo(prompt, output),
    }
    return F.filter(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in tests.items())), lambda x: x.isNotNull())


def with_retries(requests: DataFrame, factory: Callable[[], Client], prompts: dict[str, list[str]]) -> DataFrame:
    """Rows with task, prompt, custom (bool), image, model, max_tokens, and text, doubts: up to three calls.

    ``prompts``: per task the shorter prompts of the second and third call. Rows in doubt, and only those,
    are asked again; custom prompts never are. An answer that still echoes its first prompt is replaced. Each
    round's answers are written before they are read: no action, and no executor lost later, asks again.
    """
    again = lambda i: F.element_at(F.create_map(*(F.lit(x) for t, p in prompts.items() for x in (t, p[i]))), F.col("task"))
    keep = requests.columns
    no_doubt = F.array().cast("array<string>")
    out = complete(requests, factory).withColumns({"doubts": F.when(F.col("custom"), no_doubt).otherwise(doubtful(F.col("task"), F.col("prompt"), F.col("output"))), "first_prompt": F.col("prompt")})
    done = None
    for i in range(2):
        out = written(out, "answers")
        settled = out.filter(F.size("doubts") == 0)
        done = settled if done is None else done.unionByName(settled)
        ask = out.filter(F.size("doubts") > 0).withColumn("prompt", again(i)).select(*keep, F.col("doubts").alias("earlier"), "first_prompt")
        out = complete(ask, factory).withColumn("doubts", doubtful(F.col("task"), F.col("prompt"), F.col("output"))).drop("earlier")
    out = done.unionByName(written(out, "answers"))
    text = T.unwrap_fence(T.text("output"))
    text = F.when((text == "") & T.is_empty_fence(T.text("output")), T.empty_output_text(F.col("task"))).otherwise(text)
    echoed = ~F.col("custom") & F.col("task").isin("ocr_text", "describe_image") & T.prompt_echo(F.col("first_prompt"), text)
    return out.select(*keep, F.when(echoed, T.empty_output_text(F.col("task"))).otherwise(text).alias("text"), "doubts", "error", "latency_ms")


def route(requests: DataFrame, default_backend: str = "expert", layout: bool = True) -> DataFrame:
    """Adds backend and reason: blank is direct, none the default; expert falls back to direct by rule, the first that applies."""
    asked = F.coalesce(F.lower(F.trim("backend")), F.lit(default_backend))
    asked = F.when(asked == "", "direct").otherwise(asked)
    custom = F.coalesce(F.trim("custom_prompt") != "", F.lit(False))
    reason = (
        F.when(asked != "expert", F.lit(None).cast("string"))
        .when(F.col("mode") != "plain", FALLBACK_REASONS["mode"])
        .when((F.coalesce("task", F.lit("ocr_text")) != "ocr_text") | custom, FALLBACK_REASONS["task"])
        .when(F.col("content_type") == "image/gif", FALLBACK_REASONS["gif"])
        .when(F.lit(not layout), FALLBACK_REASONS["layout"])
    )
    return requests.withColumns({"reason": reason, "backend": F.when(reason.isNotNull(), "direct").otherwise(asked)})


def structured_pages(pages: DataFrame, schema_name: str) -> DataFrame:
    """doc_id, data, warnings: each page's output parsed, merged in order, and emptied if no page shows text.

    pages: doc_id, page_number, output, evidence (what a plain reading of the page gave).
    """
    schema = S.SCHEMAS[schema_name]
    parsed = pages.withColumn("p", S.parse(F.col("output"), list(schema)))
    seen = ~T.no_visible_text(T.text("evidence"))
    by_page = lambda a, b: F.sign(a["page_number"] - b["page_number"]).cast("int")
    doc = parsed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "p")), by_page).alias("pages"), F.max(seen).alias("seen"), F.count(F.lit(1)).alias("n"))
    good = F.transform(F.filter("pages", lambda x: x["p"]["data"].isNotNull()), lambda x: x["p"]["data"])
    noted = F.flatten(F.transform("pages", lambda x: F.transform(x["p"]["warnings"], lambda w: T.page_prefix(w, x["page_number"], F.col("n")))))
    doc = doc.withColumns({"m": S.merge(good, schema), "noted": noted})
    return doc.select("doc_id", F.when(F.col("seen"), F.col("m.data")).otherwise(S.empty(schema)).alias("data"), F.concat("noted", "m.warnings").alias("warnings"))


def first_hit(pages: DataFrame, test: Column, by: str = "doc_id") -> DataFrame:
    """The first page of each document that passes; later pages don't count."""
    return pages.filter(test).groupBy(by).agg(F.min_by(F.struct(*[c for c in pages.columns if c != by]), "page_number").alias("x")).select(by, "x.*")
