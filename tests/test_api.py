import json

import pytest
from pyspark.sql import functions as F

from quillspark import api
from quillspark.operators import inference, requests
from quillspark.sources import documents as sources
from quillspark.sources import sinks
from quillspark.streaming import jobs


def test_requests(spark):
    rows = [("5", None, "yes"), ("x", "7", "maybe"), (None, "y", None)]
    df = spark.createDataFrame(rows, "form string, query string, word string").coalesce(1)
    none = F.lit(None).cast("boolean")
    got = df.select(requests.number(F.col("form"), F.col("query"), "n").alias("n"), requests.flag(none, F.col("word"), "b").alias("b")).collect()
    assert [(r.n.value, r.n.error) for r in got] == [(5, None), (7, None), (None, "invalid n")]
    assert [(r.b.value, r.b.error) for r in got] == [(True, None), (None, "invalid b"), (None, None)]
    df = spark.createDataFrame([("prebuilt-read", "2022-08-31", 5, bytearray(b"x")), ("other", "2020", 0, bytearray(b""))], "model_id string, api_version string, token_limit int, content binary").coalesce(1)
    assert [len(r.errors) for r in requests.errors(df).collect()] == [0, 4]
    bodies = spark.createDataFrame([("ollama", '{"models":[{"name":"llava"},{"name":"mistral"}]}'), ("openai", '{"data":[{"id":"gpt-4o"},{"id":"tts-1"}]}')], "provider string, body string")
    known = spark.createDataFrame([("ollama", "mistral", True)], "provider string, model string, supports_vision boolean")
    assert {r.model for r in requests.vision_models(requests.models(bodies), known).collect()} == {"llava", "mistral"}  # a name that says nothing counts as no


def test_operations_round_trip_and_polling(spark, tmp_path):
    rows = [("a", "m", "running", 1), ("a", "m", "succeeded", 2), ("b", "m", "running", 1)]
    for part in (rows[:1], rows[1:]):
        df = spark.createDataFrame(part, "id string, model_id string, status string, t long")
        full = df.select("id", "model_id", "status", F.timestamp_seconds(F.lit(0)).alias("created_at"), F.timestamp_seconds("t").alias("updated_at"), F.lit("r").alias("request_id"), F.lit("{}").alias("payload"), F.lit(None).cast("struct<code: string, message: string>").alias("error"))
        sinks.write_operations(full, f"{tmp_path}/ops")
    got = {r.id: r for r in requests.poll(jobs.latest(requests.operations(spark, f"{tmp_path}/ops"))).collect()}
    assert got["a"].status == "succeeded" and got["a"].retry_after is None and got["b"].retry_after == 1
    assert json.loads(got["a"].body)["status"] == "succeeded"


def test_flows(spark, tmp_path):
    files = spark.createDataFrame([("a.png", bytearray(b"\x89PNG\r\n\x1a\n")), ("b.bin", bytearray(b"?")), ("c.png", bytearray(b""))], "file_name string, content binary")
    again = {t: ["x", "y"] for t in inference.TASKS}
    got = {r.file_name: r for r in api.ocr(files, lambda: inference.Scripted(["```\nHallo Welt\n```"]), "Lies den Text", "m", again).collect()}
    assert got["a.png"].text == "Hallo Welt" and got["b.bin"].error == "unknown content" and got["c.png"].error == "empty"
    (tmp_path / "m.jsonl").write_text('{"sample":"s1","mode":"plain","text":"abcd"}\n\n{"sample":"s2","mode":"structured","schema_name":"receipt_basic","structured":{"total":"5","date":"1"}}\n')
    results = spark.createDataFrame([("s1", "abcx", None), ("s2", None, {"total": " 5 "})], "sample string, text string, structured map<string,string>")
    rows, means = api.evaluate(sources.manifest(spark, f"{tmp_path}/m.jsonl"), results)
    m = means.first()
    assert rows.count() == 2 and m.mean_cer == pytest.approx(0.25) and m.mean_field_accuracy == 0.5
    run = lambda df: df.withColumns({"hypothesis": F.when(F.col("runner_label") == "good", F.col("reference")), "error": F.lit(None).cast("string"), "latency_ms": F.lit(3)})
    runners = spark.createDataFrame([("good",), ("bad",)], "runner_label string")
    rows, sums = api.benchmark(files.select("file_name"), spark.createDataFrame([("a.txt", "t u")], "file_name string, text string"), runners, run, one_at_a_time=True)
    by = {r.runner_label: r for r in sums.collect()}
    assert rows.count() == 6 and by["good"].success_count == 3 and by["good"].mean_cer == 0.0 and by["bad"].failure_count == 3 and by["bad"].mean_cer is None
    word = "page_id long, idx int, content string, polygon array<double>, confidence double"
    ours = spark.createDataFrame([(1, "a b", 1, "a b")], "doc_id long, text string, latency_ms int, reference_text string")
    theirs = spark.createDataFrame([(1, "a c", 2)], "doc_id long, text string, latency_ms int")
    scores, diff = api.compare(ours, theirs, spark.createDataFrame([(1, 0, "a", [0.0] * 8, 1.0)], word), spark.createDataFrame([(1, 0, "A.", [0.0] * 8, 1.0)], word))
    assert scores.first().ours.word_box_count == 1 and scores.first().ours.avg_confidence == 1.0
    assert scores.first().our_reference.cer == 0 and [r.status for r in diff.collect()] == ["matched"]
