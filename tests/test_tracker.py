import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quillspark.sources.tracker import Tracker, log_rows, save_runs


@pytest.fixture
def server():
    calls: list = []

    class Answers(BaseHTTPRequestHandler):
        def do_GET(self):
            calls.append((self.path, None))
            self.send_response(404)
            self.end_headers()

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            calls.append((self.path.rsplit("mlflow/")[-1], body))
            found = {"experiments/create": {"experiment_id": "7"}, "runs/create": {"run": {"info": {"run_id": f"r-{body.get('run_name')}"}}}}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(found.get(calls[-1][0], {})).encode())

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", calls
    http.shutdown()


def test_rows_become_nested_runs(spark, server):
    uri, calls = server
    tracker = Tracker(uri, "bench marks").open()
    parent = tracker.start("all")
    rows = spark.createDataFrame([("a", None, 0.5, 3), ("b", "x", float("nan"), None)], "runner string, model string, cer double, n int")
    got = sorted(map(tuple, log_rows(rows, tracker, "runner", ["model"], ["cer", "n"], parent).collect()))
    assert got == [("a", "r-a"), ("b", "r-b")]
    assert tracker.url("r-a") == f"{uri}/#/experiments/7/runs/r-a"
    logged = {b["run_id"]: ({p["key"]: p["value"] for p in b["params"]}, {m["key"]: m["value"] for m in b["metrics"]}) for path, b in calls if path == "runs/log-batch"}
    assert logged == {"r-a": ({"model": ""}, {"cer": 0.5, "n": 3.0}), "r-b": ({"model": "x"}, {})}
    nested = [b for path, b in calls if path == "runs/create" and {"key": "mlflow.parentRunId", "value": "r-all"} in b["tags"]]
    assert {b["run_name"] for b in nested} == {"a", "b"}
    assert sum(path == "runs/update" for path, _ in calls) == 2
    tracker.log("r", {f"p{i}": i for i in range(150)}, {"m": 1})
    assert [len(b["params"]) for path, b in calls if path == "runs/log-batch" and b["run_id"] == "r"] == [100, 50]


def test_failures_are_swallowed(spark):
    for uri in ("", "file:/tmp/runs", "http://127.0.0.1:9"):
        tracker = Tracker(uri, timeout=1).open()
        rows = spark.createDataFrame([("a", 1.0)], "runner string, cer double")
        assert [tuple(r) for r in log_rows(rows, tracker, "runner", [], ["cer"]).collect()] == [("a", None)]
        tracker.log(None, {"a": 1})
        tracker.end(None)
        assert tracker.url(None) is None
        assert tracker.failures == (4 if uri.startswith("http") else 0)  # looked for and created, twice


def test_runs_are_logged_once_when_all_rows_are_there(spark, server, tmp_path):
    uri, calls = server
    tracker = Tracker(uri, "bench marks").open()
    rows = spark.createDataFrame([(f"r{i}", None if i else "x", float("nan") if i == 1 else i / 2) for i in range(9)], "runner string, model string, cer double").repartition(3)
    with pytest.raises(Exception, match="lost"):  # one task fails after others have staged their rows: nothing is sent
        save_runs(rows.withColumn("cer", F.when(F.col("runner") == "r5", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("cer"))), tracker, "runner", ["model"], ["cer"])
    assert not [1 for path, _ in calls if path == "runs/create"]
    got = {r.run_name: r.run_id for r in save_runs(rows, tracker, "runner", ["model"], ["cer"], "p").collect()}
    assert got == {f"r{i}": f"r-r{i}" for i in range(9)}
    created = [b["run_name"] for path, b in calls if path == "runs/create"]
    assert sorted(created) == sorted(got) and sum(path == "runs/update" for path, _ in calls) == 9
    logged = {b["run_id"]: ({p["key"]: p["value"] for p in b["params"]}, {m["key"]: m["value"] for m in b["metrics"]}) for path, b in calls if path == "runs/log-batch"}
    assert logged["r-r0"] == ({"model": "x"}, {"cer": 0.0}) and logged["r-r1"] == ({"model": ""}, {}) and logged["r-r4"] == ({"model": ""}, {"cer": 2.0})
    assert {r.run_id for r in save_runs(rows.limit(2), Tracker(""), "runner", [], ["cer"]).collect()} == {None}
    assert save_runs(rows.limit(0), tracker, "runner", [], ["cer"]).count() == 0
