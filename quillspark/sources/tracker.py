"""Runs of a benchmark sent to an experiment tracker over the public REST interface of MLflow.

A side channel: without a server's address nothing is sent, and what fails is counted, never raised. Only
addresses over HTTP are served; files of a tracker's local store aren't written. ``save_runs`` is a data
source's writer: tasks write their rows to a staging folder, and only the commit of the whole job sends
them, those of successful attempts, once. A job that fails sends nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from urllib import parse, request

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quillspark.session import shared_dir
from quillspark.sources import files

#: Bounds of the interface for one request.
MOST_PARAMS, MOST_METRICS = 100, 1000


@dataclass
class Tracker:
    uri: str = ""
    experiment: str = "benchmark"
    experiment_id: str | None = None
    timeout: float = 10.0
    failures: int = 0

    @property
    def enabled(self) -> bool:
        return self.uri.startswith(("http://", "https://"))

    def _call(self, path: str, body: dict | None = None) -> dict:
        """The answer as an object; empty if anything fails."""
        if not self.enabled:
            return {}
        try:
            data = None if body is None else json.dumps(body).encode()
            with request.urlopen(request.Request(f"{self.uri.rstrip('/')}/api/2.0/mlflow/{path}", data, {"Content-Type": "application/json"}), timeout=self.timeout) as r:
                return json.loads(r.read() or b"{}")
        except (OSError, ValueError):
            self.failures += 1
            return {}

    def open(self) -> Tracker:
        """Finds or creates the experiment; done once on the driver, so that tasks don't race for it."""
        if self.enabled and self.experiment_id is None:
            found = self._call(f"experiments/get-by-name?experiment_name={parse.quote(self.experiment)}").get("experiment") or self._call("experiments/create", {"name": self.experiment})
            self.experiment_id = found.get("experiment_id")
        return self

    def start(self, name: str, parent: str | None = None) -> str | None:
        """The id of a new run, nested in ``parent``; null if there is none."""
        if self.experiment_id is None:
            return None
        tags = [{"key": "mlflow.runName", "value": name}] + ([{"key": "mlflow.parentRunId", "value": parent}] if parent else [])
        run = self._call("runs/create", {"experiment_id": self.experiment_id, "run_name": name, "start_time": _now(), "tags": tags}).get("run", {})
        return run.get("info", {}).get("run_id")

    def log(self, run: str | None, params: dict | None = None, metrics: dict | None = None) -> None:
        """Parameters that are null are empty; metrics that are no finite numbers are left out."""
        if run is None:
            return
        given = [{"key": k, "value": "" if _missing(v) else str(v)} for k, v in (params or {}).items()]
        numbers = [{"key": k, "value": float(v), "timestamp": _now(), "step": 0} for k, v in (metrics or {}).items() if _number(v)]
        for i in range(0, max(-(-len(given) // MOST_PARAMS), -(-len(numbers) // MOST_METRICS))):
            some = {"params": given[i * MOST_PARAMS : (i + 1) * MOST_PARAMS], "metrics": numbers[i * MOST_METRICS : (i + 1) * MOST_METRICS]}
            self._call("runs/log-batch", {"run_id": run, **some})

    def end(self, run: str | None) -> None:
        if run is not None:
            self._call("runs/update", {"run_id": run, "status": "FINISHED", "end_time": _now()})

    def url(self, run: str | None) -> str | None:
        return f"{self.uri.rstrip('/')}/#/experiments/{self.experiment_id}/runs/{run}" if run and self.experiment_id else None


def _now() -> int:
    return int(time.time() * 1000)


def _missing(v) -> bool:
    return v is None or v != v


def _number(v) -> bool:
    return not _missing(v) and hasattr(v, "__float__") and not isinstance(v, str) and abs(float(v)) != float("inf")


def log_rows(rows: DataFrame, tracker: Tracker, name: str, params: list[str], metrics: list[str], parent: str | None = None) -> DataFrame:
    """run_name, run_id: each of ``rows`` logged as a run of its own, named by its column ``name``; run_id is null where the tracker can't be reached.

    Nothing is sent before an action runs on the result, and a task that is retried logs its rows once more;
    ``save_runs`` logs once.
    """
    tracker.open()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = []
            for row in b.to_dict("records"):
                ids.append(tracker.start(str(row[name]), parent))
                tracker.log(ids[-1], {c: row[c] for c in params}, {c: row[c] for c in metrics})
                tracker.end(ids[-1])
            yield pd.DataFrame({"run_name": b[name].astype(str), "run_id": pd.Series(ids, b.index, object)})

    return rows.select(*dict.fromkeys([name, *params, *metrics])).mapInPandas(run, "run_name string, run_id string")


@dataclass
class Staged(WriterCommitMessage):
    path: str | None


class RunsWriter(DataSourceArrowWriter):
    """Rows (name, params, metrics: maps) staged by tasks, logged by the commit, which keeps one task's rows in memory at a time."""

    def __init__(self, options: dict):
        self.folder, self.parent = options["path"], options.get("parent") or None
        self.tracker = Tracker(**json.loads(options["tracker"]))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        system, root = files.opened(self.folder)
        path = None
        for batch in batches:
            if not len(batch):
                continue
            if path is None:
                system.create_dir(root, recursive=True)
                path = f"{root}/{uuid.uuid4().hex}.staged"
                out = system.open_output_stream(path)
            for row in batch.select(["name", "params", "metrics"]).to_pylist():
                out.write(json.dumps(row, default=str).encode() + b"\n")
        if path is not None:
            out.close()
        return Staged(path)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = files.opened(self.folder)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/runs.jsonl") as ids:
            for path in [m.path for m in messages if m and m.path]:
                with system.open_input_stream(path) as f:
                    rows = f.read().splitlines()
                for row in map(json.loads, rows):
                    run = self.tracker.start(row["name"], self.parent)
                    self.tracker.log(run, dict(row["params"]), dict(row["metrics"]))
                    self.tracker.end(run)
                    ids.write(json.dumps({"run_name": row["name"], "run_id": run}).encode() + b"\n")
        self._clear(system, root)

    def abort(self, messages: list[Staged | None]) -> None:
        system, root = files.opened(self.folder)
        self._clear(system, root)

    @staticmethod
    def _clear(system, root: str) -> None:
        """Staged files go, those of attempts that failed among them."""
        for info in files.listed(system, root, ".staged"):
            system.delete_file(info.path)


class RunsDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tracker"

    def schema(self) -> str:
        return "name string, params map<string,string>, metrics map<string,double>"

    def writer(self, schema, overwrite: bool) -> RunsWriter:
        return RunsWriter(dict(self.options))


def save_runs(rows: DataFrame, tracker: Tracker, name: str, params: list[str], metrics: list[str], parent: str | None = None) -> DataFrame:
    """run_name, run_id: each of ``rows`` logged as a run of its own, once, named by its column ``name``; run_id is null where the tracker can't be reached."""
    spark = rows.sparkSession
    tracker.open()
    spark.dataSource.register(RunsDataSource)
    folder = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    pairs = lambda columns, kind: F.map_from_arrays(F.array(*map(F.lit, columns)).cast("array<string>"), F.array(*(F.col(c).cast(kind) for c in columns)).cast(f"array<{kind}>"))
    staged = rows.select(F.col(name).cast("string").alias("name"), pairs(params, "string").alias("params"), pairs(metrics, "double").alias("metrics"))
    given = {k: v for k, v in asdict(tracker).items() if k != "failures"}
    staged.write.format("tracker").mode("append").options(tracker=json.dumps(given), parent=parent or "").save(folder)
    return spark.read.schema("run_name string, run_id string").json(f"{folder}/runs.jsonl")
