import io
import threading
import time
import uuid
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.plans import jobs
from quillspark.session import shared_dir, written
from quillspark.sources import documents, zips
from quillspark.streaming import jobs as lifecycles
from quillspark.streaming import state

EVENT = "id string, status string, at timestamp, seq long"


def follow(spark, tmp_path, rows, **options):
    """Adds a file of events and lets the stream go on; the states then."""
    if rows:
        df = spark.createDataFrame(rows, "id string, status string, at long, seq long").withColumn("at", F.timestamp_seconds("at"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    state.follow(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint", **options)
    return {r.id: r for r in state.settled(spark.read.parquet(f"{tmp_path}/out")).collect()}


def test_states_live_in_stores_and_end_by_timers(spark, tmp_path):
    first = follow(spark, tmp_path, [("a", "succeeded", 200, 2), ("a", "running", 100, 1), ("b", "running", 5000, 3), ("c", "running", 4900, 4), ("c", "cancelled", 4950, 5), ("t", "running", 4000, 6), ("t", "failed", 4000, 7)])
    assert {k: (r.status, r.n_events, r.is_final, r.gone) for k, r in first.items()} == {"a": ("succeeded", 2, True, True), "b": ("running", 1, False, False), "c": ("cancelled", 2, True, True), "t": ("failed", 2, True, False)}
    second = follow(spark, tmp_path, [("b", "succeeded", 5100, 8), ("b", "running", 5050, 7), ("d", "running", 8000, 9)])  # goes on from its checkpoint
    assert (second["b"].status, second["b"].n_events, second["b"].gone) == ("succeeded", 3, False) and second["t"].gone and not second["d"].gone
    assert second["b"].created_at.timestamp() - second["d"].updated_at.timestamp() == 5000 - 8000
    third = follow(spark, tmp_path, [("b", "running", 8650, 10), ("e", "running", 8700, None), ("a", "running", 8701, 11)])
    assert (third["b"].n_events, third["b"].gone) == (4, False)  # its timer was renewed
    assert (third["a"].n_events, third["a"].status, third["a"].gone) == (1, "running", False)  # begun anew
    assert follow(spark, tmp_path, []) == third
    log = spark.read.parquet(f"{tmp_path}/out")
    assert log.filter("id = 'b'").count() == 3 and {r.id for r in state.kept(log).collect()} == {"a", "b", "d", "e"}


def test_states_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(f"k{rng.integers(20)}", str(rng.choice(["running", "succeeded", "failed"])), int(rng.integers(9000)), i) for i in range(300)]
    got = follow(spark, tmp_path, rows)
    df = spark.createDataFrame(rows, "id string, status string, at long, seq long")
    batch = lifecycles.lifecycle(df.select("id", "status", F.struct("at", "seq").alias("updated_at"))).collect()
    assert {(r.id, r.status, r.n_events) for r in batch} == {(r.id, r.status, r.n_events) for r in got.values()}
    now = max(r[2] for r in rows)
    assert {k for k, r in got.items() if not r.gone} == {r.id for r in batch if r.updated_at.at > now - lifecycles.TTL_SECONDS}


RUNNERS, FILES = "runner_label string", "file_index long, file_name string"


def inputs(spark, n):
    files = spark.createDataFrame([(i, f"f{i}.png") for i in range(n)], FILES)
    return files, spark.createDataFrame([(f"f{i}.txt", f"text {i}") for i in range(n)], "file_name string, text string"), spark.createDataFrame([("x",), ("y",)], RUNNERS)


def test_a_job_stops_midway_and_keeps_what_is_done(spark, tmp_path):
    gate, seen = tmp_path / "gate", tmp_path / "seen"

    def slow(batches):
        for b in batches:
            for i in b["file_index"]:
                with open(seen, "a") as f:
                    f.write(f"{i}\n")
                end = time.time() + 60
                while i >= 4 and not gate.exists() and time.time() < end:  # waits in the third wave
                    time.sleep(0.05)
            yield b.assign(hypothesis=b["reference"], error=None, latency_ms=1)

    def run(rows):
        return rows.mapInPandas(slow, "file_index long, file_name string, reference string, runner_label string, hypothesis string, error string, latency_ms int")

    args = (*inputs(spark, 8), run, f"{tmp_path}/job", 4)
    job = jobs.job(*args)
    assert job.status == jobs.PENDING and job.rows() is None
    job.start()
    end = time.time() + 120
    while not (seen.exists() and "4" in seen.read_text().split()) and time.time() < end:
        time.sleep(0.1)
    assert job.status == jobs.RUNNING and job.cancel()
    begun = time.time()
    assert job.wait(40) == jobs.CANCELLED and time.time() - begun < 30 and job.error is None
    assert job.finished() == {0, 1} and job.progress() == (8, 16) and {r.file_index for r in job.rows().collect()} == {0, 1, 2, 3}
    assert {r.runner_label: r.success_count for r in job.aggregate().collect()} == {"x": 4, "y": 4}
    assert spark.range(10).count() == 10  # the session goes on
    gate.touch()
    rest = jobs.job(*args).start()
    assert rest.wait(120) == jobs.DONE and rest.progress() == (16, 16) and not rest.cancel()
    asked = seen.read_text().split()
    assert asked.count("0") == 2 and asked.count("7") == 2  # finished waves aren't run again


def test_a_failing_job_says_so(spark, tmp_path):
    job = jobs.job(*inputs(spark, 3), lambda rows: rows.withColumn("hypothesis", F.raise_error(F.lit("no luck"))), f"{tmp_path}/job", 2)
    assert job.start().wait(120) == jobs.FAILED and "no luck" in job.error and job.rows() is None and not job.cancel()


def test_shared_folder(spark):
    class Session:
        class sparkContext:
            master, applicationId = "spark://host:7077", uuid.uuid4().hex

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert shared_dir(Session).startswith("file:///") and shared_dir(Session) == shared_dir(Session)
    assert written(spark.range(3), "t").count() == 3


def archive(entries):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in entries:
            z.writestr(name, content)
    return data.getvalue()


def test_archives_are_read_entry_by_entry(spark, tmp_path):
    (tmp_path / "z").mkdir()
    small = [("a/x.png", b"\x89PNG\r\n\x1a\n"), ("a/x.txt", " near "), ("d/", ""), ("__MACOSX/x.png", b"?"), ("y.jpg", b"\xff\xd8\xff"), ("y.txt", "top"), ("b/y.gif", b"GIF89a")]
    (tmp_path / "z" / "small.zip").write_bytes(archive(small))
    big = [(f"n{i:03}.bin", np.random.default_rng(i).bytes(40_000)) for i in range(60)]
    (tmp_path / "z" / "big.ZIP").write_bytes(archive(big))
    (tmp_path / "z" / "none.zip").write_bytes(b"PK no archive")
    hurt = archive([("h.png", b"\x89PNG\r\n\x1a\n one two three")])
    (tmp_path / "z" / "hurt.zip").write_bytes(hurt.replace(hurt[40:44], b"XXXX"))
    rows = zips.read(spark, f"{tmp_path}/z", partitionbytes=300_000)
    assert rows.rdd.getNumPartitions() >= 8  # the large archive is dealt by its directory
    got = {(r.archive, r.path): r for r in rows.collect()}
    assert {k[1]: bytes(r.content) for k, r in got.items() if k[0] == "big.ZIP"} == dict(big)
    assert {k[1] for k in got if k[0] == "small.zip"} == {"a/x.png", "a/x.txt", "y.jpg", "y.txt", "b/y.gif"} and got["hurt.zip", "h.png"].content is None and got["hurt.zip", "h.png"].error
    one = zips.read(spark, f"{tmp_path}/z", content=False).filter("archive = 'big.ZIP' and path in ('n003.bin', 'n004.bin') and path like 'n003%'")
    assert [(r.path, r.size, r.content) for r in one.collect()] == [("n003.bin", 40_000, None)]
    assert "n003" not in one._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]  # no filter is left above the scan
    assert [r.error for r in zips.read(spark, f"{tmp_path}/z/big.ZIP", most=100).select("error").distinct().collect()] == ["too large"]
    files = sorted((r.archive, r.file_name, r.content_type, r.reference) for r in zips.uploads(spark, f"{tmp_path}/z").collect())
    bodies = spark.createDataFrame([("small.zip", bytearray((tmp_path / "z" / "small.zip").read_bytes()))], "archive string, content binary")
    assert files == sorted((r.archive, r.file_name, r.content_type, r.reference) for r in documents.expand_zip(bodies).collect())


def test_an_archive_larger_than_its_reader(tmp_path):
    """400 MB of entries pass through one task that holds little more than one of them."""
    with zipfile.ZipFile(tmp_path / "large.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for i in range(100):
            z.writestr(f"{i}", bytes(4 << 20))
    reader = zips.ZipReader({"path": str(tmp_path)})
    parts, n, most = reader.partitions(), 0, 0
    for part in parts:
        for batch in reader.read(part):
            n, most = n + batch.num_rows, max(most, batch.nbytes)
    assert n == 100 and most <= zips.HELD_BYTES + (4 << 20) + 1000


def test_written_archives_come_back(spark, tmp_path):
    rows = [(f"p{i}", bytearray(f"content {i}".encode() * i)) for i in range(50)]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(3)
    zips.write(df, f"{tmp_path}/w")
    zips.write(df.filter("path = 'p1'").withColumn("path", F.lit("again")), f"{tmp_path}/w")
    got = {r.path: bytes(r.content) for r in zips.read(spark, f"{tmp_path}/w").collect()}
    assert got == {p: bytes(c) for p, c in rows} | {"again": b"content 1"}
    with pytest.raises(Exception, match="lost"):
        zips.write(df.withColumn("content", F.when(F.col("path") == "p9", F.raise_error(F.lit("lost"))).otherwise(F.col("content"))), f"{tmp_path}/v")
    assert not list((tmp_path / "v").glob("*.zip")) if (tmp_path / "v").exists() else True


def test_threads_keep_their_own_tags(spark):
    assert threading.current_thread() is threading.main_thread() and not any(t.startswith("benchmark-") for t in spark.sparkContext.getJobTags())
