import os
import struct
import subprocess
import sys
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import api
from quillspark.operators import calls, images, layout
from quillspark.plans import pages as flow

PAGES = f"doc_id string, page_number int, width int, height int, pixels binary, regions array<{flow.REGION}>"
REQUESTS = "key string, content binary, prompt string, model string, max_tokens int"


def reader(log, answers, fails=()):
    """A factory of clients that answer by the size of the picture and note every call."""

    class BySize:
        def run(self, image, prompt, model, max_tokens):
            size = struct.unpack(">II", image[16:24])
            with open(log, "a") as f:
                f.write(f"{size[0]}x{size[1]}\n")
            if size in fails:
                raise ValueError("no answer")
            return answers.get(size, f"```\ntext {size[0]}\n```")

    return BySize


def region(label, x1, y1, x2, y2, task="text", score=0.9):
    return label, score, [x1, y1, x2, y2], [x1, y1, x2, y1, x2, y2, x1, y2], task


@pytest.fixture
def pages(spark):
    blank = lambda w, h: bytearray(np.full((h, w), 255, np.uint8).tobytes())
    first = [region("text", 500, 0, 900, 100), region("title", 0, 0, 400, 110), region("image", 0, 500, 300, 900, "skip"), region("text", 0, 200, 900, 300), region("dot", 0, 0, 4, 4)]
    rows = [("a", 2, 300, 100, blank(300, 100), None), ("a", 1, 200, 400, blank(200, 400), first), ("b", 1, 50, 60, blank(50, 60), [region("text", 0, 0, 1000, 1000)]), ("c", 1, 0, 0, None, first)]
    return spark.createDataFrame(rows, PAGES).repartition(3)


def asked(log):
    return sorted(log.read_text().split()) if log.exists() else []


def test_pages_and_regions_become_documents(spark, pages, tmp_path):
    answers = {(200, 400): "Headline\nfirst line of it\nsomething else\nthe end", (80, 44): "Headlinc", (80, 40): "first  lime of it", (180, 40): "nothing like that"}
    log, name = tmp_path / "log", uuid.uuid4().hex
    out = {r.doc_id: r for r in api.process_pages(pages, reader(str(log), answers, {(50, 60)}), "read", "m", name).collect()}
    assert asked(log) == sorted(["200x400", "80x44", "80x40", "180x40", "300x100", "50x60"])  # b's region is the page once more
    a = out["a"]
    assert a.text == f"--- Seite 1 ---\n{answers[200, 400]}\n\n--- Seite 2 ---\ntext 300" and a.page_texts == [answers[200, 400], "text 300"]
    regions = a.layout[0].regions
    assert [r.label for r in regions] == ["title", "text", "dot", "text", "image"] and [r["index"] for r in regions] == list(range(5))
    assert [r.content for r in regions] == ["Headline", "first line of it", "", "nothing like that", ""]
    assert a.layout[1].regions == [] and [(i.page_number, i.width, i.height, i.unit) for i in a.page_infos] == [(1, 200, 400, "pixel"), (2, 300, 100, "pixel")]
    assert a.warnings == ["Document layout: 5 regions detected on 2 page(s)."]
    assert out["b"].text == "" and out["b"].warnings == ["Seiten-OCR fehlgeschlagen: ValueError: no answer", "Region 0 (text) OCR fehlgeschlagen: ValueError: no answer", "Document layout: 1 regions detected on 1 page(s)."]
    assert out["c"].text == "" and [r.content for r in out["c"].layout[0].regions] == [""] * 5
    again = flow.process(pages, reader(str(log), answers), "read", "m", name, anchor=False, from_regions=True).filter("doc_id = 'a'").first()
    assert len(asked(log)) == 6  # the run of that name has all its answers
    assert again.page_texts == ["Headlinc\n\nfirst  lime of it\n\nnothing like that", "text 300"]
    plain = flow.process(pages, reader(str(log), answers), "read", "m", f"{name}-2", per_region=False).filter("doc_id = 'a'").first()
    assert len(asked(log)) == 6 + 3 and {r.content for r in plain.layout[0].regions} == {""}


def test_turned_pages_are_read_upright(spark, tmp_path):
    rng = np.random.default_rng(4)
    gray = np.full((240, 200), 255, np.uint8)
    for y in range(20, 160, 24):
        gray[y : y + 2, 20:180] = 0
        gray[y + 2 : y + 12, 20:180] = np.where(rng.random((10, 160)) < 0.4, 0, 255)
    turned = np.rot90(gray)
    page = spark.createDataFrame([("a", 1, turned.shape[1], turned.shape[0], bytearray(turned.tobytes()), None)], PAGES)
    add = lambda df: df.withColumn("regions", F.array(F.struct(F.lit("text").alias("label"), F.lit(0.5).alias("score"), F.array(*map(F.lit, (0, 0, 1000, 1000))).alias("bbox_2d"), F.array(*map(F.lit, (0,) * 8)).alias("polygon"), F.lit("text").alias("task_type"))))
    out = flow.process(page, reader(str(tmp_path / "log"), {}), "read", "m", uuid.uuid4().hex, detect=add, straighten=True, turn_regions=True).first()
    straight, angle = images.deskew(turned)
    assert angle and out.page_infos[0].angle == round(angle, 1) and (out.page_infos[0].width, out.page_infos[0].height) == (straight.shape[1], straight.shape[0])
    assert out.warnings[0] == images.TURNED.format(angle) and out.layout[0].regions[0].region_angle in (0, 90, 180)


def test_detected_boxes_become_regions(spark):
    box = "struct<label: string, score: double, bbox_2d: array<double>, order_seq: int, polygon: array<double>>"
    rows = [
        ("text", 0.9, [10.0, 10.0, 110.0, 60.0], 2, None), ("text", 0.8, [12.0, 11.0, 111.0, 61.0], 3, None),  # the same once more
        ("image", 0.9, [0.0, 0.0, 200.0, 400.0], 0, None), ("title", 0.7, [20.0, 15.0, 90.0, 50.0], 4, None),  # the whole page; within the first
        ("table", 0.3, [-20.0, 300.0, 150.5, 460.0], 1, [0.0, 301.0, 150.0, 303.0, 150.0, 450.0, 0.0, 450.0]), ("text", 0.1, [150.0, 100.0, 190.0, 140.0], 5, None), ("junk", 0.9, [150.0, 200.0, 190.0, 240.0], 6, None),
    ]
    df = spark.createDataFrame([(rows,)], f"boxes array<{box}>").withColumns({"tasks": F.create_map(*map(F.lit, ("text", "text", "table", "table", "junk", "abandon"))), "low": F.create_map(F.lit("table"), F.lit(0.25))})
    got = df.select(layout.detected(F.col("boxes"), F.lit(200.0), F.lit(400.0), F.col("tasks"), F.col("low")).alias("r")).first().r
    assert [(r.label, r.task_type, r.bbox_2d) for r in got] == [("table", "table", [0, 750, 750, 1000]), ("text", "text", [50, 25, 550, 150])]
    assert got[0].polygon == [0, 752, 750, 757, 750, 1000, 0, 1000] and got[1].polygon == [50, 25, 550, 25, 550, 150, 50, 150]


def test_calls_are_dealt_by_cost(spark):
    rows = [(f"k{i:04}", 100) for i in range(3000)] + [(f"big{i}", 30_000) for i in range(20)]
    dealt = calls.deal(spark.createDataFrame(rows, "key string, cost long"), 10, F.col("cost"))
    assert dealt.rdd.getNumPartitions() == 10 and dealt.columns == ["key", "cost", "bucket"]
    load = [r[0] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("cost")).select("sum(cost)").collect()]
    assert sum(load) == 900_000 and max(load) <= 1.4 * 90_000
    assert calls.deal(spark.createDataFrame([], "key string, cost long"), 10, F.col("cost")).count() == 0


def test_cache_asks_once_and_keeps_no_failures(spark, tmp_path):
    images_ = {i: images.png(np.zeros((4, 5 + i), np.uint8)) for i in range(6)}
    rows = [(i, bytearray(images_[i % 6]), "p", "m", 10) for i in range(18)]
    asks = spark.createDataFrame(rows, "id int, content binary, prompt string, model string, max_tokens int")
    asks = asks.withColumn("key", calls.key(F.col("content"), F.col("prompt"), F.col("model"), F.col("max_tokens")))
    log, cache = tmp_path / "log", calls.Cache(spark, f"{tmp_path}/cache")
    run = lambda name, fails=(): cache.complete(asks, reader(str(log), {}, fails), f"{tmp_path}/{name}", 4)
    first = run("l1", {(7, 4)}).collect()
    assert asked(log) == [f"{w}x4" for w in (10, 5, 6, 7, 8, 9)] and len(first) == 18
    assert {(r.id % 6, r.output, r.error) for r in first} == {(i, None if i == 2 else f"```\ntext {5 + i}\n```", "ValueError: no answer" if i == 2 else None) for i in range(6)}
    second = run("l2").collect()
    assert len(asked(log)) == 7 and all(r.output and r.cached == (r.id % 6 != 2) for r in second)  # only the failed one was asked again
    assert all(r.cached for r in run("l3").collect()) and len(asked(log)) == 7
    assert cache.answers().count() == 6


KILLED = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from quillspark.operators import calls
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()

class Dies:
    n = 0
    def run(self, image, prompt, model, max_tokens):
        self.n += 1
        if self.n == 4 and not os.path.exists({log!r} + ".killed"):
            open({log!r} + ".killed", "w").close()
            os._exit(1)
        with open({log!r}, "a") as f:
            f.write(bytes(image).decode() + "\\n")
        return "answer " + bytes(image).decode()

rows = [(f"k{{i:02}}", bytearray(b"c%d" % i), "p", "m", 10) for i in range(40)]
asks = spark.createDataFrame(rows, "key string, content binary, prompt string, model string, max_tokens int")
out = calls.answered(asks, Dies, {ledger!r}, 3)
assert {{(r.key, r.output) for r in out.collect()}} == {{(f"k{{i:02}}", f"answer c{{i}}") for i in range(40)}}
assert out.count() == 40
"""


def test_a_killed_task_asks_nothing_again(tmp_path):
    log = tmp_path / "log"
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = KILLED.format(repo=repo, log=str(log), ledger=str(tmp_path / "ledger"))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": repo})
    assert done.returncode == 0, done.stderr[-2000:]
    assert (tmp_path / "log.killed").exists() and sorted(log.read_text().split()) == sorted(f"c{i}" for i in range(40))
