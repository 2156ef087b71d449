import io
import random
import tracemalloc
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import editdist, structured
from quillspark.operators import images, inference, layout, matching, metrics, projection, tables
from quillspark.plans import benchmark
from quillspark.sources import documents as sources
from quillspark.sources import sinks
from quillspark.streaming import jobs

BOXES = "page_id int, boxes array<struct<i: int, label: string, score: double, order_seq: int, bbox_2d: array<double>>>"


def pages_of_boxes(spark, rng, n=60):
    rows = []
    for p in range(n):
        own = []
        for i in range(rng.randint(0, 12)):
            x, y = rng.randint(0, 200), rng.randint(0, 200)
            own.append((i, rng.choice(["text", "image", "table"]), rng.choice([0.1, 0.5, 0.9, rng.random()]), rng.randint(0, 9), [float(x), float(y), float(x + rng.randint(5, 200)), float(y + rng.randint(5, 200))]))
        rows.append((p, own))
    return rows, spark.createDataFrame(rows, BOXES)


def test_suppression_containment_and_order_against_loops(spark):
    rows, df = pages_of_boxes(spark, random.Random(4))
    ids = lambda c: F.transform(c, lambda b: b["i"])
    got = {r.page_id: r for r in df.select("page_id", ids(layout.nms(F.col("boxes"))).alias("nms"), ids(layout.drop_contained(F.col("boxes"))).alias("large"), ids(layout.drop_contained(F.col("boxes"), "small")).alias("small"), ids(layout.reading_order(F.col("boxes"))).alias("order"), ids(layout.clip(F.col("boxes"), F.lit(150.0), F.lit(150.0))).alias("clip")).collect()}

    def iou(a, b):
        w, h = (max(0, min(a[k + 2], b[k + 2]) - max(a[k], b[k]) + 1) for k in (0, 1))
        area = lambda x: (x[2] - x[0] + 1) * (x[3] - x[1] + 1)
        return w * h / (area(a) + area(b) - w * h)

    def inside(a, b):
        w, h = (max(0, min(a[k + 2], b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
        return w * h / ((a[2] - a[0]) * (a[3] - a[1])) >= 0.8

    for p, own in rows:
        kept = []
        for b in sorted(own, key=lambda b: (-b[2], -b[0])):
            if all(iou(k[4], b[4]) < (0.6 if k[1] == b[1] else 0.98) for k in kept):
                kept.append(b)
        assert got[p].nms == [b[0] for b in kept]
        contained = {a[0] for a in own for b in own if a[0] != b[0] and a[1] != "image" and inside(a[4], b[4])}
        outer = {b[0] for a in own for b in own if a[0] != b[0] and a[1] != "image" and inside(a[4], b[4])}
        assert got[p].large == [b[0] for b in own if b[0] not in contained]
        assert got[p].small == [b[0] for b in own if b[0] not in outer or b[0] in contained]
        bands = []
        for b in sorted(own, key=lambda b: b[4][1]):
            c = (b[4][1] + b[4][3]) / 2
            if bands and abs(c - np.mean([(x[4][1] + x[4][3]) / 2 for x in bands[-1]])) <= 30:
                bands[-1].append(b)
            else:
                bands.append([b])
        assert got[p].order == [b[0] for band in bands for b in sorted(band, key=lambda b: b[4][0])]
        assert got[p].clip == [b[0] for b in own if b[4][0] < 150 and b[4][1] < 150]


def test_reading_order_and_labels(spark):
    rows = [(1, [(0, "right", 1.0, 0, [500.0, 0.0, 900.0, 100.0]), (1, "left", 1.0, 0, [0.0, 0.0, 400.0, 100.0]), (2, "bottom", 1.0, 0, [0.0, 200.0, 900.0, 300.0])])]
    out = spark.createDataFrame(rows, BOXES).select(F.transform(layout.reading_order(F.col("boxes")), lambda b: b["label"])).first()[0]
    assert out == ["left", "right", "bottom"]
    labels = ["Picture", "table_caption", "my tables", "Isolate_Formula", "equation", " ", "paragraph", "figure_caption"]
    got = spark.createDataFrame([(x,) for x in labels], "l string").select(layout.classify_label(F.col("l"))).collect()
    assert [g[0] for g in got] == ["skip", "table", "table", "formula", "formula", "text", "text", "skip"]


def test_oversized_images_and_thresholds(spark):
    whole, small = (0, "image", 0.9, 0, [0.0, 0.0, 100.0, 100.0]), (1, "text", 0.3, 0, [0.0, 0.0, 10.0, 10.0])
    df = spark.createDataFrame([(1, [whole, small]), (2, [whole]), (3, [whole, whole])], BOXES)
    n = df.select(F.size(layout.drop_oversized(F.col("boxes"), F.lit(100.0), F.lit(100.0)))).collect()
    assert [r[0] for r in n] == [1, 1, 2]
    n = df.select(F.size(layout.above_threshold(F.col("boxes"), F.create_map(F.lit("text"), F.lit(0.5))))).collect()
    assert [r[0] for r in n] == [1, 1, 2]


def test_word_diff_partitions_both_sides(spark):
    rng = random.Random(6)
    ours, theirs = [], []
    for side, n in ((ours, 80), (theirs, 70)):
        for i in range(n):
            x, y = rng.randint(0, 400), rng.randint(0, 400)
            side.append((i % 3, i, rng.choice(["Wort", "wort.", "Haus", "", "x1"]), [] if rng.random() < 0.1 else [float(v) for v in (x, y, x + 9, y, x + 9, y + 5, x, y + 5)]))
    schema = "page_id long, idx int, content string, polygon array<double>"
    got = matching.word_diff(spark.createDataFrame(ours, schema), spark.createDataFrame(theirs, schema)).collect()
    assert sorted(r.ours_idx for r in got if r.ours_idx is not None) == list(range(80))
    assert sorted(r.theirs_idx for r in got if r.theirs_idx is not None) == list(range(70))
    key = lambda t: t.lower().strip(".")
    center = lambda p: ((min(p[::2]) + max(p[::2])) / 2, (min(p[1::2]) + max(p[1::2])) / 2)

    def far(a, b):
        return 0.0 if not a or not b else float(np.hypot(*np.subtract(center(a), center(b))))

    for page in range(3):
        a, b = [w for w in ours if w[0] == page], [w for w in theirs if w[0] == page]
        used, want = (set(), set()), []
        for status, cand in (("matched", [(far(x[3], y[3]), x[1], y[1]) for x in a for y in b if key(x[2]) and key(x[2]) == key(y[2])]), ("mismatched", [(far(x[3], y[3]), x[1], y[1]) for x in a for y in b if x[3] and y[3] and far(x[3], y[3]) <= 120])):
            for _, i, j in sorted(cand):
                if i not in used[0] and j not in used[1]:
                    used[0].add(i), used[1].add(j)
                    want.append((status, i, j))
        assert sorted((r.status, r.ours_idx, r.theirs_idx) for r in got if r.page_id == page and r.status.endswith("matched")) == sorted(want)


def test_tokens_to_words_and_text_to_polygons(spark):
    words = spark.createDataFrame([(1, 0, 0, "Hausx"), (1, 1, 0, ""), (1, 2, 0, "zzz")], "page_id long, word_idx int, region_idx int, content string")
    regions = spark.createDataFrame([(1, 0, "Das Haus steht")], "page_id long, region_idx int, content string")
    got = sorted((r.word_idx, r.content) for r in matching.adopt_tokens(words, regions).collect())
    assert got == [(0, "Haus"), (1, "Das"), (2, "zzz")]
    pages = spark.createDataFrame([(1, "Das Haus steht"), (2, "")], "page_id long, text string")
    polys = spark.createDataFrame([(1, 0, "haus", [1.0] * 8, 0.5), (1, 1, "rest", [2.0] * 8, None), (1, 2, "Das", [], 0.1)], "page_id long, idx int, content string, polygon array<double>, confidence double")
    got = [(r.content, len(r.polygon), r.confidence) for r in matching.words_of_text(pages, polys, True).orderBy("page_id", "idx").collect()]
    assert got == [("Das", 0, 1.0), ("Haus", 8, 0.5), ("steht", 0, 1.0), ("rest", 8, 1.0)]


def test_alignment():
    source = "Kopf\nRechnung Nr. 4711\nBetrag\n12,50\nEUR\nEnde"
    assert matching.align("Rechnung Nr 4711\nBetrag 12,50 EUR", source) == "Rechnung Nr. 4711\nBetrag\n12,50\nEUR"
    assert matching.align("ganz anderes", source) == "ganz anderes" and matching.align("x", "") == "x"
    assert editdist.ratio("abcd", "bcde") == pytest.approx(75.0)


def test_projection_of_a_tilted_region(spark):
    region = "struct<content: string, bbox_2d: array<double>, polygon: array<double>, confidence: double>"
    word = "struct<content: string, polygon: array<double>, confidence: double>"
    rows = [
        ("d", 1, "page one", None, None),
        ("d", 2, "page two", [("page two", None, [10.0, 10.0, 48.0, 12.0, 50.0, 50.0, 12.0, 48.0], 0.87)], None),
        ("d", 3, "a\U0001f600 b", None, [("b", [1.0] * 8, 0.4), (" ", [1.0] * 8, 0.4), ("a", [1.0] * 4, 0.4)]),
        ("d", 4, "", [("x\ny", [0.0, 0.0, 100.0, 40.0], None, None)], None),
    ]
    df = spark.createDataFrame(rows, f"doc_id string, page_number int, text string, regions array<{region}>, word_polys array<{word}>")
    got = {r.page_number: r for r in projection.entries(df).collect()}
    assert [got[i].offset for i in (1, 2, 3, 4)] == [0, 10, 20, 26]
    w = got[2].words
    assert [(x.content, x.span.offset, x.span.length, x.confidence) for x in w] == [("page", 10, 4, 0.87), ("two", 15, 3, 0.87)]
    assert w[0].polygon == pytest.approx([10, 10, 29, 11, 31, 49, 12, 48]) and w[1].polygon == pytest.approx([33.75, 11.25, 48, 12, 50, 50, 35.75, 49.25])
    assert got[2].paragraphs[0].boundingRegions[0].pageNumber == 2
    assert [(x.content, x.span.offset) for x in got[3].words] == [("b", 23)]
    assert [x.polygon for x in got[4].lines] == [[0, 0, 100, 0, 100, 20, 0, 20], [0, 20, 100, 20, 100, 40, 0, 40]]
    assert projection.entries(df, "utf16CodeUnit").filter("page_number = 4").first().offset == 27
    result = projection.analyze_result(df.withColumn("info", F.lit(None).cast("struct<page_number: int, angle: double, width: int, height: int, unit: string, kind: string>"))).first().result
    assert result.content == "page one\n\npage two\n\na\U0001f600 b\n\nx\ny" and [p.unit for p in result.pages] == ["pixel"] * 4
    assert projection.document_text(df).first().text.startswith("--- Seite 1 ---\npage one\n\n--- Seite 2 ---")
    for p in got.values():
        for line in p.lines:
            assert result.content[line.spans[0].offset :][: line.spans[0].length] == line.content


def test_tables(spark):
    rows = [("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td> <b>2</b>&amp;</td></tr><tr></tr></table>",), ("| A | B |\n|---|:---:|\n| 1 | 2 |\nx",), ("none",)]
    df = spark.createDataFrame(rows, "m string")
    got = [r[0] for r in df.select(tables.parse_markup(F.col("m"))).collect()]
    assert got == [[["A", "B"], ["1", "2&"]], [["A", "B"], ["1", "2"]], []]
    cells = df.limit(1).select(F.inline(tables.build_cells(tables.parse_markup(F.col("m")), F.array(*map(F.lit, (100.0, 200.0, 900.0, 400.0)))))).collect()
    assert [(c.row, c.column, c.is_header) for c in cells] == [(0, 0, True), (0, 1, True), (1, 0, False), (1, 1, False)] and cells[3].bbox_2d == [500, 300, 900, 400]
    assert [r[0] for r in df.select(tables.markdown_rows(F.col("m"))).collect()] == [[], [["A", "B"], ["1", "2"]], []]
    assert df.select(tables.html_tables(F.col("m"))).first()[0] == [[["A", "B"], ["1", "2&"]]]
    m = spark.createDataFrame([([["a", 'b"'], ["c|"]],)], "r array<array<string>>")
    assert m.select(tables.to_csv(F.col("r"))).first()[0] == '"a","b"""\n"c|",""'
    assert m.select(tables.to_markdown(F.col("r"))).first()[0] == '| a | b" |\n| --- | --- |\n| c\\| |  |'
    assert m.select(tables.structured_rows(F.array().cast("array<string>"), F.col("r"))).first()[0] == [["col_1", "col_2"], ["a", 'b"'], ["c|", ""]]


def test_sources(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, data in (("a/x.png", b"\x89PNG\r\n\x1a\n"), ("a/x.txt", " near "), ("y.jpg", b"\xff\xd8\xff"), ("b/y.gif", b"GIF89a"), ("y.txt", "top"), ("bad.bin", b"?"), ("__MACOSX/z.png", b"\x89PNG\r\n\x1a\n")):
            z.writestr(name, data)
    got = sources.expand_zip(spark.createDataFrame([("z", bytearray(buffer.getvalue()))], "archive string, content binary")).collect()
    assert sorted((r.file_name, r.content_type, r.reference) for r in got) == [("x.png", "image/png", "near"), ("y.gif", "image/gif", "top"), ("y.jpg", "image/jpeg", "top")]
    rows = [("Image/PNG; q=1", b"?"), (None, b"%PDF-1"), ("application/octet-stream", b"?"), ("text/plain", b"%PDF-1"), ("application/zip", b""), (None, b"PK\x03\x04word/")]
    df = spark.createDataFrame([(a, bytearray(b)) for a, b in rows], "t string, c binary").coalesce(1)
    out = df.select(sources.effective_type(F.col("t"), F.col("c")).alias("e"), sources.is_zip(F.col("t"), F.col("c")).alias("z")).collect()
    assert [r.e.content_type for r in out] == ["image/png", "application/pdf", None, None, None, sources.DOCX] and [r.z for r in out] == [False, False, False, False, True, False]
    paged = '{"pages":[{"width":2000,"height":1000,"words":[{"content":"a","polygon":[0,0,1500,0,1500,500,0,500],"confidence":0.5},{"content":"b","polygon":[1,2]}]},{"width":500,"height":500}]}'
    got = spark.createDataFrame([(paged,)], "j string").select(sources.paged_words(F.col("j"))).first()[0]
    assert got[0][0].polygon == [0, 0, 750, 0, 750, 500, 0, 500] and got[0][1].polygon == [] and got[0][1].confidence == 0 and got[1] == []
    noted = '{"responses":[{"fullTextAnnotation":{"pages":[{"width":200,"height":100,"blocks":[{"paragraphs":[{"words":[{"confidence":0.9,"symbols":[{"text":"a"},{"text":"b"}],"boundingBox":{"vertices":[{"x":20,"y":10},{"x":40},{"x":40,"y":20},{"y":20}]}}]}]}]}]}}]}'
    w = spark.createDataFrame([(noted,)], "j string").select(sources.annotated_words(F.col("j"))).first()[0][0][0]
    assert (w.content, w.polygon) == ("ab", [100, 100, 200, 0, 200, 200, 0, 200])
    bodies = spark.createDataFrame([('{"text": "x"}',), ('"q\\n"',), ("raw",)], "b string").coalesce(1)
    assert [r[0] for r in bodies.select(sources.plain_text(F.col("b"))).collect()] == ["x", "q\n", "raw"]


def test_metrics_and_benchmark(spark):
    rows = [("r", "done", 0.1, 0.2, 0.9, 10), ("r", "done", 0.3, None, 0.7, 30), ("r", "error", 9.0, 9.0, 0.0, 99), ("s", "done", 0.5, 0.5, 0.5, 5)]
    out = {x.runner_label: x for x in metrics.per_runner(spark.createDataFrame(rows, "runner_label string, status string, cer double, wer double, token_f1 double, latency_ms int")).collect()}
    assert out["r"].success_count == 2 and out["r"].failure_count == 1 and out["r"].mean_cer == pytest.approx(0.2) and out["r"].mean_wer == pytest.approx(0.2)
    assert out["r"].stdev_cer == pytest.approx(0.1414213) and out["s"].stdev_cer is None
    words = "array<struct<content: string, confidence: double>>"
    df = spark.createDataFrame([("a b a", [("a", 0.5), ("b", 0.0)], 3, "a c", [], 4, "a b"), ("x", [], 1, "", [], 1, " ")], f"our_text string, our_words {words}, our_latency_ms int, their_text string, their_words {words}, their_latency_ms int, reference_text string").coalesce(1)
    one, two = metrics.compute(df).collect()
    assert one.ours.avg_confidence == 0.5 and one.ours.tokens == 3 and one.comparison.token_jaccard == pytest.approx(1 / 3) and one.our_reference.token_f1 == 1.0 and one.their_reference.cer == pytest.approx(1 / 3)
    assert two.our_reference is None and two.comparison.token_f1 == 0 and two.comparison.delta_char == 1
    docs = spark.createDataFrame([(1, "ein Ende."), (2, "")], "doc_id long, text string")
    got = {r.runner_label: r for r in benchmark.summary(benchmark.score(benchmark.corrupted(docs))).collect()}
    assert got["identity"].mean_f1 == 1.0 and got["upper"].mean_f1 == 0.0 and got["identity"].stdev_f1 is None
    files = spark.createDataFrame([("a.png",), ("b.png",)], "file_name string")
    assert {(r.file_name, r.reference) for r in benchmark.with_references(files, spark.createDataFrame([("a.txt", "t")], "file_name string, text string")).collect()} == {("a.png", "t"), ("b.png", "")}
    assert benchmark.jobs(files, spark.createDataFrame([("m",)], "runner string")).count() == 2
    for n in (0, 8):
        with pytest.raises(ValueError):
            benchmark.jobs(files, spark.createDataFrame([(f"m{i}",) for i in range(n)], "runner string"))
    line = sinks.csv_lines(spark.createDataFrame([(1, 'a"b', ["x", "y"])], "file_index int, file_name string, warnings array<string>")).first().line
    assert line == '1,"a""b",,,,,,,,,,,x | y,,,'
    assert [r[0] for r in spark.createDataFrame([("gpt-4 (Layout)",), ("!",)], "l string").coalesce(1).select(sinks.label_slug(F.col("l"))).collect()] == ["gpt_4__Layout", "runner"]


def test_retries_and_routes(spark):
    prompt = "Extrahiere sichtbaren Text exakt mit Zeilenumbrüchen."
    rows = [(1, "ocr_text", prompt, False), (2, "ocr_text", prompt, True), (3, "describe_image", "Describe this image briefly.", False)]
    df = spark.createDataFrame([(i, t, p, c, bytearray(b""), "m", 10) for i, t, p, c in rows], "id long, task string, prompt string, custom boolean, content binary, model string, max_tokens int").coalesce(1)

    class Echo:
        def run(self, image, prompt, model, max_tokens):
            if prompt.startswith("Nur"):
                raise OSError("down")
            return prompt if "Text" in prompt else "Ein Hund läuft"

    again = {t: ["Kurz: Text?", "Nur Text"] for t in inference.TASKS}
    got = {r.id: r for r in inference.with_retries(df, Echo, again).collect()}
    assert got[1].error.startswith("OSError") and got[1].text == "" and got[2].text == prompt and got[3].text == "Ein Hund läuft"
    routes = [("expert", "plain", None, None, "image/png"), (None, "structured", None, None, "image/png"), ("", "plain", None, None, "image/png"), ("expert", "plain", "ocr_text", "x", "image/gif"), ("expert", "plain", "ocr_text", " ", "image/gif")]
    out = inference.route(spark.createDataFrame(routes, "backend string, mode string, task string, custom_prompt string, content_type string").coalesce(1)).collect()
    assert [r.backend for r in out] == ["expert", "direct", "direct", "direct", "direct"]
    assert [r.reason for r in out] == [None, inference.FALLBACK_REASONS["mode"], None, inference.FALLBACK_REASONS["task"], inference.FALLBACK_REASONS["gif"]]
    pages = spark.createDataFrame([("a", 1, '{"total": "5"}', "x"), ("a", 2, "no", ""), ("b", 1, '{"total": "5"}', "No visible text.")], "doc_id string, page_number int, output string, evidence string")
    got = {r.doc_id: r for r in inference.structured_pages(pages, "receipt_basic").collect()}
    assert got["a"].data["total"] == '"5"' and got["b"].data["total"] is None and any(w.startswith("Seite 2: ") for w in got["a"].warnings)


def test_jobs_in_batch(spark):
    rows = [("a", "notStarted", 1), ("a", "succeeded", 3), ("a", "running", 2), ("b", "running", 1)]
    df = spark.createDataFrame(rows, "id string, status string, t long").select("id", "status", F.timestamp_seconds("t").alias("updated_at"))
    batch = sorted((r.id, r.status, r.n_events, r.is_final) for r in jobs.lifecycle(df).collect())
    assert batch == [("a", "succeeded", 3, True), ("b", "running", 1, False)]
    assert {(r.id, r.status) for r in jobs.latest(df).collect()} == {("a", "succeeded"), ("b", "running")}
    assert jobs.can_follow("running", "succeeded") and not jobs.can_follow("succeeded", "running")


def test_page_angles():
    page = np.full((300, 300), 255, np.uint8)
    page[40:260:20, 30:270] = 0
    assert images.page_angle(page) == 0
    y, x = np.mgrid[:300, :300]
    t = np.deg2rad(6)
    turned = np.where((np.round(-np.sin(t) * x + np.cos(t) * y).astype(int) % 20) < 2, 0, 255).astype(np.uint8)
    assert abs(images.page_angle(turned) - 6) <= 1
    assert images.cardinal_rotation(page)[0] == 0 and images.cardinal_rotation(page.T)[0] == 90
    assert images.flatten_alpha(np.array([[[0, 0, 0, 0], [10, 20, 30, 255]]], np.uint8)).tolist() == [[[255, 255, 255], [10, 20, 30]]]


def _lines(side=240):
    """Lines of text-like marks in the upper part: full at the top of a line, thin below."""
    page = np.full((side, side), 255, np.uint8)
    for y in range(20, 140, 20):
        page[y : y + 6, 30:210], page[y + 6 : y + 9, 30:210:6] = 0, 0
    return page


def test_pages_are_straightened():
    page = _lines()
    assert images.deskew(page)[1] == 0
    assert images.cardinal_rotation(page)[0] == 0 and images.cardinal_rotation(page)[1] > 0.99 and images.cardinal_rotation(page[::-1, ::-1])[0] == 180
    for lean in (-90, -30, -6, 4, 25, 90, 180):
        level, angle = images.deskew(images.turn(page, -lean))
        assert abs((angle - lean + 180) % 360 - 180) <= 1, lean
        rows = images.dark(level).sum(1)
        assert rows.max() > 150  # a whole line lies in one row
    blank = np.full((50, 40), 255, np.uint8)
    assert images.deskew(blank)[1] == 0 and images.page_angle(blank) == 0 and images.top_heavy(images.dark(blank)) == 0
    assert images.turn(page, 90).tolist() == np.rot90(page).tolist()


def test_sizes_orientation_and_storyboards():
    flat = np.full((30, 20), 77, np.uint8)
    assert images.resize(flat, 50, 7).tolist() == np.full((7, 50), 77).tolist()
    ramp = np.tile(np.arange(0, 250, 5, np.uint8), (10, 1))
    up = images.resize(ramp, 100, 10).astype(int)
    assert (np.diff(up[0, 8:-8]) >= 0).all() and abs(up[0, 50] - 126) <= 2
    got, angle, warnings = images.prepared(np.full((90, 60), 255, np.uint8), smallest=180)
    assert got.shape == (180, 120) and angle == 0 and warnings == ["Binärbild (L) von 60x90 auf 120x180 hochskaliert (LANCZOS) für robustere OCR"]
    got, _, warnings = images.prepared(np.full((90, 61), 255, np.uint8), "RGB", smallest=180, largest=45)
    assert got.shape == (45, 30) and warnings == ["Eingabe wurde von 61x90 auf 30x45 skaliert"]
    a = np.array([[1, 2, 3], [4, 5, 6]], np.uint8)
    assert [images.oriented(a, o)[0].tolist() for o in range(1, 10)] == [[1, 2, 3], [3, 2, 1], [6, 5, 4], [4, 5, 6], [1, 4], [4, 1], [6, 3], [3, 6], [1, 2, 3]]
    board = images.storyboard([np.full((2, 2), i, np.uint8) for i in range(7)])
    assert board.tolist() == [[0, 0, 2, 2]] * 2 + [[4, 4, 6, 6]] * 2
    assert images.storyboard([a, a[:, :1]]).tolist() == [[1, 2, 3, 255, 1, 255], [4, 5, 6, 255, 4, 255]]
    assert images.storyboard([a]).tolist() == a.tolist()


def test_prepare(spark):
    page = np.rot90(_lines(), 3)
    rows = [(1, "RGB", 6, 240, 240, bytearray(page.tobytes())), (2, "RGB", None, 240, 240, bytearray(_lines().tobytes()))]
    got = {r.image_id: r for r in images.prepare(spark.createDataFrame(rows, "image_id long, mode string, orientation int, width int, height int, pixels binary"), True).collect()}
    assert got[2].angle == 0 and got[2].warnings == [] and (got[2].width, got[2].height) == (240, 240)
    data = bytes(got[2].content)
    at = data.index(b"IDAT")
    raw = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + int.from_bytes(data[at - 4 : at], "big")]), np.uint8).reshape(240, 241)
    assert raw[:, 1:].tolist() == _lines().tolist() and data.startswith(b"\x89PNG")
    assert got[1].angle == 180 and got[1].warnings == ["Deskew: 180.0° CCW Korrektur angewendet"]


def test_broken_archives_and_entries_are_left_out(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.png", b"\x89PNG\r\n\x1a\n one")
        z.writestr("b.png", b"\x89PNG\r\n\x1a\n two two two")
    whole = data.getvalue()
    at = whole.index(b"two two")
    hurt = whole[:at] + b"TWO" + whole[at + 3 :]  # its checksum fails
    rows = [("good", bytearray(whole)), ("hurt", bytearray(hurt)), ("none", bytearray(b"PK\x03\x04 no archive")), ("null", None)]
    got = sources.expand_zip(spark.createDataFrame(rows, "archive string, content binary")).collect()
    assert sorted((r.archive, r.file_name) for r in got) == [("good", "a.png"), ("good", "b.png"), ("hurt", "a.png")]


def test_arrays_only_schemas_have_an_array_of_warnings(spark):
    pages = spark.range(1).select(structured.merge(F.array(F.create_map(F.lit("tags"), F.lit('["a"]'))), {"tags": "array<string>"}).alias("m"))
    assert pages.first().m.warnings == []


def test_words_meet_regions_across_grid_cells(spark):
    rng = random.Random(5)
    box = lambda w, h: [x := rng.uniform(-50, 400), y := rng.uniform(-50, 400), x + rng.uniform(1, w), y + rng.uniform(1, h)]  # noqa: E731,F841
    words, regions = [(i % 2, i, box(150, 60)) for i in range(200)], [(i % 2, i, box(300, 300)) for i in range(30)]
    got = matching.words_to_regions(spark.createDataFrame(words, "page_id int, word_idx int, bbox_2d array<double>"), spark.createDataFrame(regions, "page_id int, region_idx int, bbox_2d array<double>")).collect()
    want = set()
    for p, i, w in words:
        area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
        found = []
        for q, k, r in regions:
            s = [max(w[0], r[0]), max(w[1], r[1]), min(w[2], r[2]), min(w[3], r[3])]
            if p == q and s[0] < s[2] and s[1] < s[3] and area(s) / max(1.0, area(w)) > 0.1:
                found.append((area(r), k))
        if found:
            want.add((p, i, min(found)[1]))
    assert {tuple(r) for r in got} == want


def test_greedy_pairs_equal_sorting_all_pairs():
    rng = random.Random(8)
    for n, m, span, missing in ((0, 5, 10, 0), (30, 25, 100, 0.2), (60, 60, 3, 0.1), (40, 90, 1000, 0), (50, 50, 0, 0)):
        point = lambda: None if rng.random() < missing else (rng.randint(0, span) * 1.5, rng.randint(0, span) * 0.5)  # noqa: B023,E731
        a, b = {i: point() for i in rng.sample(range(500), n)}, {i: point() for i in rng.sample(range(500), m)}
        for most in (np.inf, span / 8):
            far = lambda p, q: 0.0 if p is None or q is None else float(np.hypot(p[0] - q[0], p[1] - q[1]))
            used, want = (set(), set()), []
            for d, i, j in sorted((far(p, q), i, j) for i, p in a.items() for j, q in b.items()):
                if d <= most and i not in used[0] and j not in used[1]:
                    used[0].add(i), used[1].add(j)
                    want.append((i, j))
            got = matching._greedy(a, b, most)
            assert sorted(got) == sorted(want)
    many = {i: (float(i % 7), 0.0) for i in range(10_000)}  # 10,000 equal words of a page, many in one place
    assert len(matching._greedy(many, {i: (x + 0.25, y) for i, (x, y) in many.items()})) == 10_000


def test_boxes_of_all_sizes_meet(spark):
    rng = random.Random(9)

    def box():
        size = 2 ** rng.uniform(-3, 13)
        return [x := rng.uniform(-5000, 5000), y := rng.uniform(-5000, 5000), x + size, y + size * rng.uniform(0.2, 1)]

    words, regions = [(i % 2, i, box()) for i in range(300)], [(i % 2, i, box()) for i in range(300)]
    regions += [(0, 300, [-5000.0, -5000.0, 5000.0, 5000.0]), (1, 301, [0.0, 0.0, 0.0, 9.0])]
    got = matching.words_to_regions(spark.createDataFrame(words, "page_id int, word_idx int, bbox_2d array<double>"), spark.createDataFrame(regions, "page_id int, region_idx int, bbox_2d array<double>")).collect()
    area, want = (lambda b: (b[2] - b[0]) * (b[3] - b[1])), set()
    for p, i, w in words:
        found = [(area(r), k) for q, k, r in regions if p == q and min(w[2], r[2]) > max(w[0], r[0]) and min(w[3], r[3]) > max(w[1], r[1]) and (min(w[2], r[2]) - max(w[0], r[0])) * (min(w[3], r[3]) - max(w[1], r[1])) / max(1.0, area(w)) > 0.1]
        if found:
            want.add((p, i, min(found)[1]))
    assert {tuple(r) for r in got} == want and len(want) > 150


def test_grids_against_loops(spark):
    rng = random.Random(10)
    tables_, want = [], {}
    for t in range(60):
        edges = lambda n, size: sorted(rng.uniform(0, size) for _ in range(2 * n))
        ys, xs = edges(rng.randint(1, 6), 100), edges(rng.randint(1, 5), 200)
        rows = [[0.0, ys[2 * i] - rng.choice([0, 5]), 200.0, ys[2 * i + 1] + rng.choice([0, 5, 30])] for i in range(len(ys) // 2)]
        columns = [[xs[2 * i] - rng.choice([0, 9]), 0.0, xs[2 * i + 1], 100.0] for i in range(len(xs) // 2)]
        some = lambda n: [[x := rng.uniform(-10, 150), y := rng.uniform(-10, 80), x + rng.uniform(1, 160), y + rng.uniform(1, 80)] for _ in range(n)]
        tables_.append((rows, columns, some(rng.randint(0, 2)), some(rng.randint(0, 5))))
        rows, columns = sorted(rows, key=lambda b: (b[1], b)), sorted(columns)
        cells = {}
        for i, a in enumerate(rows):
            for j, b in enumerate(columns):
                x = [max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])]
                if x[0] < x[2] and x[1] < x[3]:
                    cx, cy = (x[0] + x[2]) / 2, (x[1] + x[3]) / 2
                    cells[i, j] = [x, any(h[0] <= cx <= h[2] and h[1] <= cy <= h[3] for h in tables_[t][2]), None, None, None]
        for s in tables_[t][3]:
            share = lambda x: max(0, min(x[2], s[2]) - max(x[0], s[0])) * max(0, min(x[3], s[3]) - max(x[1], s[1])) / ((x[2] - x[0]) * (x[3] - x[1]))  # noqa: B023,E731
            mine = [k for k, v in cells.items() if share(v[0]) >= 0.5]
            over, along = {i for i, _ in mine}, {j for _, j in mine}
            if len(over) > 1 or len(along) > 1:
                for i, j in cells:
                    if i in over and j in along:
                        cells[i, j][2:] = [len(over), len(along), i == min(over) and j == min(along)]
        want |= {(t, *k): v for k, v in cells.items()}
    of = lambda n, extra=(): spark.createDataFrame([(t, *((i,) if extra else ()), b) for t, x in enumerate(tables_) for i, b in enumerate(x[n])], f"table_id int, {'idx int, ' if extra else ''}bbox_2d array<double>")
    got = tables.grid(of(0), of(1), of(2), of(3, True)).collect()
    assert {(r.table_id, r.row, r.column): [r.bbox_2d, r.is_header, r.row_span, r.col_span, r.span_root] for r in got} == want and any(v[4] for v in want.values())
    none = of(2).limit(0)
    assert all(r.row_span is None and not r.is_header for r in tables.grid(of(0), of(1), none, none).collect())


def test_containment_of_a_page_of_many_boxes_and_nulls(spark):
    rng = random.Random(8)
    box = lambda i: (i, rng.choice(["text", "image", None]), 0.5, 0, [float(x := rng.randint(0, 2000)), float(y := rng.randint(0, 2000)), float(x + rng.randint(5, 150)), float(y + rng.randint(5, 150))])
    many = [box(i) for i in range(1100)]
    df = spark.createDataFrame([(0, many), (1, None), (2, []), (3, [(0, "text", 0.5, 0, None), (1, "text", 0.5, 0, [0.0, 0.0, 9.0, 9.0])])], BOXES)
    got = {r.page_id: r.ids for r in df.select("page_id", F.transform(layout.drop_contained(F.col("boxes")), lambda b: b["i"]).alias("ids")).collect()}

    def inside(a, b):
        w, h = (max(0, min(a[k + 2], b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
        return w * h / ((a[2] - a[0]) * (a[3] - a[1])) >= 0.8

    assert got[0] == [a[0] for a in many if a[1] == "image" or not any(a[0] != b[0] and inside(a[4], b[4]) for b in many)]
    assert got[1] is None and got[2] == [] and got[3] == [0]  # nulls bound nothing


def test_pairs_of_a_crowded_page_take_little_memory():
    """200,000 words a side in 900 places: some arrays, no objects by word."""
    k = np.arange(200_000)
    at = np.stack([k * 37 % 900, k * 53 % 900], 1).astype(float)
    tracemalloc.start()
    i, j = matching._pairs((k, at), (k[k % 5 > 0], at[k % 5 > 0] + 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(i) == len(set(i.tolist())) == len(set(j.tolist())) == 160_000
    assert peak < 60 * 2**20


def test_words_that_share_a_number_count_as_before(spark):
    """One idx under two texts may match under each; its rows are left over only if none does."""
    box = [0.0, 0.0, 9.0, 0.0, 9.0, 5.0, 0.0, 5.0]
    schema = "page_id long, idx int, content string, polygon array<double>"
    ours = spark.createDataFrame([(1, 1, "a", box), (1, 1, "b", box), (1, 2, "c", box), (1, 2, "c", box), (1, 3, "", [])], schema)
    theirs = spark.createDataFrame([(1, 7, "a", box), (1, 8, "b", box), (2, 9, "z", box)], schema)
    got = sorted((r.page_id, r.status, r.ours_idx or 0, r.theirs_idx or 0) for r in matching.word_diff(ours, theirs).collect())
    assert got == sorted([(1, "matched", 1, 7), (1, "matched", 1, 8), (1, "only_ours", 2, 0), (1, "only_ours", 2, 0), (1, "only_ours", 3, 0), (2, "only_theirs", 0, 9)])
