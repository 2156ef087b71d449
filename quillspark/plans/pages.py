"""From page images to documents: every page and every region of it asked of a model, and put together again.

pages: doc_id, page_number, width, height, pixels (grey bytes, by rows), and regions (structs of label, score,
bbox_2d on a scale of 0 to 1000, polygon, task_type) as ``layout.detected`` makes them, or as ``detect`` adds
them. The flow fans out twice, pages to regions to calls, and back in: calls are rows with a key, spread by
cost over all tasks wherever their page came from, and answered through a ledger and, where given, a cache
(see ``calls``). Crops are written once; they, and not the pages, go to the tasks that call.

Defined cases: a page without pixels or a crop of fewer than 5 pixels is not asked about and reads as
nothing; regions of task ``skip`` have no content; a call that fails leaves its place empty and a warning; a
document has its pages in order of page_number, whatever order they arrive in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import calls, images, inference, layout, matching, projection
from quillspark.session import written

# The texts of warnings.
PAGE_FAILED, REGION_FAILED, REGION_TURNED, ON_PAGE = "Seiten-OCR fehlgeschlagen: %s", "Region %d (%s) OCR fehlgeschlagen: %s", "Region %d (%s): %d° CCW Rotation erkannt", "Seite %d: %s"
#: How sure a region's orientation must be for its crop to be turned.
SURE = 0.70
REGION = "struct<label: string, score: double, bbox_2d: array<int>, polygon: array<int>, task_type: string>"
_PIECES = "doc_id {0}, page_number int, region int, width int, height int, turned int, content binary"


def straightened(pages: DataFrame) -> DataFrame:
    """``pages`` turned level and upright: pixels, width and height anew, and angle."""
    rest = [c for c in pages.columns if c not in ("width", "height", "pixels", "angle")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            new = []
            for w, h, p in zip(b["width"], b["height"], b["pixels"]):
                gray, angle = images.deskew(images._pixels(w, h, p)) if p is not None and len(p) else (np.zeros((0, 0), np.uint8), 0.0)
                new.append((gray.shape[1], gray.shape[0], gray.tobytes() or None, float(angle)))
            yield b[rest].assign(**{c: [x[i] for x in new] for i, c in enumerate(("width", "height", "pixels", "angle"))})

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest)
    return pages.mapInPandas(run, f"{kinds}, width int, height int, pixels binary, angle double")


def crop(gray: np.ndarray, box: list[int], least: int = layout.MIN_CROP) -> np.ndarray | None:
    """The pixels in a box on a scale of 0 to 1000; none if fewer than ``least`` either way."""
    h, w = gray.shape
    x1, y1, x2, y2 = (int(v / 1000 * side) for v, side in zip(box, (w, h, w, h)))
    part = gray[max(0, y1) : min(h, y2), max(0, x1) : min(w, x2)]
    return part if min(part.shape) >= least else None


def pieces(pages: DataFrame, per_region: bool, turn: bool) -> DataFrame:
    """A row per page (region -1) and region to be read, with its PNG; regions are numbered in reading order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, number, w, h, p, boxes in zip(*(b[c] for c in ("doc_id", "page_number", "width", "height", "pixels", "boxes"))):
                seen = p is not None and len(p) > 0
                gray = images._pixels(w, h, p) if seen else None
                rows = [(doc, number, -1, w, h, 0, images.png(gray) if seen else None)]
                for i, r in enumerate(boxes if per_region and seen and boxes is not None else []):
                    part = None if r["task_type"] == "skip" else crop(gray, r["bbox_2d"])
                    if part is None:
                        continue
                    angle, sure = images.cardinal_rotation(part) if turn else (0, 0.0)
                    angle = angle if sure >= SURE else 0
                    rows.append((doc, number, i, w, h, angle, images.png(np.rot90(part, angle // 90))))
                yield pd.DataFrame(rows, columns=["doc_id", "page_number", "region", "width", "height", "turned", "content"])

    return pages.select("doc_id", "page_number", "width", "height", "pixels", "boxes").mapInPandas(run, _PIECES.format(pages.schema["doc_id"].dataType.simpleString()))


def _anchored(page: DataFrame, threshold: float) -> DataFrame:
    """``page`` with each of found as the lines of text that it matches, if any. A step of its own: the lambdas after it can't hold a Python function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [[matching.align(c, s, threshold) if c and s else c for c in found] for found, s in zip(b["found"], b["text"])]
            yield b[["doc_id", "page_number"]].assign(found=own)

    kinds = f"doc_id {page.schema['doc_id'].dataType.simpleString()}, page_number int, found array<string>"
    return page.drop("found").join(page.select("doc_id", "page_number", "found", "text").mapInPandas(run, kinds), ["doc_id", "page_number"])


def process(
    pages: DataFrame,
    factory: Callable[[], inference.Client],
    prompt: str,
    model: str,
    run: str,
    *,
    detect: Callable[[DataFrame], DataFrame] | None = None,
    cache: calls.Cache | None = None,
    tasks: int | None = None,
    max_tokens: int = 4096,
    straighten: bool = False,
    turn_regions: bool = False,
    per_region: bool = True,
    anchor: bool = True,
    threshold: float = matching.ANCHOR,
    from_regions: bool = False,
) -> DataFrame:
    """doc_id, text, layout, page_infos, page_texts, warnings: a row per document.

    ``run`` names the run: one of the same name that was cut short goes on with the answers it had. ``anchor``
    replaces what a region's crop reads as by the lines of the page's own text that it matches; ``from_regions``
    makes a page's text of its regions' contents.
    """
    spark = pages.sparkSession
    pages = straightened(pages) if straighten else pages.withColumn("angle", F.lit(0.0))
    pages = detect(pages) if detect else pages
    pages = pages.withColumn("boxes", layout.reading_order(F.coalesce("regions", F.array().cast(f"array<{REGION}>"))))
    asked = pieces(pages, per_region, turn_regions)
    asked = asked.withColumns({"prompt": F.lit(prompt), "model": F.lit(model), "max_tokens": F.lit(max_tokens)})
    asked = written(asked.withColumn("key", F.when(F.col("content").isNotNull(), calls.key(F.col("content"), F.col("prompt"), F.col("model"), F.col("max_tokens")))), "pieces")
    todo, ledger = asked.filter("key is not null"), calls.new_ledger(spark, run)
    if cache is not None:
        answers = cache.complete(todo, factory, ledger, tasks)
    else:
        answers = todo.drop("content").join(written(calls.answered(todo.dropDuplicates(["key"]), factory, ledger, tasks), "answers"), "key", "left")
    answers = answers.select("doc_id", "page_number", "region", F.struct("region", "turned", "error", T.unwrap_fence(T.text("output")).alias("text")).alias("answer"))
    # Back in: a page's row, which holds its regions, meets all its answers; then a document's pages meet.
    page = pages.select("doc_id", "page_number", "angle", "width", "height", "boxes")
    got = answers.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list("answer")).alias("answers"))
    page = page.join(got, ["doc_id", "page_number"], "left").withColumn("answers", F.coalesce("answers", F.array().cast(got.schema["answers"].dataType)))
    whole = F.get(F.filter("answers", lambda a: a["region"] == -1), F.lit(0))
    page = page.withColumns({"text": F.coalesce(whole["text"], F.lit("")), "failed": whole["error"]})
    of = lambda i: F.get(F.filter("answers", lambda a: a["region"] == i), F.lit(0))
    page = page.withColumn("found", F.transform("boxes", lambda b, i: F.coalesce(of(i)["text"], F.lit(""))))
    if anchor:
        page = _anchored(written(page, "read-pages"), threshold)
    region = lambda b, i: F.struct(i.alias("index"), b["label"].alias("label"), b["bbox_2d"].alias("bbox_2d"), b["polygon"].alias("polygon"), b["score"].alias("confidence"), F.coalesce(of(i)["turned"], F.lit(0)).alias("region_angle"))
    page = page.withColumn("regions", F.zip_with(F.transform("boxes", region), "found", lambda r, c: r.withField("content", c)))
    if from_regions:
        filled = F.filter("found", lambda c: c != "")
        page = page.withColumn("text", F.when(F.size(filled) > 0, F.array_join(filled, "\n\n")).otherwise(F.col("text")))
    notes = lambda b, i: F.array_compact(F.array(F.when(of(i)["turned"] != 0, F.format_string(REGION_TURNED, i, b["label"], of(i)["turned"])), F.when(of(i)["error"].isNotNull(), F.format_string(REGION_FAILED, i, b["label"], of(i)["error"]))))
    first = F.array_compact(F.array(F.when(F.col("angle") != 0, F.format_string(images.TURNED.format(0).replace("0.0", "%.1f"), "angle")), F.when(F.col("failed").isNotNull(), F.format_string(PAGE_FAILED, "failed"))))
    page = page.withColumn("notes", F.concat(first, F.flatten(F.transform("boxes", notes))))
    return documents(page)


def documents(page: DataFrame) -> DataFrame:
    """Pages (doc_id, page_number, angle, width, height, text, regions, notes) as documents."""
    info = F.struct("page_number", F.round("angle", 1).alias("angle"), "width", "height", F.lit("pixel").alias("unit"), F.lit("document").alias("kind"))
    own = F.struct("page_number", info.alias("info"), "text", "regions", "notes")
    ordered = lambda a, b: F.when(a["page_number"] < b["page_number"], -1).when(a["page_number"] > b["page_number"], 1).otherwise(0)
    doc = page.groupBy("doc_id").agg(F.array_sort(F.collect_list(own), ordered).alias("p"))
    of = lambda f: F.transform("p", f)
    note = lambda p: F.transform(p["notes"], lambda n: F.when(F.size("p") > 1, F.format_string(ON_PAGE, p["page_number"], n)).otherwise(n))
    doc = doc.withColumns({
        "layout": of(lambda p: F.struct(p["page_number"].alias("page_number"), p["regions"].alias("regions"))),
        "page_infos": of(lambda p: p["info"]), "page_texts": of(lambda p: p["text"]), "noted": F.flatten(of(note)),
    })
    texts = projection.document_text(page)
    counted = layout.region_count(page.select("doc_id", "regions"))
    out = doc.join(texts, "doc_id").join(counted.select("doc_id", "warning"), "doc_id")
    return out.select("doc_id", "text", "layout", "page_infos", "page_texts", F.concat("noted", F.array("warning")).alias("warnings"))
