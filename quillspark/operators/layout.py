"""Post-processing of detected boxes: thresholds, suppression, containment, reading order, labels.

Each operator takes an array column of one page's boxes, so a page never meets another one's shuffle;
the folds keep Catalyst's code generation. Only containment, which compares all pairs, goes through Arrow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import geometry as G
from quillspark.functions import text as T

# Label classes of layout models.
IMAGE_LABELS = ("figure", "figure_caption", "image", "picture", "illustration", "chart", "seal", "signature", "stamp", "barcode", "qr_code")
TABLE_LABELS = ("table", "table_title", "table_caption", "table_footnote")
FORMULA_LABELS = ("formula", "formula_caption", "formula_number", "equation_footnote", "isolate_formula")
PRESERVED = ("image", "seal", "chart")
BAND = 30.0
SAME_IOU, OTHER_IOU = 0.6, 0.98
MIN_CROP = 5


def classify_label(label: Column) -> Column:
    """text, table, formula or skip."""
    low = F.lower(T.strip(T.text(label)))
    return F.when(low == "", "text").when(low.isin(*IMAGE_LABELS), "skip").when(low.contains("table"), "table").when(low.contains("formula") | low.contains("equation"), "formula").otherwise("text")


def label_tasks(labels: DataFrame) -> DataFrame:
    """task, labels: the labels of a model (id, label) by task, in order of id."""
    own = labels.withColumn("task", classify_label(F.col("label")))
    return own.groupBy("task").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "label"))), lambda x: x["label"]).alias("labels"))


def region_kind(label: Column, aliases: Column) -> Column:
    """A normalised kind: the alias of the label in snake case, the label itself if it is a kind, else other."""
    slug = F.trim(F.regexp_replace(F.lower(T.text(label)), "[^a-z0-9]+", "_"))
    slug = F.regexp_replace(slug, "^_+|_+$", "")
    return F.coalesce(F.try_element_at(aliases, slug), F.lit("other"))


def above_threshold(boxes: Column, thresholds: Column, default: float = 0.2) -> Column:
    """Boxes whose score reaches the threshold of their label, or the default."""
    return F.filter(boxes, lambda b: b["score"] >= F.coalesce(F.try_element_at(thresholds, b["label"]), F.lit(default)))


def nms(boxes: Column, same: float = SAME_IOU, other: float = OTHER_IOU) -> Column:
    """Greedy suppression by score: a box goes if it overlaps a kept one by ``same`` of its label, or ``other`` of another.

    ``boxes``: structs with label, score, bbox_2d. Of equal scores the later box goes first.
    """
    ranked = F.transform(F.array_sort(F.transform(boxes, lambda b, i: F.struct((-b["score"]).alias("k"), (-i).alias("i"), b.alias("b")))), lambda x: x["b"])

    def add(kept: Column, b: Column) -> Column:
        rival = lambda k: G.iou_pixels(k["bbox_2d"], b["bbox_2d"]) >= F.when(k["label"] == b["label"], same).otherwise(other)
        return F.when(F.exists(kept, rival), kept).otherwise(F.array_append(kept, b))

    return F.aggregate(ranked, F.filter(boxes, lambda b: F.lit(False)), add)


def drop_oversized(boxes: Column, width: Column, height: Column) -> Column:
    """Of several boxes, images that fill most of the page go (0.82 of a landscape page, else 0.93), unless nothing were left."""
    limit = F.when(width > height, 0.82).otherwise(0.93) * width * height
    clipped = lambda b: (F.least(b["bbox_2d"][2], width) - F.greatest(b["bbox_2d"][0], F.lit(0.0))) * (F.least(b["bbox_2d"][3], height) - F.greatest(b["bbox_2d"][1], F.lit(0.0)))
    left = F.filter(boxes, lambda b: (b["label"] != "image") | (clipped(b) <= limit))
    return F.when((F.size(boxes) > 1) & (F.size(left) > 0), left).otherwise(boxes)


def drop_contained(boxes: Column, mode: str = "large", labels: tuple[str, ...] | None = None) -> Column:
    """Drops boxes by containment (0.8 of one in another): ``large`` keeps outer boxes, ``small`` inner ones, ``union`` all.

    With ``labels`` only containment in (large) or of (small) those labels counts. Preserved labels never go.
    """
    if mode == "union":
        return boxes
    stays = _stays(mode, labels)(boxes["bbox_2d"].cast("array<array<double>>"), boxes["label"])
    return F.filter(F.zip_with(boxes, stays, lambda b, s: F.struct(b.alias("b"), s.alias("s"))), lambda x: x["s"])["b"]


def _stays(mode: str, labels: tuple[str, ...] | None, together: int = 1 << 20):
    """Which boxes of a page ``drop_contained`` keeps, for all pairs of boxes of the pages of a batch, so many pairs at a time."""

    @F.arrow_udf("array<boolean>")
    def run(boxes: pa.Array, names: pa.Array) -> pa.Array:
        size = np.asarray(pc.fill_null(pc.list_value_length(boxes), 0), np.int64)
        flat, own = pc.list_flatten(boxes), pc.list_flatten(names)
        left, top, right, bottom = (pc.list_element(flat, k).to_numpy(zero_copy_only=False).astype(float) if len(flat) else np.zeros(0) for k in range(4))
        area = (right - left) * (bottom - top)
        unknown = own.is_null().to_numpy(zero_copy_only=False)
        guarded = np.asarray(pc.is_in(own, pa.array(PRESERVED, own.type)))
        mine = np.asarray(pc.is_in(own, pa.array(labels, own.type))) | unknown if labels else np.ones(len(own), bool)
        each, first = np.repeat(size, size), np.repeat(np.cumsum(size) - size, size)
        inner, certain, outer = np.zeros((3, len(own)), bool)  # certain: whatever a label that is null may be
        ends = np.cumsum(each)
        lo = 0
        while lo < len(own):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - each[lo] + together, "right")))
            n = each[lo:hi]
            a = np.repeat(np.arange(lo, hi), n)
            b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[lo:hi], n)
            shared = np.fmax(0, np.fmin(right[a], right[b]) - np.fmax(left[a], left[b])) * np.fmax(0, np.fmin(bottom[a], bottom[b]) - np.fmax(top[a], top[b]))
            ok = area[a] > 0
            inside = (a != b) & ok & ~guarded[a] & (shared / np.where(ok, area[a], 1.0) >= 0.8)
            a, b = a[inside], b[inside]
            if mode == "large":
                inner[a[mine[b]]] = True
            else:
                certain[a[mine[a] & ~unknown[a]]] = True
                outer[b[mine[a]]] = True
            lo = hi
        keep = ~inner if mode == "large" else ~outer | certain
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(keep), mask=boxes.is_null())

    return run


def clip(boxes: Column, width: Column, height: Column) -> Column:
    """Boxes cut to the page; those without area go."""
    cut = lambda b: F.array(F.greatest(F.lit(0.0), b[0]), F.greatest(F.lit(0.0), b[1]), F.least(width, b[2]), F.least(height, b[3]))
    inside = F.transform(boxes, lambda b: b.withField("bbox_2d", cut(b["bbox_2d"])))
    return F.filter(inside, lambda b: (b["bbox_2d"][0] < b["bbox_2d"][2]) & (b["bbox_2d"][1] < b["bbox_2d"][3]))


def with_task(boxes: Column, tasks: Column) -> Column:
    """Adds task_type by a map from labels, skip where there is none; tasks ``abandon`` go."""
    own = F.transform(boxes, lambda b: b.withField("task_type", F.coalesce(F.try_element_at(tasks, b["label"]), F.lit("skip"))))
    return F.filter(own, lambda b: b["task_type"] != "abandon")


def detected(boxes: Column, width: Column, height: Column, tasks: Column, thresholds: Column | None = None, default: float = 0.2, ratio: tuple[float, float] = (1.0, 1.0), mode: str = "large") -> Column:
    """A model's boxes of one page as regions: label, score, bbox_2d and polygon on a scale of 0 to 1000, task_type.

    ``boxes``: structs of label, score, bbox_2d in pixels, order_seq and polygon (flat, null for the box itself);
    ``tasks``: a map from labels. In this order: thresholds by label, suppression, oversized images, containment,
    the model's order, scaling by ``ratio``, cutting to the page, polygons of the boxes they came from, tasks.
    """
    found = above_threshold(boxes, thresholds if thresholds is not None else F.create_map().cast("map<string,double>"), default)
    kept = by_model_order(drop_contained(drop_oversized(nms(found), width, height), mode))
    scaled = F.transform(kept, lambda b: b.withField("bbox_2d", G.unclip(b["bbox_2d"], *ratio)))
    whole, polygons = F.transform(found, lambda b: b["bbox_2d"]), F.transform(found, lambda b: F.coalesce(b["polygon"], G.polygon_of(b["bbox_2d"])))
    # A polygon is looked up by the scaled box, before it is cut; one that isn't found is the cut box's own.
    placed = F.transform(scaled, lambda b: b.withField("polygon", own_polygon(b["bbox_2d"], whole, polygons)))
    cut = clip(placed, width, height)
    inside = lambda v, i: F.least(F.greatest(v, F.lit(0.0)), F.when(i % 2 == 0, width).otherwise(height))
    side = lambda i: F.when(i % 2 == 0, width).otherwise(height)

    def region(b: Column) -> Column:
        polygon = F.coalesce(F.transform(b["polygon"], inside), G.polygon_of(b["bbox_2d"]))
        scale = lambda v, i: G.per_mille(v, side(i))
        box = F.transform(F.transform(b["bbox_2d"], lambda v: v.cast("int")), scale)
        return F.struct(b["label"].alias("label"), b["score"].cast("double").alias("score"), box.alias("bbox_2d"), F.transform(polygon, scale).alias("polygon"))

    return with_task(F.transform(cut, region), tasks)


def large_enough(b: Column, least: int = MIN_CROP) -> Column:
    return (b[2] - b[0] >= least) & (b[3] - b[1] >= least)


def reading_order(boxes: Column, tolerance: float = BAND) -> Column:
    """From top to bottom in bands, from left to right within one.

    A box joins the band while its centre is within ``tolerance`` of the running mean of the band's centres.
    """
    center = lambda b: (b["bbox_2d"][1] + b["bbox_2d"][3]) / 2
    by_top = F.array_sort(F.transform(boxes, lambda b, i: F.struct(b["bbox_2d"][1].alias("y"), i.alias("i"), b.alias("b"))))
    start = F.struct(F.lit(0).alias("band"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.transform(F.slice(by_top, 1, 0), lambda x: F.struct(F.lit(0).alias("band"), x["y"].alias("x"), F.lit(0).alias("at"), x["b"].alias("b"))).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        c = center(x["b"])
        same = (acc["n"] == 0) | (F.abs(c - acc["sum"] / F.greatest(acc["n"], F.lit(1))) <= tolerance)
        band = F.when(same, acc["band"]).otherwise(acc["band"] + 1)
        item = F.struct(band.alias("band"), x["b"]["bbox_2d"][0].alias("x"), F.size(acc["out"]).alias("at"), x["b"].alias("b"))
        return F.struct(band.alias("band"), F.when(same, acc["sum"] + c).otherwise(c).alias("sum"), F.when(same, acc["n"] + 1).otherwise(F.lit(1)).alias("n"), F.array_append(acc["out"], item).alias("out"))

    return F.aggregate(by_top, start, add, lambda acc: F.transform(F.array_sort(acc["out"]), lambda x: x["b"]))


def by_model_order(boxes: Column) -> Column:
    return F.transform(F.array_sort(F.transform(boxes, lambda b, i: F.struct(b["order_seq"].alias("k"), i.alias("i"), b.alias("b")))), lambda x: x["b"])


def region_count(pages: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, regions, pages, warning: the regions of all pages of a document (``pages``: by, regions), and the note that says so."""
    out = pages.groupBy(by).agg(F.sum(F.coalesce(F.size("regions"), F.lit(0))).cast("long").alias("regions"), F.count(F.lit(1)).alias("pages"))
    note = F.format_string("Document layout: %d regions detected on %d page(s).", "regions", "pages")  # fixed value
    return out.withColumn("warning", note)


def original_polygon(box: Column, boxes: Column, polygons: Column, near: float = 1.0, relative: float = 1e-5) -> Column:
    """The polygon at the place of the first of ``boxes`` within ``near`` (and a relative 1e-5) of ``box`` in all four values; the box's own where there is none."""
    return F.coalesce(own_polygon(box, boxes, polygons, near, relative), G.polygon_of(box))


def own_polygon(box: Column, boxes: Column, polygons: Column, near: float = 1.0, relative: float = 1e-5) -> Column:
    """As ``original_polygon``, null where there is none."""
    close = lambda b: F.forall(F.sequence(F.lit(0), F.lit(3)), lambda i: F.abs(F.get(b, i) - F.get(box, i)) <= near + relative * F.abs(F.get(box, i)))
    at = F.array_position(F.transform(boxes, close), F.lit(True))
    return F.when(at > 0, F.get(polygons, (at - 1).cast("int")))
