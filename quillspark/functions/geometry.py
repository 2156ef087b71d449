"""Boxes, polygons and confidences as native columns. Boxes are arrays x1, y1, x2, y2; polygons are flat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _box(b: Column) -> tuple[Column, Column, Column, Column]:
    return b[0], b[1], b[2], b[3]


def _overlap(a: Column, b: Column, more: int = 0) -> tuple[Column, Column]:
    """Width and height of what two boxes share, ``more`` added, not below 0."""
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + more), F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + more)


def area(b: Column, more: int = 0) -> Column:
    return (b[2] - b[0] + more) * (b[3] - b[1] + more)


def iou_pixels(a: Column, b: Column) -> Column:
    """Intersection over union where a box includes its last pixel."""
    w, h = _overlap(a, b, 1)
    return w * h / (area(a, 1) + area(b, 1) - w * h)


def iou(a: Column, b: Column) -> Column:
    w, h = _overlap(a, b)
    union = area(a) + area(b) - w * h
    return F.when((w > 0) & (h > 0) & (union > 0), w * h / union).otherwise(0.0)


def contained(a: Column, b: Column, share: float = 0.8) -> Column:
    """Whether ``share`` of a lies in b."""
    w, h = _overlap(a, b)
    return F.when(area(a) > 0, w * h / area(a)).otherwise(0.0) >= share


def overlap_ratio(a: Column, b: Column) -> Column:
    w, h = _overlap(a, b)
    return F.when(area(a) > 0, w * h / area(a)).otherwise(0.0)


def intersection(a: Column, b: Column) -> Column:
    """The shared box, null if there is none."""
    w, h = _overlap(a, b)
    return F.when((w > 0) & (h > 0), F.array(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])))


def center_in(x: Column, y: Column, b: Column) -> Column:
    return x.between(b[0], b[2]) & y.between(b[1], b[3])


def polygon_of(b: Column) -> Column:
    x1, y1, x2, y2 = _box(b)
    return F.array(x1, y1, x2, y1, x2, y2, x1, y2)


def bounds(p: Column) -> Column:
    """The box around a flat polygon; null for fewer than four points."""
    xs, ys = F.filter(p, lambda v, i: i % 2 == 0), F.filter(p, lambda v, i: i % 2 == 1)
    return F.when(F.size(p) >= 8, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def distance(a: Column, b: Column) -> Column:
    """Between the centres of two boxes."""
    return F.sqrt(F.pow((a[0] + a[2] - b[0] - b[2]) / 2, 2) + F.pow((a[1] + a[3] - b[1] - b[3]) / 2, 2))


def quad(p: Column) -> Column:
    """struct(tl, tr, br, bl) of the first four points by sums and differences; null if there are fewer."""
    points = [(F.get(p, F.lit(2 * i)), F.get(p, F.lit(2 * i + 1))) for i in range(4)]

    def pick(by, largest: bool) -> Column:
        keyed = [F.struct((-by(x, y) if largest else by(x, y)).alias("k"), F.lit(i).alias("i"), F.struct(x.alias("x"), y.alias("y")).alias("at")) for i, (x, y) in enumerate(points)]
        return F.least(*keyed)["at"]

    total, lean = lambda x, y: x + y, lambda x, y: x - y
    corners = F.struct(pick(total, False).alias("tl"), pick(lean, True).alias("tr"), pick(total, True).alias("br"), pick(lean, False).alias("bl"))
    return F.when(F.size(p) >= 8, corners)


def in_quad(q: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """The point at (u, v) of a quad: u from left to right, v from top to bottom."""
    at = lambda c: (1 - u) * (1 - v) * q["tl"][c] + u * (1 - v) * q["tr"][c] + (1 - u) * v * q["bl"][c] + u * v * q["br"][c]
    return at("x"), at("y")


def cell_in_quad(q: Column, u0: Column, u1: Column, v0: Column, v1: Column) -> Column:
    """The polygon of a cell of a quad."""
    return F.array(*in_quad(q, u0, v0), *in_quad(q, u1, v0), *in_quad(q, u1, v1), *in_quad(q, u0, v1))


def line_strip(b: Column, line: Column, of: Column) -> Column:
    """The box of one line of ``of`` equally high ones."""
    high = F.greatest(b[3] - b[1], F.lit(0.0))
    return F.when(of <= 1, b).otherwise(F.array(b[0], b[1] + high * line / of, b[2], b[1] + high * (line + 1) / of))


def unclip(b: Column, width: Column | float, height: Column | float) -> Column:
    """The box scaled about its centre."""
    w, h = b[2] - b[0], b[3] - b[1]
    cx, cy = b[0] + w / 2, b[1] + h / 2
    return F.array(cx - w * width / 2, cy - h * height / 2, cx + w * width / 2, cy + h * height / 2)


def per_mille(x: Column, side: Column) -> Column:
    """A pixel coordinate on the scale of 0 to 1000, truncated."""
    return (x / side * 1000).cast("int")


def scale_polygon(p: Column, width: Column, height: Column) -> Column:
    return F.transform(p, lambda v, i: F.when(i % 2 == 0, v / width * 1000).otherwise(v / height * 1000))


def to_page(p: Column, box: Column) -> Column:
    """A polygon on a crop's scale of 0 to 1000, on the page's."""
    return F.transform(p, lambda v, i: F.when(i % 2 == 0, box[0] + v / 1000 * (box[2] - box[0])).otherwise(box[1] + v / 1000 * (box[3] - box[1])))


def flat(points: Column) -> Column:
    return F.flatten(points)


def polygon(raw: Column) -> Column:
    """A flat polygon of JSON that holds one, or a list of points of two numbers each; null for anything else, and for fewer than four points."""
    own = F.when(raw.rlike(r"^\s*\["), raw)
    kinds = F.get_json_object(own, "$")  # as a number or list; strings within keep their quotes
    numbers = F.when(~kinds.contains('"'), F.from_json(own, "array<double>"))
    points = F.when(~kinds.contains('"'), F.from_json(own, "array<array<double>>"))
    whole = lambda c: F.forall(c, lambda v: v.isNotNull())
    listed = F.when(whole(numbers) & (F.size(numbers) >= 8) & (F.size(numbers) % 2 == 0), numbers)
    paired = F.when(whole(points) & F.forall(points, lambda q: (F.size(q) == 2) & F.forall(q, lambda v: v.isNotNull())) & (F.size(points) >= 4), F.flatten(points))
    return F.coalesce(listed, paired)


def confidence(raw: Column, kind: Column | None = None) -> Column:
    """A number of 0 to 1 from a string, else null; null too where ``kind`` says bool."""
    x = raw.cast("string").try_cast("double")
    ok = x.between(0, 1) & ~F.isnan(x)
    return F.when(ok if kind is None else ok & (kind != "bool"), x)


def percent_box(b: Column) -> Column:
    """left, top, width, height in per cent, of a box on a scale of 0 to 1 (all values up to 1.5) or of 0 to 1000."""
    scale = F.when(F.array_max(F.transform(b, F.abs)) <= 1.5, 100.0).otherwise(0.1)
    return F.array(b[0] * scale, b[1] * scale, (b[2] - b[0]) * scale, (b[3] - b[1]) * scale)


def dims_within(width: Column, height: Column, most: int) -> Column:
    """struct(width, height) scaled down to a longest side of ``most``, truncated, at least 1."""
    ratio = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    cut = lambda x: F.greatest(F.lit(1), (x * ratio).cast("int"))
    return F.when(F.greatest(width, height) <= most, F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))).otherwise(F.struct(cut(width).alias("width"), cut(height).alias("height")))


def sample_indices(total: Column, k: Column | int) -> Column:
    """k evenly spread indices of ``total``, ends included."""
    k = F.lit(k) if isinstance(k, int) else k
    every = F.sequence(F.lit(0), F.greatest(total, F.lit(1)) - 1)
    spread = F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(2)) - 1), lambda i: F.floor((total - 1) * i / (F.greatest(k, F.lit(2)) - 1)).cast("int"))
    return F.when(total <= 0, F.array().cast("array<int>")).when(total <= k, every).when(k == 1, F.array(F.lit(0))).otherwise(spread)
