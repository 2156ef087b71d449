"""Image operators on raw grey pixels: angles, upright pages, sizes, storyboards.

Decoding needs an imaging library, which is optional: see ``decoder``. Angles are counter-clockwise degrees
by which a page must be turned. Defined cases: a page without ink, or empty, lies straight and is left alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MIN_SIDE, MAX_SIDE, PROBE_SIDE = 1800, 3600, 600
#: Least angle that is corrected; distance from a right angle that counts as one; how sure a turn by 180 must be after small and large corrections.
LEAST_ANGLE, SNAP, SURE_SMALL, SURE_LARGE = 0.5, 3.0, 0.15, 0.70
#: Most pictures of a storyboard.
STORYBOARD = 4
# Modes that count as grey, and the warnings' texts.
GREY_MODES = ("1", "L", "LA")
TURNED = "Deskew: {:.1f}° CCW Korrektur angewendet"
ENLARGED = "Binärbild ({}) von {}x{} auf {}x{} hochskaliert (LANCZOS) für robustere OCR"
REDUCED = "Eingabe wurde von {}x{} auf {}x{} skaliert"


def decoder():
    """The optional imaging library; a clear error where it isn't installed."""
    try:
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("decoding images, PDF pages and GIF frames needs Pillow, which isn't installed") from e
    return Image


def flatten_alpha(rgba: np.ndarray) -> np.ndarray:
    """RGBA over white."""
    a = rgba[..., 3:].astype(float) / 255
    return np.round(rgba[..., :3] * a + 255 * (1 - a)).astype(np.uint8)


def dark(gray: np.ndarray) -> np.ndarray:
    """1.0 where a pixel is ink: at most the level that parts dark from light with the largest variance between them."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(invalid="ignore", divide="ignore"):
        between = np.nan_to_num((mass[-1] * below - mass * below[-1]) ** 2 / (below * above), posinf=0.0)
    return (gray <= between.argmax()).astype(float) if between.any() else np.zeros(gray.shape)


def shear(ink: np.ndarray, degrees: float) -> np.ndarray:
    """Row sums of an image turned by a small or large angle, by binning each ink pixel's rotated height."""
    y, x = np.nonzero(ink)
    t = np.deg2rad(degrees)
    rows = np.round(y * np.cos(t) - x * np.sin(t)).astype(int)
    return np.bincount(rows - rows.min(), ink[y, x]) if len(rows) else np.zeros(1)


def sharpness(ink: np.ndarray, degrees: float) -> float:
    """How uneven the row sums are: largest where lines lie level. Empty rows beside the page don't count."""
    rows = shear(ink, degrees)
    return float(np.square(rows).sum() - rows.sum() ** 2 / max(ink.shape))


def page_angle(gray: np.ndarray, span: float = 90.0) -> float:
    """The angle that levels the text, up to ``span`` either way: coarse steps of 5, then of 1."""
    step = max(1, -(-max(gray.shape) // PROBE_SIDE))
    ink = dark(gray[::step, ::step])
    if not ink.any():
        return 0.0
    better = lambda d: (sharpness(ink, d), -abs(d))
    best = max(np.arange(-span, span + 1, 5.0), key=better)
    return float(max((d for d in np.arange(best - 4, best + 5, 1.0) if abs(d) <= span), key=better))


def top_heavy(ink: np.ndarray) -> float:
    """Above 0 where bands of text begin more sharply than they end, as upright Latin lines do."""
    rows = ink.sum(1)
    inside = np.concatenate([[False], rows > 0.05 * rows.max(initial=0.0), [False]]).astype(int)
    first, last = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1) - 1
    return float(np.mean(rows[first] ** 2) - np.mean(rows[last] ** 2)) if len(first) else 0.0


def cardinal_rotation(gray: np.ndarray) -> tuple[int, float]:
    """(0, 90 or 180, how sure from 0 to 1): whether lines run along rows, and which way up.

    Lines along columns have the same row sums after either quarter turn, so 270 is never chosen.
    """
    ink = dark(gray)
    level, upright = float(np.var(ink.sum(1))), float(np.var(ink.sum(0)))
    if upright > level:
        return 90, float(np.clip(2 * (upright - level) / (upright + level), 0, 1))
    now, turned = top_heavy(ink), top_heavy(ink[::-1])
    return 0 if now >= turned else 180, float(np.clip(abs(now - turned) / (abs(now) + abs(turned) + 1e-9), 0, 1))


def turn(gray: np.ndarray, degrees: float) -> np.ndarray:
    """The page turned about its middle on a white ground large enough for its corners; cubic interpolation."""
    h, w = gray.shape
    c, s = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    high, wide = (max(1, int(np.ceil(round(n, 6)))) for n in (abs(w * s) + abs(h * c), abs(w * c) + abs(h * s)))
    y, x = np.mgrid[:high, :wide].astype(np.float32)
    y, x = y - (high - 1) / 2, x - (wide - 1) / 2
    from_x, from_y = x * c - y * s + (w - 1) / 2, x * s + y * c + (h - 1) / 2
    left, top = np.floor(from_x).astype(int), np.floor(from_y).astype(int)
    white = np.pad(gray, 3, constant_values=255).astype(np.float32)
    out = np.zeros((high, wide), np.float32)
    for j in range(-1, 3):
        rows, share = np.clip(top + j + 3, 0, h + 5), _cubic(from_y - top - j)
        for i in range(-1, 3):
            out += white[rows, np.clip(left + i + 3, 0, w + 5)] * share * _cubic(from_x - left - i)
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0)).astype(np.float32)


def deskew(gray: np.ndarray, least: float = LEAST_ANGLE, sure: float = SURE_LARGE) -> tuple[np.ndarray, float]:
    """(page with level, upright lines, angle it was turned by): right angles without loss, then the rest, then top or bottom up."""
    angle = page_angle(gray) if gray.size else 0.0
    total = 0.0
    if abs(angle) >= least:
        quarters = round(angle / 90)
        if quarters and abs(angle - 90 * quarters) <= SNAP:
            gray, total = np.rot90(gray, quarters), 90.0 * quarters
        if abs(angle - total) >= least:
            gray, total = turn(gray, angle - total), angle
    ink = dark(gray) if gray.size else np.zeros((0, 0))
    if not ink.any():
        return gray, total
    if abs(total) < 10:  # text starts near the top of a page, and resampling blurs the edges of bands
        middle = float(np.average(np.arange(len(ink)), weights=ink.sum(1))) / len(ink)
        flip = middle > 0.5 and 2 * (middle - 0.5) >= SURE_SMALL
    else:
        now, turned = top_heavy(ink), top_heavy(ink[::-1])
        flip = turned > now and min(1.0, (turned - now) / (abs(now) + abs(turned) + 1e-9)) >= sure
    return (gray[::-1, ::-1], total + 180) if flip else (gray, total)


def resize(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """Lanczos of three lobes along each axis, widened where the image shrinks."""
    out = gray.astype(np.float32)
    for size in (height, width):  # rows, then columns as rows
        scale = out.shape[0] / size
        wide = max(scale, 1.0)
        middle = (np.arange(size) + 0.5) * scale
        taps = np.floor(middle - 3 * wide).astype(int)[:, None] + np.arange(int(np.ceil(6 * wide)) + 2)
        x = (taps + 0.5 - middle[:, None]) / wide
        share = np.where((np.abs(x) < 3) & (taps >= 0) & (taps < out.shape[0]), np.sinc(x) * np.sinc(x / 3), 0)
        share = (share / share.sum(1, keepdims=True)).astype(np.float32)
        taps = np.clip(taps, 0, out.shape[0] - 1)
        out = sum(out[taps[:, t]] * share[:, t, None] for t in range(taps.shape[1])).T
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def oriented(gray: np.ndarray, orientation: int) -> np.ndarray:
    """The image as its camera's orientation tag (1 to 8) means it; other values leave it."""
    return {2: np.fliplr, 3: lambda g: np.rot90(g, 2), 4: np.flipud, 5: np.transpose, 6: lambda g: np.rot90(g, 3), 7: lambda g: np.rot90(g, 2).T, 8: np.rot90}.get(orientation, np.asarray)(gray)


def prepared(gray: np.ndarray, mode: str = "L", orientation: int = 1, straighten: bool = False, smallest: int = MIN_SIDE, largest: int = MAX_SIDE) -> tuple[np.ndarray, float, list[str]]:
    """(pixels for a model, angle, warnings): oriented, straightened, grey ones enlarged to ``smallest``, all reduced to ``largest``."""
    gray, angle, warnings = oriented(gray, orientation), 0.0, []
    if not gray.size:
        return gray, angle, warnings
    if straighten:
        gray, angle = deskew(gray)
        if angle:
            warnings.append(TURNED.format(angle))

    def scaled(to: int) -> tuple[int, int, int, int]:
        (h, w), side = gray.shape, max(gray.shape)
        return w, h, max(1, int(w * (to / side))), max(1, int(h * (to / side)))

    if mode in GREY_MODES and 0 < max(gray.shape) < smallest:
        sides = scaled(smallest)
        gray = resize(gray, *sides[2:])
        warnings.append(ENLARGED.format(mode, *sides))
    if max(gray.shape) > largest:
        sides = scaled(largest)
        gray = resize(gray, *sides[2:])
        warnings.append(REDUCED.format(*sides))
    return gray, angle, warnings


def storyboard(pictures: list[np.ndarray], most: int = STORYBOARD) -> np.ndarray:
    """Up to ``most`` evenly spread pictures in two columns (one row for two or fewer), each centred in its cell on white."""
    if not pictures:
        raise ValueError("a storyboard needs pictures")
    n = len(pictures)
    some = [pictures[(n - 1) * i // (most - 1)] for i in range(most)] if n > most else pictures
    columns = min(2, len(some))
    high, wide = (max(p.shape[k] for p in some) for k in (0, 1))
    out = np.full((-(-len(some) // columns) * high, columns * wide), 255, np.uint8)
    for i, p in enumerate(some):
        y, x = i // columns * high + (high - p.shape[0]) // 2, i % columns * wide + (wide - p.shape[1]) // 2
        out[y : y + p.shape[0], x : x + p.shape[1]] = p
    return out


def png(gray: np.ndarray) -> bytes:
    """The pixels as a PNG file of 8-bit grey."""
    h, w = gray.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.hstack([np.zeros((h, 1), np.uint8), gray]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _pixels(w: int, h: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(h, w)


def prepare(images: DataFrame, straighten: bool = False) -> DataFrame:
    """image_id, width, height, angle, warnings, content (PNG) of rows image_id, mode, orientation, width, height, pixels; a null orientation is 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, mode, o, w, h, p in b.itertuples(index=False):
                gray, angle, warnings = prepared(_pixels(w, h, p), mode, 1 if pd.isna(o) else int(o), straighten)
                yield pd.DataFrame({"image_id": [i], "width": [gray.shape[1]], "height": [gray.shape[0]], "angle": [angle], "warnings": [warnings], "content": [png(gray)]})

    kind = images.schema["image_id"].dataType.simpleString()
    return images.select("image_id", "mode", "orientation", "width", "height", "pixels").mapInPandas(run, f"image_id {kind}, width int, height int, angle double, warnings array<string>, content binary")


def angles(images: DataFrame) -> DataFrame:
    """image_id, angle of rows image_id, width, height, pixels (grey bytes, by rows)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [page_angle(_pixels(w, h, p)) for w, h, p in zip(b["width"], b["height"], b["pixels"])]
            yield pd.DataFrame({"image_id": b["image_id"], "angle": found})

    return images.select("image_id", "width", "height", "pixels").mapInPandas(run, "image_id long, angle double")
