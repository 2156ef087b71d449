"""Spatial, fuzzy and greedy one-to-one matching of words, lines and regions.

Candidates come from equi-joins on the page (and a grid cell), so no page's words are ever crossed with
another's; greedy steps, whose order is part of the result, get a page's words of one text, or those left over, as one group.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions import editdist
from quillspark.functions import geometry as G
from quillspark.functions import text as T
from quillspark.functions.batches import by_row
from quillspark.session import written

MATCH, ANCHOR = 70.0, 60.0
MISREAD_DISTANCE = 120.0
MAX_JOIN = 6
#: So many places are looked through without a grid.
FEW = 4096


def words_to_regions(words: DataFrame, regions: DataFrame, share: float = 0.1, least_area: float = 1.0) -> DataFrame:
    """page_id, word_idx, region_idx: the smallest region that holds more than ``share`` of a word, the first of equal ones.

    words: page_id, word_idx, bbox_2d; regions: page_id, region_idx, bbox_2d. Words without one are left out.
    Equi-joins on page, level and cell: a box's level is that of its longer side, in powers of two, and it lies
    in the cells of half that width that it touches, 9 at most whatever its size. Words look for regions of
    their own level and higher ones in these cells, regions for words of higher levels. A page's boxes are
    spread by cell, so a crowded page is no single task. Equal boxes of a page are looked up once: words share the
    answer, and of equal regions only the first can be one.
    """
    edge = lambda side: tuple(f"{side}{c}" for c in ("x1", "y1", "x2", "y2"))

    def sized(df: DataFrame, index: str, side: str) -> DataFrame:
        """Sides of boxes as columns of their own, and their level."""
        x1, y1, x2, y2 = edge(side)
        rows = df.select("page_id", index, *(F.col("bbox_2d")[i].alias(c) for i, c in enumerate((x1, y1, x2, y2)))).filter(f"{x1} < {x2} and {y1} < {y2}")
        return rows.withColumn(f"{side}level", F.ceil(F.log2(F.greatest(F.col(x2) - F.col(x1), F.col(y2) - F.col(y1)))).cast("int"))

    def celled(df: DataFrame, side: str, level: Column) -> DataFrame:
        x1, y1, x2, y2 = map(F.col, edge(side))
        df = df.withColumn("level", level)
        width = F.pow(F.lit(2.0), F.col("level") - 1)
        reach = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
        return df.withColumn("cx", reach(x1, x2)).withColumn("cy", reach(y1, y2))

    def probing(df: DataFrame, side: str, other: DataFrame, levels: str, fits: Callable[[Column, Column], Column]) -> DataFrame:
        """Rows of ``df`` in the cells of every level of the other side, some sixty at most, that ``fits``."""
        held = other.agg(F.collect_set(levels).alias("levels"))
        return celled(df.join(F.broadcast(held)), side, F.explode(F.filter("levels", lambda x: fits(x, F.col(f"{side}level"))))).drop("levels")

    every, r = sized(words, "word_idx", "w"), sized(regions, "region_idx", "r")
    box = ["page_id", *edge("w")]
    w = every.select(*box, "wlevel").distinct()
    r = r.groupBy("page_id", *edge("r"), "rlevel").agg(F.min("region_idx").alias("region_idx"))
    on = ["page_id", "level", "cx", "cy"]
    pairs = probing(w, "w", r, "rlevel", lambda x, own: x >= own).join(celled(r, "r", F.col("rlevel")), on)
    pairs = pairs.unionByName(probing(r, "r", w, "wlevel", lambda x, own: x > own).join(celled(w, "w", F.col("wlevel")), on))
    area = lambda s: (F.col(f"{s}x2") - F.col(f"{s}x1")) * (F.col(f"{s}y2") - F.col(f"{s}y1"))
    wide, high = F.least("wx2", "rx2") - F.greatest("wx1", "rx1"), F.least("wy2", "ry2") - F.greatest("wy1", "ry1")
    inside = pairs.filter((wide > 0) & (high > 0) & (wide * high / F.greatest(F.lit(least_area), area("w")) > share))
    best = F.min(F.struct(area("r").alias("area"), "region_idx"))
    found = inside.groupBy(*box).agg(best.alias("best"))
    return every.join(found, box).groupBy("page_id", "word_idx").agg(F.min("best")["region_idx"].alias("region_idx"))


def label_words(words: DataFrame, regions: DataFrame, unknown: str = "Unbekannt") -> DataFrame:
    """As ``words_to_regions`` on a scale of 0 to 1: every word with label and kind of its region, or unknown and other."""
    found = words_to_regions(words, regions, least_area=1e-6)
    own = found.join(regions.select("page_id", "region_idx", "label", "kind"), ["page_id", "region_idx"])
    out = words.join(own, ["page_id", "word_idx"], "left")
    return out.withColumns({"label": F.coalesce("label", F.lit(unknown)), "kind": F.coalesce("kind", F.lit("other"))})


class _Tokens:
    """Tokens that are taken one by one, each the first of those left that is most like a text, if like enough.

    One that equals the text needs no search; of the others only those are compared that share enough
    characters to be better than the best so far.
    """

    def __init__(self, tokens: list[str], threshold: float = MATCH):
        self.low, self.threshold = [t.lower() for t in tokens], threshold
        self.letters = {c: i for i, c in enumerate(sorted({c for t in self.low for c in t}))}
        self.counts = np.zeros((len(tokens), len(self.letters)), np.int32)
        for i, t in enumerate(self.low):
            for c in t:
                self.counts[i, self.letters[c]] += 1
        self.sizes = np.array([len(t) for t in self.low], np.int64)
        self.left = np.ones(len(tokens), bool)
        self.equal: dict[str, list[int]] = {}
        for i in range(len(tokens) - 1, -1, -1):
            self.equal.setdefault(self.low[i], []).append(i)
        self.next = 0

    def take(self, text: str) -> int | None:
        if not text:
            return None
        text = text.lower()
        same = self.equal.get(text, [])
        while same and not self.left[same[-1]]:
            same.pop()
        if same:
            return self._taken(same[-1])
        own = np.zeros(len(self.letters), np.int32)
        for c in text:
            if c in self.letters:
                own[self.letters[c]] += 1
        bound = np.where(self.left & (self.sizes > 0), 200.0 * np.minimum(self.counts, own).sum(1) / np.maximum(self.sizes + len(text), 1), 0.0)
        some = np.flatnonzero((bound >= self.threshold) & (bound > 0))
        score, at = 0.0, None
        for k in some[np.lexsort((some, -bound[some]))].tolist():
            if bound[k] < score:
                break
            s = editdist.ratio(text, self.low[k])
            if s >= self.threshold and (s > score or s == score and k < at):
                score, at = s, k
        return None if at is None else self._taken(at)

    def take_first(self) -> int | None:
        """The first one left, whatever it reads."""
        while self.next < len(self.low) and not self.left[self.next]:
            self.next += 1
        return self._taken(self.next) if self.next < len(self.low) else None

    def _taken(self, k: int) -> int:
        self.left[k] = False
        return k


def adopt_tokens(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Words (page_id, word_idx, region_idx, content) with the content of the region's token each is most like, if by 70 or more.

    In order of words; a token serves once; a word without content takes the first token left.
    """
    tokens = regions.select("page_id", "region_idx", T.words(T.text("content")).alias("tokens"))
    grouped = words.groupBy("page_id", "region_idx").agg(F.array_sort(F.collect_list(F.struct("word_idx", "content"))).alias("words")).join(tokens, ["page_id", "region_idx"], "left")

    def own(words: list[dict], tokens: list[str] | None) -> list[dict]:
        tokens, texts = tokens or [], []
        left = _Tokens(tokens)
        for w in words:
            content = (w["content"] or "").strip()
            at = left.take(content) if content else left.take_first()
            texts.append({"word_idx": w["word_idx"], "content": content if at is None else tokens[at]})
        return texts

    adopt = by_row(own, "array<struct<word_idx: int, content: string>>")
    return grouped.select("page_id", "region_idx", F.inline(adopt("words", "tokens"))).select("page_id", "word_idx", "region_idx", "content")


def words_of_text(pages: DataFrame, polygons: DataFrame, detector_only: bool = False) -> DataFrame:
    """page_id, idx, content, polygon, confidence: the text's tokens in order, each with the polygon of the unused word most like it (70 or more).

    pages: page_id, text; polygons: page_id, idx, content, polygon, confidence. A token without one has an
    empty polygon and confidence 1; with ``detector_only`` the words left over follow.
    """
    boxes = polygons.filter("size(polygon) > 0").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("idx", "content", "polygon", "confidence"))).alias("boxes"))

    def placed(tokens: list[str], rows: list[dict] | None) -> list[dict]:
        rows = rows or []
        left, used, words = _Tokens([(r["content"] or "").strip() for r in rows]), set(), []
        word = lambda i, content: {"content": content, "polygon": rows[i]["polygon"], "confidence": 1.0 if rows[i]["confidence"] is None else rows[i]["confidence"]}
        for t in tokens:
            at = left.take(t)
            if at is not None:
                used.add(at)
            words.append({"content": t, "polygon": [], "confidence": 1.0} if at is None else word(at, t))
        if detector_only:
            words += [word(i, rows[i]["content"] or "") for i in range(len(rows)) if i not in used]
        return words

    attach = by_row(placed, "array<struct<content: string, polygon: array<double>, confidence: double>>")
    joined = pages.select("page_id", T.words(T.text("text")).alias("tokens")).join(boxes, "page_id", "left")
    rows = joined.select("page_id", F.posexplode(attach("tokens", "boxes")).alias("idx", "w"))
    return rows.select("page_id", "idx", "w.content", "w.polygon", "w.confidence")


class _Near:
    """Different points by cells of a grid; finds the nearest that are left, and forgets those that are taken."""

    def __init__(self, at: np.ndarray):
        span = float(np.ptp(at, axis=0).max()) if len(at) else 0.0
        self.width = max(span / max(1.0, (len(at) / 2) ** 0.5), 1e-9 * (1 + span))
        self.low = at.min(0) if len(at) else np.zeros(2)
        cells = np.floor((at - self.low) / self.width).astype(np.int64)
        self.most = cells.max(0) if len(at) else np.zeros(2, np.int64)
        order = np.lexsort((cells[:, 1], cells[:, 0]))
        self.at, self.cells, self.x, self.y = at, cells, at[:, 0].copy(), at[:, 1].copy()
        cuts = np.flatnonzero(np.concatenate([[True], (np.diff(cells[order], axis=0) != 0).any(1)])) if len(at) else np.zeros(0, np.int64)
        self.rows = {tuple(cells[x[0]].tolist()): x for x in np.split(order, cuts[1:])} if len(at) else {}
        self.count = len(at)

    def take(self, k: int) -> None:
        self.x[k] = np.inf
        cell = tuple(self.cells[k].tolist())
        self.rows[cell] = self.rows[cell][self.rows[cell] != k]
        self.count -= 1

    def nearest(self, x: float, y: float, most: float = np.inf) -> tuple[float, list[int]] | None:
        """(distance, numbers) of the points left that are nearest, if within ``most``."""
        if not self.count:
            return None
        if len(self.at) <= FEW:
            d = np.sqrt((self.x - x) ** 2 + (self.y - y) ** 2)
            least = float(d.min())
            return (least, np.flatnonzero(d == least).tolist()) if least <= most else None
        cx, cy = (int(v) for v in np.floor((np.array([x, y]) - self.low) / self.width))
        best, found = None, []
        # Rings from the first that touches the grid to the last; what lies beyond ring r is at least r widths away.
        ring = max(0, -cx, cx - int(self.most[0]), -cy, cy - int(self.most[1]))
        last = max(cx, int(self.most[0]) - cx, cy, int(self.most[1]) - cy)
        while ring <= last and (ring - 1) * self.width <= most and (best is None or (ring - 1) * self.width <= best):
            for cell in _ring(cx, cy, ring, self.most):
                rows = self.rows.get(cell)
                if rows is None or not len(rows):
                    continue
                d = np.sqrt((self.at[rows, 0] - x) ** 2 + (self.at[rows, 1] - y) ** 2)
                least = float(d.min())
                if least <= most and (best is None or least <= best):
                    found = ([] if best is None or least < best else found) + rows[d == least].tolist()
                    best = least
            ring += 1
        return None if best is None else (best, found)


def _ring(cx: int, cy: int, r: int, most: np.ndarray) -> Iterator[tuple[int, int]]:
    """The cells of the grid at distance ``r`` from a cell."""
    if r == 0:
        yield cx, cy
        return
    for x in range(max(0, cx - r), min(int(most[0]), cx + r) + 1):
        for y in (cy - r, cy + r):
            if 0 <= y <= most[1]:
                yield x, y
    for y in range(max(0, cy - r + 1), min(int(most[1]), cy + r - 1) + 1):
        for x in (cx - r, cx + r):
            if 0 <= x <= most[0]:
                yield x, y


class _Stacks:
    """Words (idx, x, y) by their places: different places, and of each the idx of its words in order, first the least that is left."""

    def __init__(self, idx: np.ndarray, at: np.ndarray):
        order = np.lexsort((idx, at[:, 1], at[:, 0]))
        at, self.idx = at[order], idx[order]
        cuts = np.flatnonzero((np.diff(at, axis=0) != 0).any(1)) + 1 if len(at) else np.zeros(0, np.int64)
        self.at = at[np.concatenate([[0], cuts]).astype(np.int64)] if len(at) else at
        bounds = [0, *cuts.tolist(), len(at)] if len(at) else [0]
        self.next, self.end = bounds[:-1], bounds[1:]

    def left(self, k: int) -> int:
        return self.end[k] - self.next[k]

    def take(self, k: int, n: int) -> np.ndarray:
        self.next[k] += n
        return self.idx[self.next[k] - n : self.next[k]]

    def rest(self) -> np.ndarray:
        return np.concatenate([self.idx[i:j] for i, j in zip(self.next, self.end)] or [self.idx])


def _level(a: _Stacks, b: _Stacks, meet: dict[int, list[int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of all words of a's stacks with those of b's stacks that they ``meet``, all at one distance: in order of (a, b)."""
    out, often = [], Counter(t for own in meet.values() for t in own)
    several = {s: own for s, own in meet.items() if len(own) > 1 or often[own[0]] > 1}
    for s, own in meet.items():
        if s not in several:
            n = min(a.left(s), b.left(own[0]))
            out.append((a.take(s, n), b.take(own[0], n)))
    i, j = [], []
    line = [(int(a.idx[a.next[s]]), s) for s in several]
    heapq.heapify(line)
    while line:
        k, s = line[0]
        several[s] = own = [t for t in several[s] if b.left(t)]
        if not own:
            heapq.heappop(line)
            continue
        j.append(int(b.take(min(own, key=lambda t: b.idx[b.next[t]]), 1)[0]))
        i.append(k)
        a.next[s] += 1
        if a.left(s):
            heapq.heapreplace(line, (int(a.idx[a.next[s]]), s))
        else:
            heapq.heappop(line)
    return [*out, (np.array(i, np.int64), np.array(j, np.int64))]


def _pairs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(idx of a, idx of b) of the pairs of a and b (idx, places) in order of (distance, a, b), every idx once; a place of NaN is at distance 0 from all.

    The same as sorting all pairs. Words of one place are a stack: only a stack's nearest stacks that are left are
    ever looked up, and pairs of one distance are made for whole stacks at once.
    """
    nowhere = [np.isnan(at).any(1) for _, at in (a, b)]
    sides = [_Stacks(idx[~none], at[~none]) for (idx, at), none in zip((a, b), nowhere)]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    if nowhere[0].any() or nowhere[1].any():
        out.append(_anywhere(*sides, *(np.sort(idx[none]) for (idx, _), none in zip((a, b), nowhere))))
    ours, theirs = sides
    near = _Near(theirs.at)
    for t in range(len(theirs.at)):
        if not theirs.left(t):
            near.take(t)
    places = ours.at.tolist()
    heap = [(x[0], s, x[1]) for s, (u, v) in enumerate(places) if ours.left(s) and (x := near.nearest(u, v, most)) is not None]
    heapq.heapify(heap)
    while heap:
        level, meet = heap[0][0], {}
        while heap and heap[0][0] == level:
            _, s, found = heapq.heappop(heap)
            if found := [t for t in found if theirs.left(t)]:
                meet[s] = found
            elif (x := near.nearest(*places[s], most)) is not None:
                heapq.heappush(heap, (x[0], s, x[1]))
        if not meet:
            continue
        out += _level(ours, theirs, meet)
        for t in {t for own in meet.values() for t in own}:
            if not theirs.left(t):
                near.take(t)
        for s in meet:
            if ours.left(s) and (x := near.nearest(*places[s], most)) is not None:
                heapq.heappush(heap, (x[0], s, x[1]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(i for i, _ in out)]), np.concatenate([none, *(j for _, j in out)])


def _anywhere(ours: _Stacks, theirs: _Stacks, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs at distance 0 where words without a place are about: ``a`` and ``b``, which are at any place."""
    at = {tuple(p): t for t, p in enumerate(theirs.at.tolist())}
    where = {int(k): t for t in range(len(theirs.at)) for k in theirs.idx[theirs.next[t] : theirs.end[t]].tolist()}
    every, free, used = sorted([*where, *b.tolist()]), b.tolist(), set()
    line = sorted([(int(k), None) for k in a] + [(k, s) for s in range(len(ours.at)) for k in ours.idx[ours.next[s] : ours.end[s]].tolist()])
    firsts = {"every": 0, "free": 0}
    i, j = [], []

    def first(name: str, rest: list[int]) -> int | None:
        while firsts[name] < len(rest) and rest[firsts[name]] in used:
            firsts[name] += 1
        return rest[firsts[name]] if firsts[name] < len(rest) else None

    for k, s in line:
        if s is None:
            found = first("every", every)
        else:
            t = at.get(tuple(ours.at[s].tolist()))
            while t is not None and theirs.left(t) and int(theirs.idx[theirs.next[t]]) in used:
                theirs.next[t] += 1
            some = [x for x in (first("free", free), int(theirs.idx[theirs.next[t]]) if t is not None and theirs.left(t) else None) if x is not None]
            found = min(some, default=None)
        if found is not None:
            used.add(found)
            i.append(k)
            j.append(found)
    done = set(i)
    for side, gone in ((ours, done), (theirs, used)):
        kept = np.array([int(k) not in gone for k in side.idx], bool)
        bounds = np.concatenate([[0], np.cumsum(kept)])
        begin = [0, *side.end[:-1]]
        side.idx, side.next, side.end = side.idx[kept], bounds[begin].tolist() if side.end else [], bounds[side.end].tolist() if side.end else []
    return np.array(i, np.int64), np.array(j, np.int64)


def _greedy(a: dict[int, tuple[float, float] | None], b: dict[int, tuple[float, float] | None], most: float = np.inf) -> list[tuple[int, int]]:
    """``_pairs`` of two pages that are given as idx: place."""
    sides = ((np.array([*x], np.int64), np.array([(np.nan, np.nan) if p is None else p for p in x.values()], float).reshape(-1, 2)) for x in (a, b))
    i, j = _pairs(*sides, most)
    return list(zip(i.tolist(), j.tolist()))


def word_diff(ours: DataFrame, theirs: DataFrame, misread: float = MISREAD_DISTANCE) -> DataFrame:
    """page_id, status, ours_idx, theirs_idx: matched, mismatched, only_ours, only_theirs; every word once.

    Words of equal text (lower case, without punctuation) pair by nearness; what is left pairs with words
    at most ``misread`` away. Both: page_id, idx, content, polygon. A page's words of one text are one group, and then
    those that are left: the greedy order is part of the result. No pairs are listed.
    """
    side = lambda df: df.select("page_id", F.col("idx").cast("int").alias("idx"), T.diff_key(T.text("content")).alias("key"), G.bounds(F.col("polygon")).alias("b")).select("page_id", "idx", "key", ((F.col("b")[0] + F.col("b")[2]) / 2).alias("x"), ((F.col("b")[1] + F.col("b")[3]) / 2).alias("y"))
    kind = ours.schema["page_id"].dataType.simpleString()

    def pairing(most: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def words(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            """An idx that comes twice is one word, at its last place."""
            idx, last = np.unique(rows["idx"].to_numpy()[::-1], return_index=True)
            at = np.stack([rows[c].to_numpy() for c in ("x", "y")], 1)[::-1][last]
            return idx.astype(np.int64), at

        def pair(left: pa.Table, right: pa.Table) -> pa.Table:
            i, j = _pairs(words(left), words(right), most) if len(left) and len(right) else (np.zeros(0, np.int64),) * 2
            page = (left if len(left) else right)["page_id"][0].as_py()
            return pa.table({"page_id": pa.array([page] * len(i), left.schema.field("page_id").type), "ours_idx": pa.array(i, pa.int32()), "theirs_idx": pa.array(j, pa.int32())})

        return pair

    def paired(left: DataFrame, right: DataFrame, by: list[str], most: float) -> DataFrame:
        right = right.select(*(F.col(c).alias(c) for c in right.columns))  # both may come from one table
        return written(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(pairing(most), f"page_id {kind}, ours_idx int, theirs_idx int"), "pairs")

    def without(rows: DataFrame, pairs: DataFrame, index: str) -> DataFrame:
        gone = pairs.select(F.col("page_id").alias("_page"), F.col(index).alias("_idx"))
        return rows.join(gone, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("idx") == F.col("_idx")), "left_anti")

    sides, names = (side(ours), side(theirs)), ("ours_idx", "theirs_idx")
    matched = paired(*(s.filter("key <> ''") for s in sides), ["page_id", "key"], np.inf)
    sides = [without(s, matched, n).drop("key") for s, n in zip(sides, names)]
    mismatched = paired(*(s.filter("x is not null and y is not null and not isnan(x) and not isnan(y)") for s in sides), ["page_id"], misread)
    only = [without(s, mismatched, n).select("page_id", F.lit(f"only_{n[:-4]}").alias("status"), F.col("idx").alias(n)) for s, n in zip(sides, names)]
    out = matched.withColumn("status", F.lit("matched")).unionByName(mismatched.withColumn("status", F.lit("mismatched")))
    for df in only:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.select("page_id", "status", "ours_idx", "theirs_idx")


def diff_totals(diff: DataFrame, by: list[str]) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_count")
    return diff.groupBy(*by).agg(*(count(s) for s in ("matched", "mismatched", "only_ours", "only_theirs")))


class _Lines:
    """The lines of a text with counts of their characters, for the best of them, or of runs of them joined by spaces."""

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.letters = {c: i for i, c in enumerate(sorted({c for x in lines for c in x} | {" "}))}
        self.counts = np.zeros((len(lines) + 1, len(self.letters)), np.int64)
        for i, x in enumerate(lines):
            np.add.at(self.counts[i + 1], [self.letters[c] for c in x], 1)
        self.counts = self.counts.cumsum(0)

    def best(self, want: str, runs: list[tuple[int, int]], threshold: float) -> tuple[float, int] | None:
        """(score, which of ``runs``) of the first run most like ``want``, if like enough.

        No common subsequence is longer than what two texts share of each character: that bounds a run's score, and
        runs whose bound is below the best score so far are never compared.
        """
        if not runs:
            return None
        lo, hi = np.array(runs).T
        have = self.counts[hi] - self.counts[lo]
        have[:, self.letters[" "]] += hi - lo - 1
        own, more = np.zeros(len(self.letters), np.int64), 0
        for c in want:
            if c in self.letters:
                own[self.letters[c]] += 1
            else:
                more += 1
        total = have.sum(1) + len(want)
        bound = 200.0 * np.minimum(have, own).sum(1) / np.maximum(total, 1)
        score, at = 0.0, -1
        for k in np.lexsort((np.arange(len(runs)), -bound)).tolist():
            if bound[k] < score or bound[k] < threshold:
                break
            s = editdist.ratio(want, " ".join(self.lines[lo[k] : hi[k]]))
            if s > score or s == score and k < at:
                score, at = s, k
        return (score, at) if score > 0 and score >= threshold else None


def align(candidate: str, source: str, threshold: float = ANCHOR) -> str:
    """The stretch of ``source`` lines that reads as ``candidate``; the candidate itself if its first line has no likeness there.

    Each further line moves the end to the best run of up to MAX_JOIN lines within twice as many ahead.
    """
    lines = [x for x in (source or "").splitlines() if x.strip()]
    wanted = [x for x in (candidate or "").splitlines() if x.strip()]
    if not lines or not wanted:
        return candidate
    known = _Lines(lines)
    found = known.best(wanted[0], [(i, i + 1) for i in range(len(lines))], threshold)
    if found is None:
        return candidate
    end = first = found[1]
    for want in wanted[1:]:
        runs = [(i, i + n) for i in range(end, min(len(lines), end + 2 * MAX_JOIN)) for n in range(1, min(MAX_JOIN, len(lines) - i) + 1)]
        found = known.best(want, runs, threshold)
        if found is not None:
            end = runs[found[1]][1] - 1
    return "\n".join(lines[first : end + 1])


@F.pandas_udf(StringType())
def source_text(candidate: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([align(c, s) if c and s else c for c, s in zip(candidate, source)])
