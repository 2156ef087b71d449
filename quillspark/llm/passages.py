"""Substring dedup: compact windows of token min-hashes, grouped by signature, joined by interval, verified.

A text's tokens are the hashes of its 5-word runs. A run of ``TOKENS`` tokens (50 words) repeats if its
Jaccard similarity with a run of another text can be ``PERCENT`` or more, i.e. if they share ``NEED``, 41
of 46 tokens. Similarity is one of sets, so a run must hold ``NEED`` different tokens: a word or a short
line said over and over is no passage, unless the whole text has copies.

1. A bitmap tells the tokens that two different texts or more hold. The others can't be shared and hash
   to infinity, so that an edit takes no signature away.
2. Under each of ``FUNCTIONS`` hash functions the nodes of the Cartesian tree over a text's token hashes
   that span ``TOKENS`` tokens or more are its compact windows (l, c, r): all runs within [l, r] that hold
   place c have the signature h(c). Windows are posted under this signature if one of these runs has
   ``NEED`` shared tokens.
3. Windows of one signature with the same shared tokens at the same distances from c are one variant: they
   repeat each other, whatever stands between, and only the first of them goes on. A variant holds any
   number of windows; it is made by aggregation, never gathered.
4. Variants of one signature are a list; each is compared with one hub only, the variant of the least text, on
   the tokens around the two places. What holds no shared token that the hub lacks there is done with, as all that
   repeats it repeats the hub's too. Other runs go on, each in one list: under the signature and the first
   such token to the right of c or, where a run holds none, to the left. Texts that have such a run in common meet
   in the same list again. So a turn compares a variant once for each list that its runs are in, 46 at most and
   mostly one or two, whatever the size of a group.
5. Candidates are verified on the tokens of the regions around the places, one region per pair of texts
   and offset.

Two texts that repeat a run share its signature under each function with the probability of the Jaccard
similarity of the run's shared tokens: 1 for exact repeats and where all edits are unique to a text.

Equal texts are one node and are handled once; each of them of 50 words or more repeats as a whole. The
one of least doc_id has a row for every other text that its text was compared with and repeats; its
copies have one for the least of them and each stretch.

Defined cases: null and blank texts and texts of fewer than 50 words have no passages; repeats within
one document only are not reported; rows of one doc_id and text share their result rows; rows with null
doc_id are reported with null; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import textvec
from quillspark.llm.common import apply_arrow, join_hot, map_arrow, materialize

WIDTH, WORDS = 5, 50
TOKENS = WORDS - WIDTH + 1
PERCENT = 80
NEED = -(-2 * TOKENS * PERCENT // (100 + PERCENT))
FUNCTIONS = 3
#: An edit shifts a run by so many tokens at most.
SHIFT = TOKENS - NEED
#: Up to so many hubs (some 450 bytes each) are sent to all tasks; more are joined by shuffle.
BROADCAST_HUBS = 20_000
MARK_BITS = 40
#: Bitmaps have as many bits as there are tokens or texts, at least and at most 2 to the power of these.
LEAST_BITS, MOST_BITS = 20, 29
BUCKET = 1 << 21
_SEEN = 1 << 19
_U = np.uint64
_NEVER = _U(2**64 - 1)
_SEEDS = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 4, dtype=np.uint64)
_PLACES = "key long, ctx long, node long, c int, first int, last int"


def text_hashes(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each text's sequence of tokens, as signed longs."""
    place = np.arange(1, len(tokens) + 1) - np.repeat(bounds[:-1], np.diff(bounds))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textvec.mix(tokens + place.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), dtype=np.uint64)])
    return textvec.mix(sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)


def text_hash(tokens: np.ndarray) -> int:
    return int(text_hashes(tokens, np.array([0, len(tokens)]))[0])


def windows(tokens: np.ndarray, bounds: np.ndarray, f: int, often: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """doc, l, c, r, value of the compact windows under function ``f``; places count from the start of ``tokens``."""
    h, n = textvec.mix(tokens ^ _SEEDS[f]), len(tokens)
    if often is not None:
        h = np.where(often, h, _NEVER)
    least, width = np.arange(n), 1

    def widen(least: np.ndarray, by: int) -> np.ndarray:
        a, b = least[: len(least) - by], least[by:]
        return np.where(h[a] <= h[b], a, b)

    while 2 * width <= TOKENS:
        least, width = widen(least, width), 2 * width
    if len(least) > TOKENS - width > 0:
        least = widen(least, TOKENS - width)
    size = np.maximum(np.diff(bounds) - TOKENS + 1, 0)
    doc = np.repeat(np.arange(len(size)), size)
    first = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(bounds[:-1], size)
    c = least[first] if len(first) else np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (doc[1:] != doc[:-1])])) if len(c) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(c))[: len(begin)] - 1
    return doc[begin], first[begin], c[begin], first[end] + TOKENS - 1 if len(c) else begin, h[c[begin]]


def different(tokens: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """For each run of ``TOKENS`` tokens how many different ones of those ``counted`` it holds."""
    n = len(tokens)
    if n < TOKENS:
        return np.zeros(0, np.int64)
    order = np.argsort(tokens, kind="stable")
    again = np.flatnonzero(tokens[order[1:]] == tokens[order[:-1]])
    before = np.full(n, -1)
    before[order[again + 1]] = order[again]
    at = np.flatnonzero(counted)
    change = np.bincount(np.maximum(before[at] + 1, np.maximum(at - TOKENS + 1, 0)), minlength=n + 1) - np.bincount(at + 1, minlength=n + 1)
    return np.cumsum(change)[: n - TOKENS + 1]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], np.ndarray]]:
    """tokens, bounds, node of each text, and which are new to the task (its memory of them is bounded)."""
    seen: set[int] = set()
    for batch in batches:
        for _, data, offsets in textvec.slices(batch.column(0)):
            tokens, bounds = textvec.Words(data, offsets).shingles(WIDTH)
            large = np.diff(bounds) >= TOKENS
            nodes, fresh = np.where(large, text_hashes(tokens, bounds), 0).tolist(), np.zeros(len(offsets) - 1, bool)
            for d in np.flatnonzero(large).tolist():
                if nodes[d] not in seen:
                    fresh[d] = True
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(nodes[d])
            yield tokens, bounds, nodes, fresh


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, node (null: fewer than 50 words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nodes = [], []
            for _, bounds, own, _ in _texts(iter([pa.RecordBatch.from_arrays([batch.column(1)], ["text"])])):
                n += np.diff(bounds).tolist()
                nodes += [x if k >= TOKENS else None for x, k in zip(own, np.diff(bounds).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.int64())], ["doc_id", "n_tokens", "node"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, node long")


def _bits(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, n.bit_length()))


def _bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """The values of ``slot`` below 2**bits, as a bitmap of 2**bits / 8 bytes, little end first."""
    table = np.zeros(1 << (bits - 3), np.uint8)
    maps = slots.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits"))
    for r in maps.toLocalIterator():
        table[(r["at"] - 1) * 4096 : r["at"] * 4096] = np.frombuffer(r.bits, np.uint8)
    return table


def _has(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    slot = tokens >> _U(64 - (len(bits).bit_length() + 2))
    return (bits[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8) & 1).astype(bool)


def _dealt(bucket: np.ndarray, rows: np.ndarray, count: int) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(count + 1))
    full = np.flatnonzero(np.diff(cuts))
    rows = rows[order]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([rows[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary())], ["bucket", "rows"])


def shared_tokens(docs: DataFrame, total: int) -> np.ndarray:
    """A bitmap of the tokens that two different texts or more hold; some more for their hashes."""
    count, bits = 1 << max(8, (total // BUCKET).bit_length()), _bits(total)
    rest = MARK_BITS - (count.bit_length() - 1)
    kind = np.dtype([("mark", "<u8" if rest > 32 else "<u4"), ("tag", "<u2")])

    def two_tags(marks: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each mark with its least and, if there are others, its greatest tag."""
        both = np.sort(marks.astype(np.uint64) << _U(16) | tags)  # a mark has 40 bits: a sort of numbers, not by two keys
        both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
        step = both[1:] >> _U(16) != both[:-1] >> _U(16)
        both = both[(np.append(True, step) | np.append(step, True))[: len(both)]]
        return both >> _U(16), (both & _U(0xFFFF)).astype(np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            marks, tags = two_tags(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
            held.clear()
            rows = np.zeros(len(marks), kind)
            rows["mark"], rows["tag"] = marks & _U((1 << rest) - 1), tags
            return _dealt((marks >> _U(rest)).astype(np.int64), rows, count)

        for tokens, bounds, nodes, fresh in _texts(batches):
            own = np.repeat(np.array(nodes, np.int64).view(np.uint64), np.diff(bounds))
            mine = np.repeat(fresh, np.diff(bounds))
            # The tag tells texts apart, by the token too: equal tags of two texts hide one token, not all.
            held.append((tokens[mine] >> _U(64 - MARK_BITS), (textvec.mix(tokens[mine] ^ own[mine]) >> _U(48)).astype(np.uint16)))
            size += len(held[-1][0])
            if size > 1 << 20:
                yield out()
                size = 0
        if held:
            yield out()

    def add(key: tuple, table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x, kind) for x in table["rows"].to_pylist()])
        marks = np.sort(two_tags(rows["mark"], rows["tag"])[0])
        marks = (_U(key[0].as_py()) << _U(rest)) | np.unique(marks[1:][marks[1:] == marks[:-1]]).astype(np.uint64)
        return pa.table({"slot": pa.array(np.unique(marks >> _U(MARK_BITS - bits)).astype(np.int64))})

    packed = map_arrow(docs.select(F.col("text").cast("string")), run, "bucket int, rows binary")
    return _bitmap(apply_arrow(packed.groupBy("bucket"), add, "slot long"), bits)


def places_of(docs: DataFrame, shared) -> DataFrame:
    """key, ctx, node, c, first, last: a compact window by its place c and the runs in it that may repeat.

    key: signature and function; ctx: hash of the shared tokens in the window by their distance from c; ``shared``: the bitmap of them, sent to all tasks.
    """

    def posted(tokens: np.ndarray, bounds: np.ndarray, nodes: np.ndarray, fresh: np.ndarray) -> Iterator[pa.RecordBatch]:
        often = _has(shared.value, tokens)
        # Only texts with a run of so many shared tokens, different or not, can have a place; the others' tokens end here.
        many = np.concatenate([[0], np.cumsum(often)])
        many = np.flatnonzero(many[TOKENS:] - many[:-TOKENS] >= NEED) if len(often) >= TOKENS else np.zeros(0, np.int64)
        at = np.searchsorted(many, bounds[:-1])
        some = np.flatnonzero(fresh & (np.append(many, len(tokens))[at] + TOKENS <= bounds[1:]))
        if not len(some):
            return
        size, own = np.diff(bounds)[some], np.repeat(np.isin(np.arange(len(nodes)), some), np.diff(bounds))
        tokens, often, bounds, nodes, fresh = tokens[own], often[own], np.concatenate([[0], np.cumsum(size)]), nodes[some], fresh[some]
        good = np.flatnonzero(different(tokens, often) >= NEED)
        if not len(good):
            return
        power, inverse = textvec._power_tables(len(tokens) + 1)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(often, textvec.mix(tokens), _U(0)) * power[: len(tokens)])])
        for f in range(FUNCTIONS):
            doc, l, c, r, value = windows(tokens, bounds, f, often)
            lo, hi = np.searchsorted(good, l), np.searchsorted(good, r - TOKENS + 1, "right")
            keep = np.flatnonzero(fresh[doc] & often[c] & (lo < hi))
            doc, l, c, r, value = doc[keep], l[keep], c[keep], r[keep], value[keep]
            first, last = good[lo[keep]], good[hi[keep] - 1] + TOKENS
            ctx = textvec.mix((prefix[r + 1] - prefix[l]) * inverse[c])
            key = textvec.mix(value + _U(f))
            of = bounds[doc]
            columns = [key.view(np.int64), ctx.view(np.int64), nodes[doc], *(x.astype(np.int32) for x in (c - of, first - of, last - of))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "ctx", "node", "c", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, bounds, nodes, fresh in _texts(batches):
            yield from posted(tokens, bounds, np.array(nodes, np.int64), fresh)

    return map_arrow(docs.select(F.col("text").cast("string")), run, _PLACES)


def sequences(docs: DataFrame, nodes: DataFrame, bits: int) -> DataFrame:
    """node, tokens (32 bits each) of the texts in ``nodes``."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(nodes.select(F.shiftrightunsigned("node", 64 - bits).alias("slot")), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, bounds, own, fresh in _texts(batches):
            node = np.array(own, np.int64)
            want = np.flatnonzero(fresh & _has(shared.value, node.view(np.uint64)))
            short = (tokens >> _U(32)).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array(node[want]), pa.array([short[bounds[d] : bounds[d + 1]].tobytes() for d in want], pa.binary())], ["node", "tokens"])

    found = map_arrow(docs.select(F.col("text").cast("string")), run, "node long, tokens binary")
    return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def spans(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """The runs of x, as (first, end) of tokens, whose every token lies in a run of TOKENS that repeats in y."""
    y = np.sort(y)
    good = np.flatnonzero(different(x, y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x) >= NEED) if len(y) else y
    if not len(good):
        return []
    cut = np.flatnonzero(np.diff(good) > TOKENS)
    return list(zip(good[np.concatenate([[0], cut + 1])].tolist(), (good[np.append(cut, len(good) - 1)] + TOKENS).tolist()))


def verified(regions: DataFrame, texts: DataFrame) -> DataFrame:
    """node, other, first, last (exclusive): tokens of text ``node`` that repeat in text ``other``, from both sides of ``regions``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for a, b, la, lb, x, y in zip(*(batch.column(i).to_pylist() for i in range(6))):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                out += [(a, b, la + s, la + e) for s, e in spans(x, y)] + [(b, a, lb + s, lb + e) for s, e in spans(y, x)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], ["node", "other", "first", "last"])

    part = lambda lo, hi: F.expr(f"substring(tokens, 4 * {lo} + 1, 4 * ({hi} - {lo} + 1))")
    one = regions.join(texts.withColumnRenamed("node", "a"), "a").select("a", "b", "la", "lb", "rb", part("la", "ra").alias("x"))
    two = one.join(texts.withColumnRenamed("node", "b"), "b").select("a", "b", "la", "lb", "x", part("lb", "rb").alias("y"))
    return map_arrow(two, compare, "node long, other long, first long, last long")


def _regions(pairs: DataFrame) -> DataFrame:
    """a, b, offset, lo, hi, la, ra, lb, rb: what to compare for pairs of places, one region per pair of texts and offset."""
    out = pairs.groupBy("a", "b", (F.col("ca") - F.col("cb")).alias("offset")).agg(F.min("ca").alias("lo"), F.max("ca").alias("hi"))
    side = lambda c, lo: F.greatest(F.lit(0), lo - (TOKENS - 1)).alias(f"l{c}")
    return out.select("*", side("a", F.col("lo")), (F.col("hi") + TOKENS - 1).alias("ra"), side("b", F.col("lo") - F.col("offset")), (F.col("hi") - F.col("offset") + TOKENS - 1).alias("rb"))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a column of sequences, one after the other, and the bounds of each."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), "<u4"), (offsets - offsets[0]) // 4


_TURN = "list long, key long, ctx long, node long, c int, start int, stop int, near binary, hub long, hub_c int"


def _turn(pairs: DataFrame, shared) -> DataFrame:
    """From variants beside the hub of their list: rows with ``hub`` repeat a run of it; rows with ``list`` are runs that go on, in another list."""

    def compare(batch: pa.RecordBatch) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        number = lambda name: batch.column(name).to_numpy()
        c, lists = number("c").astype(np.int64), number("list").view(np.uint64)
        lo = np.maximum(c - TOKENS + 1 - SHIFT, 0)
        (x, at), (y, of) = _flat(batch.column("near")), _flat(batch.column("hub_near"))
        pair = np.repeat(np.arange(len(c)), np.diff(at))
        own, hubs = (_U(1 << 32) * p.astype(np.uint64) | t for p, t in ((pair, x), (np.repeat(np.arange(len(c)), np.diff(of)), y)))
        hubs = np.sort(hubs)
        held = hubs[np.minimum(np.searchsorted(hubs, own), len(hubs) - 1)] == own
        often = _has(shared.value, x.astype(np.uint64) << _U(32))
        run = np.flatnonzero(different(own, often) >= NEED)
        mine = pair[run]
        fits = (run - at[mine] >= number("start")[mine] - lo[mine]) & (run - at[mine] <= number("stop")[mine] - TOKENS - lo[mine])
        run, mine = run[fits], mine[fits]
        same = different(own, held)[run] >= NEED if len(run) else np.zeros(0, bool)
        alike = np.zeros(len(c), bool)
        alike[mine[same]] = True
        # The first shared token to each side of c that the hub lacks.
        other, place = np.flatnonzero(often & ~held), at[:-1] + c - lo
        after = np.searchsorted(other, place, "right")
        right, left = np.append(other, len(own))[after], np.append(-1, other)[after]
        to_right = run + TOKENS > right[mine]
        out = []
        for side, some, token in ((1, to_right, right), (2, ~to_right & (run <= left[mine]), left)):
            r, m = run[some], mine[some]
            if len(r):
                begin = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
                m, first, last = m[begin], r[begin], r[np.append(begin[1:], len(r)) - 1]
                key = textvec.mix(textvec.mix(lists[m] + _U(side)) ^ x[token[m]])
                out.append((m, key.view(np.int64), *((z - at[m] + lo[m]).astype(np.int32) for z in (first, last + TOKENS))))
        return np.flatnonzero(alike & (number("node") != number("hub"))), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _TURN.split(", ")]
        schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for n, f in zip(names, _TURN.split(", "))])

        def rows(batch: pa.RecordBatch, at: np.ndarray, **new: np.ndarray | None) -> pa.RecordBatch:
            some = batch.take(pa.array(at))
            return pa.RecordBatch.from_arrays([some.column(n) if n not in new else pa.nulls(len(at), schema.field(n).type) if new[n] is None else pa.array(new[n]) for n in names], schema=schema)

        for batch in batches:
            if len(batch):
                alike, rest = compare(batch)
                yield rows(batch, alike, list=None, near=None)
                for at, key, start, stop in rest:
                    yield rows(batch, at, list=key, start=start, stop=stop, hub=None, hub_c=None)

    return map_arrow(pairs, run, _TURN)


def repeats(docs: DataFrame, total: int, texts: int) -> DataFrame:
    """node, other, first, last: stretches of text ``node`` that repeat in text ``other``; ``total`` tokens in ``texts`` texts."""
    shared = docs.sparkSession.sparkContext.broadcast(shared_tokens(docs, total))
    places = materialize(places_of(docs, shared), "places")
    variants = places.groupBy("key", "ctx").agg(F.min(F.struct("node", "c", "first", "last")).alias("rep"), F.max("node").alias("most"))
    variants = materialize(variants.select("key", "ctx", F.col("rep.node").alias("node"), F.col("rep.c").alias("c"), F.col("rep.first").alias("start"), F.col("rep.last").alias("stop"), "most"), "variants")
    lists = materialize(variants.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("most").alias("hi")).filter("lo <> hi").select("key", "n"), "lists")
    # What repeats within a variant, and the other places of its first text.
    wide = variants.join(lists, "key").select("key", "ctx", F.col("node").alias("rep"), F.col("c").alias("rep_c"), "most", "n")
    inside = materialize(places.join(wide.filter("rep <> most or n > 1"), ["key", "ctx"]).filter("rep <> most or (node = rep and c <> rep_c)"), "inside")
    other = F.when(F.col("node") == F.col("rep"), F.col("most")).otherwise(F.col("rep"))
    long = lambda df: df.select("node", "other", F.col("first").cast("long"), F.col("last").cast("long"))
    found = long(inside.filter("rep <> most").select("node", other.alias("other"), "first", "last"))
    rest = materialize(variants.join(lists.filter("n > 1"), "key").select(F.col("key").alias("list"), "key", "ctx", "node", "c", "start", "stop"), "rest")
    twins = inside.filter("n > 1 and node = rep and c <> rep_c").select("key", "ctx", (F.col("c") - F.col("rep_c")).alias("shift"))
    if rest.isEmpty():
        return found.distinct()
    held = materialize(sequences(docs, materialize(rest.select("node").distinct(), "nodes"), _bits(16 * texts)), "sequences")
    lo = F.greatest(F.lit(0), F.col("c") - (TOKENS - 1 + SHIFT))
    near = F.substring("tokens", 4 * lo + 1, 4 * (F.col("c") + TOKENS + SHIFT - lo)).alias("near")
    rest = materialize(rest.join(held, "node").select(*rest.columns, near), "near")
    tested = []
    while True:
        # A list of one text is done. The same texts are hubs of many lists, so that pairs of texts meet in few regions.
        hubs = rest.groupBy("list").agg(F.min(F.struct("node", "c", "key", "ctx", "near")).alias("h"), F.max("node").alias("most")).filter("h.node <> most")
        hubs = materialize(hubs.select("list", *(F.col(f"h.{x}").alias(y) for x, y in (("node", "hub"), ("c", "hub_c"), ("key", "hub_key"), ("ctx", "hub_ctx"), ("near", "hub_near")))), "hubs")
        n = hubs.limit(BROADCAST_HUBS + 1).count()
        if not n:
            break
        pairs = rest.join(F.broadcast(hubs) if n <= BROADCAST_HUBS else hubs, "list").filter("key <> hub_key or ctx <> hub_ctx").drop("hub_key", "hub_ctx")
        turn = materialize(_turn(pairs, shared), "turn")
        tested.append(turn.filter("list is null").select("key", "ctx", "node", "c", "hub", "hub_c"))
        rest = turn.filter("list is not null").drop("hub", "hub_c")
    if not tested:
        return found.distinct()
    every = tested[0]
    for more in tested[1:]:
        every = every.unionByName(more)
    first = F.col("node") < F.col("hub")
    pairs = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("node", "hub", "a"), ("c", "hub_c", "ca"), ("hub", "node", "b"), ("hub_c", "c", "cb"))]
    got = materialize(verified(materialize(_regions(every.select(*pairs)), "regions"), held), "verified")
    mine = _islands(got, ["node", "other"]).withColumnRenamed("other", "hub")
    same = every.join(twins, ["key", "ctx"]).join(mine, ["node", "hub"]).filter("c >= first and c < last").withColumnRenamed("hub", "other")
    edge = lambda x, name: x(F.col(name), F.col("c") + (TOKENS if name == "last" else 1 - TOKENS)) + F.col("shift")
    again = same.select("node", "other", edge(F.greatest, "first").alias("first"), edge(F.least, "last").alias("last"))
    return found.unionByName(got).unionByName(long(again)).distinct()


def _islands(stretches: DataFrame, by: list[str], *keep) -> DataFrame:
    """Overlapping stretches of one ``by`` made one."""
    w = Window.partitionBy(*by).orderBy("first", "last")
    fresh = F.col("first") > F.coalesce(F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    marked = stretches.withColumn("island", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), *keep).drop("island")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), match_doc_id: one row per document, other text and maximal stretch that repeats there."""
    rows = materialize(rows_of(docs).filter("node is not null"), "rows")
    names = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("copies"), F.max("n_tokens").alias("n")), "names")
    total, texts, docs_in = names.agg(F.sum("n"), F.count(F.lit(1)), F.sum("copies")).first()
    pairs = materialize(_islands(repeats(docs, total or 0, texts), ["node", "other"]), "stretches")
    # A text that is the other of most pairs is one key, with one name.
    pairs = materialize(join_hot(pairs, names.select(F.col("node").alias("other"), F.col("least").alias("match")), "other", pairs.count()), "named")
    own = names.select("node", "least")
    out = join_hot(pairs, own, "node", pairs.count()).select(F.col("least").alias("doc_id"), "first", "last", "match")
    # Copies: the whole text, and one row per stretch.
    twice = names.filter("copies > 1")
    some = twice.select("node", "least", F.lit(0).cast("long").alias("first"), F.col("n").alias("last"), "most", F.lit(True).alias("whole"), F.lit(None).cast("long").alias("match"))
    brief = pairs.join(twice.select("node"), "node", "left_semi").groupBy("node", "first", "last").agg(F.min("match").alias("match"))
    brief = _islands(brief, ["node"], F.min("match").alias("match"))
    some = some.unionByName(brief.join(twice, "node").select("node", "least", "first", "last", "most", F.lit(False).alias("whole"), "match"))
    copies = join_hot(rows.select("doc_id", "node"), materialize(some, "copies"), "node", docs_in or 0)
    is_least = F.col("least").eqNullSafe(F.col("doc_id"))
    copies = copies.filter(F.col("whole") | ~is_least).withColumn("match", F.when(F.col("whole"), F.when(is_least, F.col("most")).otherwise(F.col("least"))).otherwise(F.col("match")))
    out = out.unionByName(copies.select("doc_id", "first", "last", "match")).distinct()
    return out.select("doc_id", F.col("first").alias("start_word"), (F.col("last") + WIDTH - 1).alias("end_word"), F.col("match").alias("match_doc_id"))
