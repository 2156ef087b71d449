"""MinHash near-dedup: SuperMinHash signatures, banding, verification on whole sets, components.

A document's set holds its distinct 5-word shingles (64-bit hashes); two documents link when
100 * intersection >= 85 * union.

1. ``signatures``: each shingle of a set deals its own random permutation of the 96 slots, step by step: in
   step j it puts j + r, r its j-th random number, into the slot that its permutation has at place j. A slot
   keeps the least value. Ranks are correlated, as a shingle has each rank once, so signatures vary less than
   those of independent hashes. Values of step j lie below those of step j + 1: once every slot of a set has
   a value, the set is done. Large sets stop after one or two steps, a single shingle takes all 96. All sets
   of a slice of texts go through a step at once.
2. 24 bands of 4 slots: linked sets share none of them with probability below (1 - 0.85**4)**24, 2 in 100
   million. Documents with one set are one node, and a node is posted once.
3. Bands that several nodes share: every node is compared with one hub of each of its bands, the node whose
   bands are shared most, i.e. the most typical copy. Nodes apart from it are compared with a hub of their own,
   a few times. So a group of n near copies costs about n comparisons.
4. What shares a band and is still in another component is found by differences from the band's hub h. Let x
   not be linked with h, and D(x) be what only one of x and h holds. Then x and y can only be linked if D(x) and
   D(y) have elements in common: some half of D(y), and all of D(x) but 15 / 85 of the size of x. So a prefix of
   D by rarity is posted, and nodes meet that share an element of it. Copies that are each edited in their own
   way never meet, however many there are; no link between components is lost.
5. Pairs are verified on whole sets; components as in ``ngram_join``.

Defined cases: null and blank texts have no shingles and a component of their own; fewer than five words
make one shingle; texts of any length are taken whole; a null doc_id never names a component unless all its
ids are null, and such a component is kept by none but null; rows with equal doc_id are separate rows of the
result; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import textvec
from quillspark.llm.common import components, map_arrow, materialize
from quillspark.llm.ngram_join import BROADCAST_ROWS, WIDTH, set_hash, sets

PERCENT, BANDS, ROWS = 85, 24, 4
#: Hubs of a band are tried at most so many times, and only while one in so many comparisons finds a link.
HUBS, WORTH = 4, 20
_U = np.uint64
_SEEN = 1 << 19
_UNSET = _U(2**64 - 1)


def signatures(tokens: np.ndarray, bounds: np.ndarray, slots: int = BANDS * ROWS) -> np.ndarray:
    """The SuperMinHash signatures, one row of ``slots`` (at most 255) values per set ``tokens[bounds[i]:bounds[i + 1]]``.

    Repeats within a set change nothing. An empty set has no value in any slot.
    """
    out = np.full((len(bounds) - 1, slots), _UNSET)
    flat, each = out.reshape(-1), np.arange(len(bounds) - 1).repeat(np.diff(bounds))
    place: np.ndarray | None = None  # per token the permutation so far; after step 0 only where it is needed
    for j in range(slots):
        if not len(tokens):
            break
        drawn = textvec.mix(tokens + _U((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        at = j + (((textvec.mix(drawn) >> _U(32)) * _U(slots - j)) >> _U(32)).astype(np.int64)
        row = np.arange(len(tokens))
        slot = at if place is None else place[row, at].astype(np.int64)
        value, where = _U(j) << _U(56) | drawn >> _U(8), each * slots + slot
        lower = value < flat[where]
        np.minimum.at(flat, where[lower], value[lower])
        left = (out == _UNSET).any(1)[each]
        if place is None:
            tokens, each, at = tokens[left], each[left], at[left]
            place = np.tile(np.arange(slots, dtype=np.uint8), (len(tokens), 1))
            place[np.arange(len(tokens)), at] = 0
        else:
            place[row, at] = place[:, j]
            if not left.all():
                tokens, each, place = tokens[left], each[left], place[left]
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(sets, bands) of long: one key for equal values in all slots of a band."""
    rows = signature.reshape(len(signature), bands, signature.shape[1] // bands)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), rows.shape[:2])
    for k in range(rows.shape[2]):
        key = textvec.mix(key * _U(0x9E3779B97F4A7C15) + rows[:, :, k])
    return key.view(np.int64)


def signed(docs: DataFrame, width: int, bands: int, slots: int) -> DataFrame:
    """doc_id, n, node, bands per document; bands only where the task meets a node for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for first, data, offsets in textvec.slices(batch.column(1)):
                tokens, bounds = textvec.Words(data, offsets).shingles(width)
                sets = [np.unique(tokens[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                nodes = [set_hash(s) if len(s) else None for s in sets]
                fresh = [i for i, x in enumerate(nodes) if x is not None and x not in seen and not seen.add(x)]
                if len(seen) > _SEEN:
                    seen.clear()
                ends = np.cumsum([0, *(len(sets[i]) for i in fresh)])
                keys = band_keys(signatures(np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in fresh)]), ends, slots), bands)
                size = np.zeros(len(sets), np.int64)
                size[fresh] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(keys.reshape(-1)))
                own = batch.column(0).slice(first, len(sets))
                yield pa.RecordBatch.from_pydict({"doc_id": own, "n": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array(nodes, pa.int64()), "bands": lists})

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n long, node long, bands array<long>")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """node, tokens (sorted hashes) of the nodes ``ids`` (node, least): their texts are read once more."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    some = docs.join(F.broadcast(ids.select(F.col("least").alias("_d")).distinct()), F.col("doc_id").cast("long").eqNullSafe(F.col("_d")), "left_semi") if few else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            own = [(set_hash(t), t) for t in sets(batch.column(0), width) if len(t)]
            own = [x for x in own if x[0] not in seen and not seen.add(x[0])]
            if len(seen) > _SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.int64()), pa.array([x[1].tobytes() for x in own], pa.binary())], ["node", "tokens"])

    found = map_arrow(some.select(F.col("text").cast("string")), run, "node long, tokens binary")
    return found.join(F.broadcast(ids.select("node")) if few else ids.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _meeting(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with x and y, the sets of both."""
    return pairs.join(found.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(found.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which elements of x y holds; both sorted."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _verified(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = int(_shared(x, y).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return map_arrow(_meeting(pairs, found), run, "a long, b long")


def _differences(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """node, hub, n, d, linked, e of ``pairs`` (a: node, b: hub): a row for each of the d elements e that only one of them holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = _shared(x, y)
                e = np.concatenate([x[~both], y[~_shared(y, x)]]).view(np.int64)
                ok, k = 100 * int(both.sum()) >= percent * (len(x) + len(y) - int(both.sum())), len(e)
                columns = [np.full(k, v, np.int64) for v in (a, b, len(x), k)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.full(k, ok)), pa.array(e)], ["node", "hub", "n", "d", "linked", "e"])

    return map_arrow(_meeting(pairs, found), run, "node long, hub long, n long, d long, linked boolean, e long")


def _apart(own: DataFrame) -> DataFrame:
    """The rows of ``own`` (band, component, ...) in bands that several components share."""
    return own.join(own.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band"), "band")


def _by_difference(hubs: DataFrame, found: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of different components that may be linked, among the nodes of one hub in ``hubs`` (a: node, b: hub)."""
    each = materialize(_differences(hubs, found, percent), "differences")
    often = each.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    rows = each.join(often, ["hub", "e"])
    own = Window.partitionBy("hub", "node")
    rows = rows.withColumns({"rank": F.row_number().over(own.orderBy("c", "e")), "shared": F.count(F.lit(1)).over(own)})
    rest = F.floor(F.col("n") * (100 - percent) / percent) + 1
    half = F.col("d") - F.ceil(F.col("d") * percent / (100 + percent) - 1e-9) + 1  # see the module: with c = (1 - t) / (1 + t), half of 1 - c
    rows = rows.withColumn("place", F.col("d") - F.col("shared") + F.col("rank"))
    rows = rows.filter(F.col("place") <= F.when(F.col("linked"), half).otherwise(F.least(F.col("d"), rest)))
    rows = rows.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = materialize(rows.select("hub", "e", "node", "n", "d", "linked", "place", "component"), "prefixes")
    x, y = (rows.select("hub", "e", *(F.col(c).alias(f"{c}_{i}") for c in ("node", "n", "d", "linked", "place", "component"))) for i in (1, 2))
    need = (F.col("d_1") + F.col("d_2")) * (100 + percent) - (100 - percent) * (F.col("n_1") + F.col("n_2"))  # of elements in common, times 2 * (100 + percent)
    reach = 2 * (100 + percent) * (F.least(F.col("d_1") - F.col("place_1"), F.col("d_2") - F.col("place_2")) + 1) >= need
    fits = F.least("n_1", "n_2") * 100 >= percent * F.greatest("n_1", "n_2")
    pairs = x.join(y, ["hub", "e"]).filter((F.col("node_1") < F.col("node_2")) & (F.col("component_1") != F.col("component_2")) & ~(F.col("linked_1") & F.col("linked_2")) & fits & reach)
    return pairs.select(F.col("node_1").alias("a"), F.col("node_2").alias("b")).distinct()


def links(docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(edges a, b that span each component, node and component) of ``nodes`` (node, least, n, bands); None, None without links."""
    post = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = post.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    listed = post.join(shared, "band")
    usual = listed.groupBy("node").agg(F.sum("c").alias("usual"))
    listed = materialize(listed.join(usual, "node").select("band", "node", "n", "usual"), "bands")
    found = materialize(_sets_of(docs, nodes.select("node", "least").join(usual.select("node"), "node", "left_semi"), width), "sets")
    edges = tried = None
    parts = docs.sparkSession.createDataFrame([], "node long, component long")

    def members() -> DataFrame:
        return listed.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))

    fits = lambda a, b: F.least(a, b) * 100 >= percent * F.greatest(a, b)
    best = lambda own: own.groupBy("band").agg(F.max(F.struct("usual", "node", "n", "component")).alias("h"))
    hubs = materialize(best(listed.withColumn("component", F.col("node"))).select("band", F.col("h.node").alias("hub")), "hubs")
    for turn in range(HUBS + 1):
        own = members()
        if turn:  # of what isn't connected with the band's first hub
            first = hubs.join(parts.withColumnRenamed("node", "hub"), "hub", "left").select("band", F.coalesce("component", "hub").alias("of_hub"))
            own = materialize(_apart(own.join(first, "band").filter("component <> of_hub")), "members")
        hub = best(own).select("band", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.component").alias("hub_component"))
        near = own.join(hub, "band").filter((F.col("component") != F.col("hub_component")) & fits("n", "hub_n")).select(*_ordered("node", "hub")).distinct()
        pairs = materialize(near if tried is None else near.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        new = materialize(_verified(pairs, found, percent), "links")
        asked, got = pairs.count(), new.count()
        if got:
            edges = new if edges is None else edges.union(new)
            parts = materialize(components(edges), "parts")
        if got * WORTH <= asked or turn == HUBS:
            break
    left = _apart(members()).join(hubs, "band").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = materialize(_by_difference(left, found, parts, percent), "pairs")
    new = materialize(_verified(pairs.join(tried, ["a", "b"], "left_anti"), found, percent), "links")
    if not new.isEmpty():
        edges = new if edges is None else edges.union(new)
        parts = components(edges)
    return (None, None) if edges is None else (edges, parts)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (whether it has the component's id)."""
    own = materialize(signed(docs, width, bands, bands * rows), "signed")
    nodes = own.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.first("bands", ignorenulls=True).alias("bands"))
    nodes = materialize(nodes, "nodes")
    _, parts = links(docs, nodes, width, percent)
    info = nodes.select("node", "least")
    if parts is not None:
        info = info.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        info = info.join(info.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    else:
        info = info.withColumnRenamed("least", "component_id")
    out = own.select("doc_id", "n", "node").join(info, "node", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
