"""N-gram Jaccard join: a grouped prefix join over sets of word shingles, with components of its links.

A document's set holds its distinct 5-word shingles, as 64-bit hashes; two documents link when
100 * intersection >= 80 * union. Nothing but these hashes stands for the shingles.

1. Documents with one set are one node (a 64-bit hash of the set); a node without shingles links with
   nothing.
2. Shingles are ordered by how many nodes hold them (levels of powers of 4, from counts over the whole
   corpus), then by hash. Counts are kept for 40 bits of the hash and looked up by 24; any function of
   the shingle makes a valid order, so the result doesn't depend on that.
3. The first n - ceil(0.8 n) + 1 shingles of a node in this order are its prefix; linked nodes share one.
   Nodes with the same prefix and size are one group, and only groups are posted to the index.
4. Index lists of at most ``ALL_PAIRS`` groups give all pairs that pass the size filter and the position
   filter (shingles before the first shared one are not shared). Longer lists are never paired up: their
   groups, and the members of a group, are first compared with one hub, the list's group with the fewest
   rare shingles, i.e. the most typical copy. Verified links make components; only pairs of members that share a list or group but lie in
   different components are left, and those are compared in a second round. So no link between
   components is lost, and a cluster of n near copies costs about n comparisons.
5. Pairs are verified on the whole sets.

Shingles travel as packed arrays, bucketed by hash, so the JVM moves bytes, not rows. Buckets grow in
number with the corpus; postings of frequent shingles are spread over several.

Defined cases: null and blank texts have no shingles and a component of their own; fewer than five
words make one shingle; a null doc_id never names a component unless all its ids are null; rows with
equal doc_id are separate rows of the result; an empty table gives an empty result. Extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import textvec
from quillspark.llm.common import apply_arrow, components, map_arrow, materialize

WIDTH, PERCENT = 5, 80
ALL_PAIRS = 16
SLOT_BITS = 24
#: Shingles per bucket, at most about; a list of a level from SPREAD_LEVEL up (4**SPREAD_LEVEL nodes) is spread.
BUCKET, SPREAD_LEVEL = 1 << 21, 6
_SEEN = 1 << 19
#: Up to so many ids are sent to all tasks to filter the texts; more are joined by shuffle.
BROADCAST_ROWS = 500_000
_U = np.uint64


def prefix_length(n: np.ndarray | int, percent: int = PERCENT):
    return n - (percent * n + 99) // 100 + 1


def set_hash(tokens: np.ndarray) -> int:
    """Order-independent hash of a set of shingles, as a signed long."""
    h = int(textvec.mix(tokens ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) + 3 * int(textvec.mix(tokens + _U(0x14057B7EF767814F)).sum(dtype=np.uint64))
    return int(textvec.mix(np.array([(h + len(tokens)) & (2**64 - 1)], np.uint64)).view(np.int64)[0])


def sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, offsets in textvec.slices(texts):
        tokens, bounds = textvec.Words(data, offsets).shingles(width)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield np.unique(tokens[a:b])


def _new_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(hash, set) of the sets of a task, most repeats left out: a bounded memory of those seen."""
    seen: set[int] = set()
    for batch in batches:
        for tokens in sets(batch.column(0), width):
            if len(tokens):
                node = set_hash(tokens)
                if node not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(node)
                    yield node, tokens


def rows_of(docs: DataFrame, width: int) -> DataFrame:
    """row, doc_id, n, node per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(len(t), set_hash(t) if len(t) else None) for t in sets(batch.column(1), width)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n": pa.array([x[0] for x in own], pa.int64()), "node": pa.array([x[1] for x in own], pa.int64())})

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n long, node long")


def _packed(by: np.ndarray, count: int, columns: list[np.ndarray], offset: int = 0) -> pa.RecordBatch:
    order = np.argsort(by, kind="stable")
    cuts = np.searchsorted(by[order], np.arange(count + 1))
    full = np.flatnonzero(np.diff(cuts))
    columns = [c[order] for c in columns]
    arrays = [pa.array([c[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(full + offset, pa.int32()), *arrays], ["bucket", *"abcd"[: len(columns)]])


def levels(docs: DataFrame, buckets: int, width: int) -> np.ndarray:
    """For each 24-bit slot the level of its most frequent shingle: l if 4**l nodes or more hold it.

    Gathered as bitmaps, at most 2 MB a level; the array of 16 MB has the same size for any corpus.
    """
    slot_buckets = 1 << max(8, (buckets - 1).bit_length())
    rest = 40 - (slot_buckets.bit_length() - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            marks, n = np.unique(np.concatenate(held) >> _U(24), return_counts=True)
            held.clear()
            return _packed((marks >> _U(rest)).astype(np.int64), slot_buckets, [(marks & _U((1 << rest) - 1)).astype("<u8" if rest > 32 else "<u4"), np.minimum(n, 65535).astype("<u2")])

        for _, tokens in _new_sets(batches, width):
            held.append(tokens)
            if sum(map(len, held[-64:])) > 1 << 20 or len(held) % 64 == 0 and sum(map(len, held)) > 1 << 20:
                yield out()
        if held:
            yield out()

    def add(key: tuple, table: pa.Table) -> pa.Table:
        marks = np.concatenate([np.frombuffer(x, "<u8" if rest > 32 else "<u4") for x in table["a"].to_pylist()])
        n = np.concatenate([np.frombuffer(x, "<u2") for x in table["b"].to_pylist()]).astype(np.int64)
        order = np.argsort(marks, kind="stable")
        marks, n = marks[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]]))
        total = np.add.reduceat(n, first)
        heavy = total >= 4
        slot = ((_U(key[0].as_py()) << _U(rest)) | marks[first][heavy].astype(np.uint64)) >> _U(40 - SLOT_BITS)
        level = np.minimum(np.log2(total[heavy]) // 2, 15).astype(np.int64)
        both = np.unique(level * (1 << SLOT_BITS) + slot.astype(np.int64))
        return pa.table({"level": pa.array(both >> SLOT_BITS, pa.int32()), "slot": pa.array(both & ((1 << SLOT_BITS) - 1), pa.int64())})

    packed = map_arrow(docs.select(F.col("text").cast("string")), count, "bucket int, a binary, b binary")
    slots = apply_arrow(packed.groupBy("bucket"), add, "level int, slot long")
    maps = slots.groupBy("level", F.bitmap_bucket_number("slot").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    table = np.zeros(1 << SLOT_BITS, np.uint8)
    for r in sorted(maps.collect(), key=lambda r: r.level):  # at most 16 levels of 513 bitmaps of 4 kB
        # bitmap numbers begin at 1 for slots 1..32768, but slot 0 is in number 0's last place
        set_ = np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little"))
        at = (r["at"] - 1) * 32768 + 1 + set_ if r["at"] > 0 else -set_
        table[at[(at >= 0) & (at < len(table))]] = r.level
    return table


def index(docs: DataFrame, table: np.ndarray, buckets: int, width: int, percent: int) -> DataFrame:
    """kind, x, y, n, pos, rare: 0: groups x, y to compare; 1: group y (of size n) on the long list of shingle x; 2: member x of group y, of size n.

    pos: the shingle's place in the group's order, up to 65535; rare: how many in a thousand of the group's
    shingles come first for being rare.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of = shared.value
        held: list[tuple[np.ndarray, int, int, int, int]] = []  # prefix, node, group, size, rare
        size = 0
        groups: set[int] = set()

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal size
            nodes, own, n, rare = (np.array([h[i] for h in held], kind) for i, kind in ((1, np.int64), (2, np.int64), (3, "<u4"), (4, "<u4")))
            yield _packed(own.view(np.uint64) % _U(buckets), buckets, [nodes, own, n, rare], buckets)
            fresh = [i for i, g in enumerate(own.tolist()) if g not in groups and not groups.add(g)]
            if len(groups) > _SEEN:
                groups.clear()
            if fresh:
                each = [len(held[i][0]) for i in fresh]
                tokens = np.concatenate([held[i][0] for i in fresh])
                pos = np.concatenate([np.minimum(np.arange(k, dtype="<u4"), 65535) for k in each])
                group, sizes = np.repeat(own[fresh], each), np.repeat(n[fresh], each)
                level = level_of[(tokens >> _U(64 - SLOT_BITS)).astype(np.int64)].astype(np.int64)
                spread = np.where(level >= SPREAD_LEVEL, 4 ** np.clip(level - SPREAD_LEVEL + 1, 0, 12), 1).astype(np.uint64)
                by = textvec.mix(tokens + textvec.mix(group.view(np.uint64)) % spread) % _U(buckets)
                yield _packed(by.astype(np.int64), buckets, [tokens, group, sizes, pos << np.uint32(16) | np.repeat(rare[fresh], each)])
            held.clear()
            size = 0

        for node, tokens in _new_sets(batches, width):
            level = level_of[(tokens >> _U(64 - SLOT_BITS)).astype(np.int64)]
            p = prefix_length(len(tokens), percent)
            prefix = tokens[:p] if not level.any() else tokens[np.argsort(level, kind="stable")[:p]]
            rare = 1000 * min(p, int((level == 0).sum())) // len(tokens)
            group = set_hash(np.concatenate([prefix, np.array([len(tokens)], np.uint64)]))
            held.append((prefix, node, group, len(tokens), rare))
            size += len(tokens)
            if size > 1 << 20:
                yield from out()
        if held:
            yield from out()

    def pairs(key: tuple, packed: pa.Table) -> pa.Table:
        level_of = shared.value
        read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in packed[c].to_pylist()])
        if key[0].as_py() >= buckets:
            nodes = read("a", "<i8")
            once = np.unique(nodes, return_index=True)[1]
            return _index_rows(2, nodes[once], read("b", "<i8")[once], read("c", "<u4")[once], np.zeros(len(once)), read("d", "<u4")[once])
        tokens, groups, n, meta = read("a", "<u8"), read("b", "<i8"), read("c", "<u4").astype(np.int64), read("d", "<u4").astype(np.int64)
        order = np.lexsort((groups, tokens))
        order = order[np.concatenate([[True], (np.diff(tokens[order].view(np.int64)) != 0) | (groups[order][1:] != groups[order][:-1])])]
        tokens, groups, n, pos, rare = tokens[order], groups[order], n[order], meta[order] >> 16, meta[order] & 65535
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        each = np.diff(np.append(first, len(tokens)))
        spread = level_of[(tokens[first] >> _U(64 - SLOT_BITS)).astype(np.int64)] >= SPREAD_LEVEL
        long = np.repeat((each > ALL_PAIRS) | spread, each)
        found = [np.zeros((0, 2), np.int64)]
        for step in range(1, ALL_PAIRS):
            i = np.flatnonzero(~long[:-step] & (tokens[step:] == tokens[:-step])) if len(tokens) > step else np.zeros(0, np.int64)
            i = i[np.minimum(n[i], n[i + step]) * 100 >= percent * np.maximum(n[i], n[i + step])]
            i = i[np.minimum(n[i] - pos[i], n[i + step] - pos[i + step]) * (100 + percent) >= percent * (n[i] + n[i + step])]
            found.append(np.stack([groups[i], groups[i + step]], 1))
        both = np.unique(np.concatenate(found), axis=0)
        keep = np.flatnonzero(long)
        return pa.concat_tables([_index_rows(0, both[:, 0], both[:, 1], *[np.zeros(len(both))] * 3), _index_rows(1, tokens[keep].view(np.int64), groups[keep], n[keep], pos[keep], rare[keep])])

    packed = map_arrow(docs.select(F.col("text").cast("string")), post, "bucket int, a binary, b binary, c binary, d binary")
    return apply_arrow(packed.groupBy("bucket"), pairs, "kind int, x long, y long, n long, pos long, rare long")


def _index_rows(kind: int, x: np.ndarray, y: np.ndarray, *more: np.ndarray) -> pa.Table:
    return pa.table({"kind": pa.array(np.full(len(x), kind), pa.int32()), "x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64()), **{c: pa.array(np.asarray(m).astype(np.int64), pa.int64()) for c, m in zip(("n", "pos", "rare"), more)}})


def verify(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b of nodes, a < b), those whose whole sets pass; the sets are made again from the texts."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    slot = F.shiftrightunsigned("node", 64 - SLOT_BITS)
    maps = nodes.groupBy(F.bitmap_bucket_number(slot).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    wanted = np.zeros(1 << SLOT_BITS, bool)  # 16 MB for any corpus; what it lets through besides is joined away
    for r in maps.collect():
        set_ = np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little"))
        at = (r["at"] - 1) * 32768 + 1 + set_ if r["at"] > 0 else -set_
        wanted[at[(at >= 0) & (at < len(wanted))]] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        held: list[tuple[int, bytes]] = []
        size = 0
        for node, tokens in _new_sets(batches, width):
            at = (node & (2**64 - 1)) >> (64 - SLOT_BITS)
            if bits[at >> 3] >> (7 - (at & 7)) & 1:
                held.append((node, tokens.tobytes()))
                size += len(held[-1][1])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary())], ["node", "tokens"])
                    held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary())], ["node", "tokens"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                short, other = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(other, short)
                common = int((other[np.minimum(at, len(other) - 1)] == short).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    found = map_arrow(docs.select(F.col("text").cast("string")), fetch, "node long, tokens binary").join(nodes, "node", "left_semi").dropDuplicates(["node"])
    found = materialize(found, "sets")
    both = pairs.join(found.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(found.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    return map_arrow(both.select("a", "b", "x", "y"), compare, "a long, b long")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def links(docs: DataFrame, shingles: int, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(edges, node components): verified links a, b that span each component, and node, component."""
    buckets = max(16, -(-shingles // BUCKET))
    found = materialize(index(docs, levels(docs, buckets, width), buckets, width, percent), "index")
    member = found.filter("kind = 2").select(F.col("x").alias("node"), F.col("y").alias("grp"), "n", "rare").dropDuplicates(["node"])
    hubs = member.groupBy("grp").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("members"))
    near = found.filter("kind = 0").select(F.col("x").alias("g"), F.col("y").alias("h")).distinct()
    posted = found.filter("kind = 1").select(F.col("x").alias("token"), F.col("y").alias("grp"), "pos", "rare").distinct()
    big = hubs.filter("members > 1")
    # First round: hubs of groups, members with their hub, groups of a long list with the list's hub.
    hub_of = lambda c: hubs.select(F.col("grp").alias(c), F.col("hub").alias(f"{c}_hub"), F.col("members").alias(f"{c}_n"))
    group_pairs = materialize(near.join(hub_of("g"), "g").join(hub_of("h"), "h"), "group-pairs")
    in_group = member.join(big, "grp").filter("node <> hub").select(*_ordered("node", "hub"))
    lists = materialize(posted.join(hubs, "grp").select("token", "grp", "hub", "members", "pos", "rare"), "lists")
    list_hub = lists.groupBy("token").agg(F.min(F.struct("rare", "hub"))["hub"].alias("list_hub"))
    in_list = lists.join(list_hub, "token").filter("hub <> list_hub").select(*_ordered("hub", "list_hub"))
    first = materialize(group_pairs.select(*_ordered("g_hub", "h_hub")).union(in_group).union(in_list).distinct(), "first-round")
    if first.isEmpty():
        return first, first.select(F.col("a").alias("node"), F.col("b").alias("component"))
    edges = materialize(verify(docs, first, width, percent), "links")
    parts = components(edges)
    # Second round: what shares a list or a group and isn't connected yet.
    whole = member.join(parts, "node", "left").select("node", "grp", "n", F.coalesce("component", "node").alias("component"))
    whole = materialize(whole.join(big.select("grp").union(group_pairs.filter("g_n > 1 or h_n > 1").select(F.explode(F.array("g", "h")).alias("grp"))).union(lists.select("grp")).distinct(), "grp", "left_semi"), "members")
    side = lambda s: whole.select(*(F.col(c).alias(f"{c}_{s}") for c in whole.columns))
    fits = (F.least("n_1", "n_2") * 100 >= percent * F.greatest("n_1", "n_2")) & (F.col("component_1") != F.col("component_2"))
    out = lambda df: df.select(*_ordered("node_1", "node_2"))
    split_groups = whole.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("grp")
    inside = whole.join(split_groups, "grp", "left_semi")
    rest = out(inside.select(*(F.col(c).alias(f"{c}_1") for c in inside.columns)).join(inside.select(*(F.col(c).alias(f"{c}_2") for c in inside.columns)), F.col("grp_1") == F.col("grp_2")).filter(fits & (F.col("node_1") < F.col("node_2"))))
    many = group_pairs.filter("g_n > 1 or h_n > 1").select("g", "h")
    rest = rest.union(out(many.join(side("1"), F.col("g") == F.col("grp_1")).join(side("2"), F.col("h") == F.col("grp_2")).filter(fits)))
    on_list = materialize(lists.select("token", "grp", "pos").join(whole, "grp"), "long-lists")
    split_lists = on_list.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token")
    on_list = on_list.join(split_lists, "token", "left_semi")
    a, b = (on_list.select("token", *(F.col(c).alias(f"{c}_{i}") for c in (*whole.columns, "pos"))) for i in (1, 2))
    # Whatever comes before the first shared shingle isn't shared: what is left must suffice.
    reach = F.least(F.col("n_1") - F.col("pos_1"), F.col("n_2") - F.col("pos_2")) * (100 + percent) >= (F.col("n_1") + F.col("n_2")) * percent
    rest = rest.union(out(a.join(b, "token").filter(fits & reach & (F.col("node_1") < F.col("node_2")))))
    second = materialize(rest.distinct().join(first, ["a", "b"], "left_anti"), "second-round")
    if not second.isEmpty():
        edges = materialize(edges.union(verify(docs, second, width, percent)), "links")
        parts = components(edges)
    return edges, parts


def _linked(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows as of ``rows_of``, one row per node: node, component, least, n; edges)."""
    rows = materialize(rows_of(docs, width), "rows")
    names = materialize(rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.max("n").alias("n")), "names")
    total = names.agg(F.sum("n")).first()[0] or 0
    edges, parts = links(docs, total, width, percent)
    return rows, names.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "least", "n"), edges


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links (spanning links of its set that were verified)."""
    rows, nodes, edges = _linked(docs, width, percent)
    smallest = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    info = nodes.join(smallest, "component").join(degree, "node", "left").select("node", "component_id", "n_links")
    out = rows.join(info, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def distinct(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, but of each group of linked documents only the one of smallest doc_id.

    Documents without words stay. Texts are shuffled only if more than ``BROADCAST_ROWS`` documents go.
    """
    rows, nodes, _ = _linked(docs, width, percent)
    keep = nodes.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("no_id"), "least", "node")).alias("keep"))
    decided = rows.join(nodes.select("node", "component").join(keep, "component").select("node", "keep.least", F.col("keep.node").alias("keep_node")), "node", "left")
    stays = F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("node") == F.col("keep_node")))
    decided = materialize(decided.select("doc_id", "node", stays.alias("stays")), "decisions")
    small = lambda df: F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
    # An id names its row unless it is null or repeated; rows of such ids are told apart by their sets.
    unclear = materialize(decided.groupBy(F.col("doc_id").alias("_d")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or _d is null").select("_d"), "unclear-ids")
    same = F.col("doc_id").eqNullSafe(F.col("_d"))
    gone = decided.filter("not stays").select(F.col("doc_id").alias("_d")).union(unclear).distinct()
    out = docs.join(small(gone), same, "left_anti")
    if unclear.isEmpty():
        return out
    at, schema = docs.columns.index("text"), f"_node long, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [set_hash(t) if len(t) else None for t in sets(batch.column(at), width)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *batch.columns], ["_node", *batch.schema.names])

    rest = map_arrow(docs.join(small(unclear), same, "left_semi"), add, schema)
    good = decided.filter("stays and node is not null").select(F.col("doc_id").alias("_d"), F.col("node").alias("_n")).distinct()
    picked = rest.join(good, same & (F.col("_node") == F.col("_n")), "left_semi")
    picked = picked.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "_node").orderBy("text"))).filter("_k = 1")
    return out.unionByName(picked.select(*docs.columns)).unionByName(rest.filter("_node is null").select(*docs.columns))
