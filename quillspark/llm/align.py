"""Cross-tokenizer alignment by deduplicated segments.

A text, with a space before it, is encoded by a byte-level BPE (A) and a piece BPE (B). Where tokens of both
end at one byte, they are cut into groups; tokens whose bytes overlap are linked.

1. ``breaks``: the white-space characters before which neither vocabulary can merge, found by looking through
   all tokens of both: none may hold such a character right after one that isn't white space. Every text is
   split there, so a segment's tokens are those that the whole text has at its place.
2. Documents are read into blocks of about ``BLOCK_BYTES``: the distinct segments of a block, told apart by
   their bytes, and a code for every place. Blocks are written; the texts are not needed again.
3. Distinct segments of all blocks meet in buckets by their hash. Each is tokenised and aligned once, all of a
   bucket at a time: where a token of either side ends there is one link, and where both end, a group. The
   alignments go back to the blocks that hold the segment and are written. Segments and alignments travel as
   packed arrays, a row for each block and bucket.
4. Blocks count each pair of ids once a document; the sums are the corpus's counts. Of a pair's A id the highest
   count is found in a table with a row an id, at most the vocabulary's size, which is broadcast.
5. The counts are joined back to the blocks that hold the pair, and documents are composed.

A segment or pair has a row, or a place in one, for each block that holds it, not for each place in a text, so
even the commonest word is no hot key; from ``SALTED`` blocks up, blocks are parted in sets that size, and a
segment is aligned once a set. A block's documents are whole; a text longer than a block is a block of its own.

Defined cases: null and empty texts, and texts whose tokens don't give back their bytes (B reads U+2581 as a
space) have no tokens: zeros and ''. Such texts add nothing to the counts. A null doc_id stays null; rows with
equal doc_id each have a row and each count; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textvec
from quillspark.llm.common import map_arrow, materialize, tidy

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text a block, about; segments of blocks that one bucket takes, about; blocks whose segments meet.
BLOCK_BYTES, BUCKET_SEGMENTS, SALTED = 8 << 20, 1 << 19, 1 << 16
_BLANKS = " \t\n\x0b\x0c\r"
_ASCII_BLANK = np.zeros(256, bool)
_ASCII_BLANK[[ord(c) for c in _BLANKS] + [0x1C, 0x1D, 0x1E, 0x1F]] = True
_loaded: dict[tuple[str, str], "Aligner"] = textvec.caches.setdefault("align", {})


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of runs of ``sizes`` that begin at ``starts``, one run after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Table:
    """Byte strings by number, as one buffer."""

    def __init__(self, items: list[bytes]):
        self.sizes = np.array([len(x) for x in items], np.int64)
        self.starts, self.data = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(items), np.uint8)

    def join(self, numbers: np.ndarray) -> np.ndarray:
        return self.data[_runs(self.starts[numbers], self.sizes[numbers])]


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the alignment of many segments at once."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocabulary = {i: bytes(byte_of.get(c, 0) for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        a_bytes = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
        spec = sentencepiece_model_pb2.ModelProto()
        with open(b_path, "rb") as f:
            spec.ParseFromString(f.read())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        b_bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace("▁", " ").encode() for p in spec.pieces]
        self.breaks = breaks([t.decode("utf-8", "replace") for t in a_bytes] + [b_bytes[i].decode() for i, p in enumerate(spec.pieces) if p.type not in (kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN)])
        self.tables = Table(a_bytes), Table(b_bytes)
        spec.normalizer_spec.add_dummy_prefix = False  # a segment begins with its own white space
        self.b = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)], self.b.encode(texts, num_threads=1)

    def align(self, segments: list[bytes]) -> dict[str, np.ndarray]:
        """Per segment ok (whether both sides give back its bytes) and n_a, n_b, n_links, all 0 if not; and of all segments one after the other
        the ids a and b and, for each link, ends: 1 where its token of A ends with it, 2 where that of B does."""
        sides = self.encode([s.decode() for s in segments])
        want = np.array([len(s) for s in segments], np.int64)
        ok = np.ones(len(segments), bool)
        raw = np.frombuffer(b"".join(segments), np.uint8)
        ids, counts = [], []
        for lists, table in zip(sides, self.tables):
            n = np.array([len(x) for x in lists], np.int64)
            flat = np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum()))
            owner = np.repeat(np.arange(len(segments)), n)
            ok &= np.bincount(owner, table.sizes[flat], len(segments)).astype(np.int64) == want
            ids.append(flat)
            counts.append(n)
        owners = [np.repeat(np.arange(len(segments)), n) for n in counts]
        for flat, owner, table in zip(ids, owners, self.tables):  # those of the right length: byte by byte
            same = table.join(flat[ok[owner]]) == raw[np.repeat(ok, want)]
            ok[np.repeat(np.arange(len(segments))[ok], want[ok])[~same]] = False
        ids = [flat[ok[owner]] for flat, owner in zip(ids, owners)]
        counts = [np.where(ok, n, 0) for n in counts]
        # With all good segments as one stretch of bytes: a link for each stretch that no token's end cuts.
        ends = [np.cumsum(table.sizes[flat]) for flat, table in zip(ids, self.tables)]
        cuts = np.union1d(*ends)
        n_links = np.diff(np.searchsorted(cuts, np.concatenate([[0], np.cumsum(np.where(ok, want, 0))]), "right"))
        marks = np.isin(cuts, ends[0]).astype(np.uint8) | np.isin(cuts, ends[1]).astype(np.uint8) << 1
        return {"ok": ok, "n_a": counts[0], "n_b": counts[1], "n_links": n_links, "a": ids[0], "b": ids[1], "ends": marks}


def breaks(tokens: list[str]) -> str:
    """Of ASCII white space, the characters that no token has right after one that isn't white space."""
    held = {c for t in tokens for c in re.findall(rf"\S([{_BLANKS}])", t)}
    return "".join(c for c in _BLANKS if c not in held)


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Aligner(a_path, b_path)
    return _loaded[a_path, b_path]


def _after_blank(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place ``at`` is white space, in any script."""
    b = [data[np.maximum(at - k, 0)] for k in (1, 2, 3)]
    two = (b[1] == 0xC2) & ((b[0] == 0x85) | (b[0] == 0xA0))
    general = (b[2] == 0xE2) & ((b[1] == 0x80) & ((b[0] <= 0x8F) | (b[0] >= 0xA8) & (b[0] <= 0xAF)) | (b[1] == 0x81) & (b[0] >= 0x9F) & (b[0] <= 0xA0))
    others = (b[2] == 0xE1) & (b[1] == 0x9A) & (b[0] == 0x80) | (b[2] == 0xE1) & (b[1] == 0xA0) & (b[0] == 0x8E) | (b[2] == 0xE3) & (b[1] == 0x80) & (b[0] == 0x80) | (b[2] == 0xEF) & (b[1] == 0xBB) & (b[0] == 0xBF)
    return _ASCII_BLANK[b[0]] | (b[0] >= 0x80) & (two | general | others)


def split(texts: pa.Array, at_blanks: str) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """(segments of all texts, each text after a space; bounds of each text in them); none for null and empty texts."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    size = np.where(size > 0, size + 1, 0)
    ends = np.cumsum(size)
    starts = (ends - size)[size > 0]
    data = np.empty(int(ends[-1]) if n else 0, np.uint8)
    own = np.ones(len(data), bool)
    own[starts] = False
    data[starts], data[own] = 32, raw
    broken = np.zeros(256, bool)
    broken[[ord(c) for c in at_blanks]] = True
    at = np.flatnonzero(broken[data])
    cut = np.zeros(len(data) + 1, bool)
    cut[at[~_after_blank(data, at)]] = True
    cut[starts] = cut[-1] = True
    edges = np.flatnonzero(cut) if len(data) else np.zeros(1, np.int64)
    segments = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
    return segments, np.searchsorted(edges, np.concatenate([[0], ends]))


def _planes(codes: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, which compress better."""
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


_BLOCKS = "block long, doc_ids array<long>, bounds array<int>, codes binary, n long, segments array<binary>"


def blocks(docs: DataFrame, at_blanks: str, block_bytes: int) -> DataFrame:
    """A row per block: its documents' ids and bounds in ``codes`` (packed), and the segment of each code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, size = TaskContext.get().partitionId(), 0, 0
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            nonlocal k, size
            table = pa.Table.from_batches(held)
            segments, bounds = split(table.column(1), at_blanks)
            coded = segments.dictionary_encode()
            row = [part << 32 | k, table.column(0).to_pylist(), bounds, _planes(coded.indices.to_numpy()), len(coded.dictionary), coded.dictionary.cast(pa.binary()).to_pylist()]
            k, size = k + 1, 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.list_(pa.int64())), pa.array([row[2]], pa.list_(pa.int32())), pa.array([row[3]], pa.binary()), pa.array([row[4]], pa.int64()), pa.array([row[5]], pa.list_(pa.binary()))], ["block", "doc_ids", "bounds", "codes", "n", "segments"])

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            since = 0
            for i, length in enumerate(lengths.tolist()):
                if size and size + length > block_bytes:
                    held.append(batch.slice(since, i - since))
                    yield out()
                    since = i
                size += length
            held.append(batch.slice(since))
        if held:
            yield out()

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, _BLOCKS, "align")


def bucketed(held: DataFrame, buckets: int, sets: int) -> DataFrame:
    """bucket, part, block, codes, sizes, data: the segments of each block (block, segments) packed by the hash of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                segments = own.values
                if not len(segments):
                    continue
                by = np.array([zlib.crc32(x) for x in segments.to_pylist()], np.int64) % buckets
                order = np.argsort(by, kind="stable")
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(by[order]) != 0, [True]]))
                packed = [_packed(segments.take(pa.array(order[x:y]))) for x, y in zip(cuts, cuts[1:])]
                codes = [_planes(np.diff(order[x:y], prepend=0)) for x, y in zip(cuts, cuts[1:])]
                k = len(packed)
                yield pa.RecordBatch.from_arrays([pa.array(by[order[cuts[:-1]]].astype(np.int32)), pa.array(np.full(k, block * 0x9E3779B1 % sets, np.int32)), pa.array(np.full(k, block, np.int64)), pa.array(codes, pa.binary()), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], ["bucket", "part", "block", "codes", "sizes", "data"])

    return map_arrow(held, run, "bucket int, part int, block long, codes binary, sizes binary, data binary", "align")


def _packed(strings: pa.Array) -> tuple[bytes, bytes]:
    """(sizes, bytes) of byte strings."""
    strings = strings.cast(pa.large_binary())
    offsets = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, 8 * strings.offset)
    data = strings.buffers()[2]
    return _planes(np.diff(offsets)), b"" if data is None else memoryview(data)[offsets[0] : offsets[-1]].tobytes()


#: What a block knows of its segments, packed: ascending codes as differences; per code ok, n_a, n_b, n_links; of all of them
#: a and b, and the bits of ends.
_ALIGNED = "block long, codes binary, ok binary, n_a binary, n_b binary, n_links binary, a binary, b binary, ends binary"


def _bits(ends: np.ndarray) -> bytes:
    return np.packbits(np.concatenate([ends & 1, ends >> 1])).tobytes()


def _ends(bits: bytes, n: int) -> np.ndarray:
    both = np.unpackbits(np.frombuffer(bits, np.uint8), count=2 * n)
    return both[:n] | both[n:] << 1


def _aligned_bucket(a_path: str, b_path: str):
    def run(table: pa.Table) -> pa.Table:
        textvec.only("align")
        sizes = [_numbers(x) for x in table["sizes"].to_pylist()]
        each = np.concatenate(sizes)
        offsets = np.concatenate([[0], np.cumsum(each)]).astype(np.int64)
        segments = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(each), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(table["data"].to_pylist()))])
        coded = segments.dictionary_encode()  # each distinct segment once
        found = aligner(a_path, b_path).align(coded.dictionary.to_pylist())
        of, at = coded.indices.to_numpy().astype(np.int64), np.cumsum([0, *map(len, sizes)])
        first = {c: np.cumsum(found[n]) - found[n] for c, n in (("a", "n_a"), ("b", "n_b"), ("ends", "n_links"))}
        out = {"block": table["block"], "codes": table["codes"]}
        rows = [of[x:y] for x, y in zip(at, at[1:])]
        out["ok"] = pa.array([np.packbits(found["ok"][r]).tobytes() for r in rows], pa.binary())
        for c in ("n_a", "n_b", "n_links"):
            out[c] = pa.array([_planes(found[c][r]) for r in rows], pa.binary())
        for c, n, pack in (("a", "n_a", _planes), ("b", "n_b", _planes), ("ends", "n_links", _bits)):
            out[c] = pa.array([pack(found[c][_runs(first[c][r], found[n][r])]) for r in rows], pa.binary())
        textvec.trim()
        return pa.table(out)

    return run


class _Block:
    """A block's documents, and the alignments of its segments in order of code."""

    def __init__(self, rows: pa.Table):
        whole, parts = rows.filter(pc.is_valid(rows["doc_ids"])).to_pylist()[0], rows.filter(pc.is_null(rows["doc_ids"]))
        self.doc_ids, self.bounds, self.places = whole["doc_ids"], np.array(whole["bounds"], np.int64), _numbers(whole["places"])
        self.doc = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        parts = [{c: parts[c][i].as_py() for c in parts.column_names} for i in range(len(parts))]
        per_code = [np.stack([np.cumsum(_numbers(r["codes"])), *(_numbers(r[c]) for c in ("n_a", "n_b", "n_links"))]) for r in parts]
        ok = [np.unpackbits(np.frombuffer(r["ok"], np.uint8), count=x.shape[1]) for r, x in zip(parts, per_code)]
        flat = [[_numbers(r["a"]), _numbers(r["b"]), _ends(r["ends"], int(x[3].sum()))] for r, x in zip(parts, per_code)]
        none = np.zeros(0, np.int64)
        codes, n_a, n_b, n_links = np.concatenate(per_code, 1) if parts else (none,) * 4
        a, b, ends = (np.concatenate([f[i] for f in flat]).astype(np.int64) if parts else none for i in range(3))
        order = np.argsort(codes)
        own = lambda values, n: values[_runs((np.cumsum(n) - n)[order], n[order])]
        self.a, self.b, self.ends = own(a, n_a), own(b, n_b), own(ends, n_links)
        self.ok, self.n_a, self.n_b, self.n_links = (np.concatenate(ok) if parts else none)[order], n_a[order], n_b[order], n_links[order]
        #: Of each link the code, and the places of its tokens in a and b.
        self.code = np.repeat(np.arange(len(order)), self.n_links)
        ends_a, ends_b = self.ends & 1, self.ends >> 1
        self.at_a, self.at_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        self.links = self.a[self.at_a] << 32 | self.b[self.at_b]
        good = np.ones(len(self.bounds) - 1, bool)
        good[self.doc[self.ok[self.places] == 0]] = False
        #: Documents with tokens.
        self.good = good & (np.diff(self.bounds) > 0)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(links, in how many documents each is)."""
        kinds, link = np.unique(self.links, return_inverse=True)
        codes, k = max(1, len(self.n_links)), max(1, len(kinds))
        once = np.unique((self.doc * codes + self.places)[self.good[self.doc]])  # each segment once a document
        doc, code = np.divmod(once, codes)
        n = self.n_links[code]
        pairs = np.unique(np.repeat(doc, n) * k + link[_runs((np.cumsum(self.n_links) - self.n_links)[code], n)]) % k
        total = np.bincount(pairs, minlength=len(kinds))
        return kinds[total > 0], total[total > 0]

    def per_document(self, per_code: np.ndarray) -> np.ndarray:
        before = np.concatenate([[0], np.cumsum(per_code[self.places])]).astype(np.int64)
        return np.where(self.good, before[self.bounds[1:]] - before[self.bounds[:-1]], 0)

    def groups(self) -> list[bytes]:
        """Of each code its groups as text, each with a semicolon behind."""
        both = self.ends == 3
        group = np.cumsum(both) - both
        of_a, of_b = group[self.ends & 1 == 1], group[self.ends >> 1 == 1]  # of each token
        n = int(both.sum())
        each_a, each_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
        start = np.cumsum(each_a + each_b) - each_a - each_b
        rank = lambda of, each: np.arange(len(of)) - (np.cumsum(each) - each)[of]
        number, code = np.empty(len(of_a) + len(of_b), np.int64), np.empty(len(of_a) + len(of_b), np.int64)
        last = lambda of: np.concatenate([np.diff(of) != 0, np.ones(min(1, len(of)), bool)])
        written = _decimals(int(max(self.a.max(initial=0), self.b.max(initial=0))))
        kinds = len(written.sizes) // 3
        for ids, of, at, end, own in ((self.a, of_a, start[of_a] + rank(of_a, each_a), 1, self.n_a), (self.b, of_b, start[of_b] + each_a[of_b] + rank(of_b, each_b), 2, self.n_b)):
            number[at] = np.where(last(of), end, 0) * kinds + ids
            code[at] = np.repeat(np.arange(len(own)), own)
        size = np.bincount(code, written.sizes[number], len(self.n_a)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(written.join(number))]).to_pylist()


def _decimals(most: int) -> Table:
    """Numbers up to ``most`` at least, with a comma, then with a bar, then with a semicolon behind."""
    table = textvec.caches.setdefault("align", {}).get("decimals")
    if table is None or len(table.sizes) // 3 <= most:
        table = textvec.caches["align"]["decimals"] = Table([b"%d%c" % (i, c) for c in b",|;" for i in range(1 << most.bit_length())])
    return table


class Alignment:
    """The alignment of ``docs`` (doc_id, text): ``counts`` of linked ids, and ``documents``."""

    def __init__(self, docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block_bytes: int = BLOCK_BYTES, bucket_segments: int = BUCKET_SEGMENTS):
        a_path, b_path = a_path or public_tokenizers.path(A_NAME), b_path or public_tokenizers.path(B_NAME)
        self.blocks = materialize(blocks(docs, aligner(a_path, b_path).breaks, block_bytes), "blocks")
        n = self.blocks.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("segments")).first()
        packed = bucketed(self.blocks.select("block", "segments"), max(64, -(-n.segments // bucket_segments)), -(-n.blocks // SALTED) or 1)
        #: A row for each block and bucket of segments: their alignments, packed as _ALIGNED says.
        self.aligned = materialize(packed.groupBy("bucket", "part").applyInArrow(_aligned_bucket(a_path, b_path), _ALIGNED), "alignments")
        #: block, link (a << 32 | b), own: in how many documents of the block a is linked with b.
        self.links = materialize(self._each(_counted, "block long, link long, own long"), "links")
        tidy(docs.sparkSession, True)  # what was shuffled to count goes before the same is shuffled to compose
        found = materialize(self.links.groupBy("link").agg(F.sum("own").alias("n")), "link-counts")
        found = found.select("link", F.shiftright("link", 32).alias("a"), F.col("link").bitwiseAND(2**32 - 1).alias("b"), "n")
        best = found.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A
        #: link, a, b, n: in how many documents a is linked with b; best: whether no partner of a has more.
        self.counts = found.join(F.broadcast(best), "a").select("link", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))

    def _rows(self) -> DataFrame:
        """The rows of each block: one of its documents, and its alignments."""
        return self.blocks.select("block", "doc_ids", "bounds", F.col("codes").alias("places")).unionByName(self.aligned, allowMissingColumns=True)

    def _each(self, run, schema: str) -> DataFrame:
        return self._rows().groupBy("block").applyInArrow(run, schema)

    def documents(self, whole: bool = False) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, or with ``whole`` the groups themselves."""
        columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
        name = "groups" if whole else "groups_sha256"

        def compose(rows: pa.Table, known: pa.Table) -> pa.Table:
            textvec.only("align")
            own = _Block(rows)
            link, n, best = (known[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("link", "n", "best"))
            order = np.argsort(link)
            at = order[np.minimum(np.searchsorted(link, own.links, sorter=order), len(link) - 1)] if len(link) else np.zeros(len(own.links), np.int64)
            held = link[at] == own.links if len(link) else np.zeros(len(own.links), bool)  # a link of texts without tokens only has no count
            n, best = (np.where(held, v[at] if len(link) else 0, 0) for v in (n, best))
            of = lambda values: np.bincount(own.code, values, len(own.n_a)).astype(np.int64)
            per_code = (own.n_a, own.n_b, of(own.ends == 3), own.n_links, of(best), _sums(own.code, n, len(own.n_a)))
            table = {"doc_id": pa.array(own.doc_ids, pa.int64())} | {c: pa.array(own.per_document(v)) for c, v in zip(columns, per_code)}
            groups, text = own.groups(), []
            for good, a, b in zip(own.good.tolist(), own.bounds[:-1].tolist(), own.bounds[1:].tolist()):
                joined = b"".join([groups[c] for c in own.places[a:b].tolist()])[:-1] if good else b""
                text.append(joined.decode() if whole or not good else hashlib.sha256(joined).hexdigest())
            textvec.trim()
            return pa.table({**table, name: pa.array(text, pa.string())})

        known = self.links.select("block", "link").join(self.counts.select("link", "n", "best"), "link").select(F.col("block").alias("of"), "link", "n", "best")
        return self._rows().groupBy("block").cogroup(known.groupBy("of")).applyInArrow(compose, f"doc_id long, {', '.join(f'{c} long' for c in columns)}, {name} string")


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by ``at``, exact."""
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values)
    return out


def _counted(rows: pa.Table) -> pa.Table:
    textvec.only("align")
    link, n = _Block(rows).counts()
    textvec.trim()
    return pa.table({"block": pa.array(np.full(len(link), rows["block"][0].as_py()), pa.int64()), "link": pa.array(link), "own": pa.array(n, pa.int64())})
