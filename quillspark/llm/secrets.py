"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Kinds, in this order: ``assign`` (a password, token or key given a value), ``access`` (access key ids),
``hex`` (long hexadecimal runs), ``token``: a run of key characters whose characters per token under a
public byte-level vocabulary are at most ``RATIO``; words and names compress to three or more characters
a token, random strings to about one and a half. Before that test, known digests and identifiers are
excluded: UUIDs, hexadecimal runs of a digest's length, plain numbers and dates, and hosts and paths of
URLs. A URL ends at white space, quotes, commas and brackets; its user part and the values of its query
are tested. Runs that overlap a pattern's span are not reported again.

Defined cases: a null text is empty; rows with equal or null doc_id are separate rows; an empty table
gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import map_arrow

VOCABULARY = "byte_bpe_50k.tiktoken"
RATIO, LENGTH = 2.2, 20
KINDS = ("assign", "access", "hex", "token")
# The patterns that the result's definition names.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LENGTH},}}")
_KNOWN = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128})|[0-9+/_=-]+")
# A URL up to its end; rest: from the end of its host or user part, query: from its question mark.
_URL = re.compile(r"""://[^\x20\x09-\x0D"'`,<>()\[\]{}/#@?]*(?P<rest>[/#@][^\x20\x09-\x0D"'`,<>()\[\]{}?]*)?(?P<query>\?)?[^\x20\x09-\x0D"'`,<>()\[\]{}]*""")
_USER = re.compile(r"""[^\x20\x09-\x0D"'`,<>()\[\]{}/?#@]*@""")
_encodings: dict[str, object] = {}


def encoding(path: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def scan(text: str, path: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span, in order; code points, end exclusive."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    # Runs, pattern spans and URLs all come in order: one pointer into each of the latter two.
    taken = iter(sorted((s, e) for s, _, e in found))
    urls = _URL.finditer(text)
    span, url = next(taken, None), next(urls, None)
    reach = 0
    for m in _RUN.finditer(text):
        a, b, run = m.start(), m.end(), m[0]
        while span and span[0] < b:
            reach = max(reach, span[1])
            span = next(taken, None)
        while url and url.end() < a:
            url = next(urls, None)
        if reach > a or _KNOWN.fullmatch(run):
            continue
        if url and url.start() < a:
            if -1 < url.start("query") < a:
                value = run.find("=") + 1
                if b - a - value >= LENGTH:
                    a, run = a + value, run[value:]
                if _KNOWN.fullmatch(run):
                    continue
            elif -1 < url.start("rest") < a or not _USER.match(text, b):
                continue
        if len(run) <= RATIO * len(encoding(path).encode_ordinary(run)):
            found.append((a, 3, b))
    return sorted(found)


def spans(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_token, base_sha256, spans."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    show = lambda found: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py() or "", path) for t in batch.column(1)]
            counts = [pa.array([sum(k == kind for _, k, _ in r) for r in rows], pa.int64()) for kind in range(4)]
            base = [hashlib.sha256(show(x for x in r if x[1] < 3).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(base, pa.string()), pa.array(map(show, rows), pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_assign long, n_access long, n_hex long, n_token long, base_sha256 string, spans string")
