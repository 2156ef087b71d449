import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import align

A, B = public_tokenizers.path(align.A_NAME), public_tokenizers.path(align.B_NAME)
TEXT = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t\r\x0b\x0c\x1c\x85\xa0 　▁'sléñ中.;(\")0123")), max_size=60)


def brute(rows):
    """Whole texts through both libraries, as they come."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    docs, held = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            docs.append((doc_id, [], [], [], ""))
            continue
        place = lambda raw: [(sum(map(len, raw[:i])), sum(map(len, raw[: i + 1]))) for i in range(len(raw))]
        at_a, at_b = place(raw_a), place(raw_b)
        links = [(x, y) for x, (s, e) in zip(ids_a, at_a) for y, (t, f) in zip(ids_b, at_b) if s < f and t < e]
        ends = sorted({e for _, e in at_a} & {e for _, e in at_b})
        cut = lambda ids, at, lo, hi: ",".join(str(i) for i, (s, e) in zip(ids, at) if lo < e <= hi)
        groups = ";".join(f"{cut(ids_a, at_a, lo, hi)}|{cut(ids_b, at_b, lo, hi)}" for lo, hi in zip([0, *ends], ends))
        docs.append((doc_id, ids_a, ids_b, links, groups))
        held.update(set(links))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return [(d, len(x), len(y), g.count(";") + bool(g), len(k), sum(held[p] == top[p[0]] for p in k), sum(held[p] for p in k), hashlib.sha256(g.encode()).hexdigest() if g else "") for d, x, y, k, g in docs]


def test_what_no_token_holds_after_other_characters():
    assert align.breaks([" a", "\n\n", "b", " \t"]) == align._BLANKS
    assert align.breaks([" a", "{\n", ";\r", "a\x0b"]) == " \t\x0c"
    assert " " in align.aligner(A, B).breaks and "\r" not in align.aligner(A, B).breaks


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_tokens_of_segments_are_those_of_the_text(text):
    own = align.aligner(A, B)
    segments, bounds = align.split(pa.array([text]), own.breaks)
    parts = [s.decode() for s in segments.to_pylist()]
    assert "".join(parts) == (f" {text}" if text else "") and bounds.tolist() == [0, len(parts)]
    if not text:
        return
    whole, ids = own.encode([" " + text]), own.encode(parts)
    assert sum(ids[0], []) == whole[0][0] and sum(ids[1], []) == whole[1][0]
    assert whole[1][0] == sentencepiece.SentencePieceProcessor(model_file=B).encode(text)


@pytest.mark.parametrize("block_bytes", [align.BLOCK_BYTES, 300])
def test_against_brute_force(spark, odd_docs, monkeypatch, block_bytes):
    if block_bytes == 300:
        monkeypatch.setattr(align, "SALTED", 8)
    odd = ["a▁b c", "<|endoftext|> and <s> or </s>", "x\r\n\r\n  y;\r\n", "tab\tthen  two   three   nbsp　  wide", "naïve café — “quotes”  …  done", "▁", " ", "  lead and trail  ", "don't 12345 3.14 日本語 テスト 😀😀 \x00 \x1c end", "z" * 3000]
    more = spark.createDataFrame([(500 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").filter("length(text) < 5000 or text is null").union(more).repartition(3)
    own = align.Alignment(docs, block_bytes=block_bytes, bucket_segments=20)
    got = sorted((tuple(r) for r in own.documents().collect()), key=repr)
    assert got == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=repr)
    if block_bytes == 300:
        whole = {r.doc_id: r.groups for r in own.documents(whole=True).collect()}
        assert all(hashlib.sha256(whole[g[0]].encode()).hexdigest() == g[-1] for g in got if g[-1])
        assert own.blocks.count() > 50 and own.links.count() > own.counts.count() > 500


def test_empty_table(no_docs):
    assert align.Alignment(no_docs).documents().count() == 0
