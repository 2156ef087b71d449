import time
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import dac, tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**40)), max_size=1500))
def test_codes_round_trip_and_random_access(values):
    codes = dac.Codes(dac.encode(np.array(values, np.uint64)))
    assert codes.all().tolist() == values
    assert [codes[i] for i in range(0, len(values), 7)] == values[::7]


@settings(max_examples=80, deadline=None)
@given(st.text(st.one_of(st.characters(), st.sampled_from(" \n\t\x1ć 'sABΣ<|>")), max_size=60))
def test_encoder_equals_the_library_on_whole_texts(text):
    whole = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    got = np.frombuffer(tokens.encoder(public_tokenizers.path(tokens.TOKENIZER))(text), "<u4").tolist()
    assert got == whole.encode(text, add_special_tokens=False).ids


def test_special_strings_as_the_library_takes_them():
    whole, text = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER)), "a <|endoftext|>b <|startoftext|> c"
    got = np.frombuffer(tokens.encoder(public_tokenizers.path(tokens.TOKENIZER))(text), "<u4").tolist()
    assert got == whole.encode(text, add_special_tokens=False).ids


def test_store_against_brute_force(spark, odd_docs, tmp_path):
    whole = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    store = tokens.write(odd_docs, f"file://{tmp_path}/s", segment_ids=500)
    rows = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start, want, stream = 0, [], []
    for r in rows:
        ids = whole.encode(r.text or "", add_special_tokens=False).ids + [1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        stream += ids
    got = store.documents().orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    for at in (0, 17, len(stream) // 2, len(stream) - 1):
        assert store.token_at(at) == stream[at]
    assert {(r.doc_id, len(r.token_ids)) for r in store.token_ids().collect()} == {(w[0], w[2]) for w in want}


def test_empty_table(spark, no_docs, tmp_path):
    assert tokens.write(no_docs, f"file://{tmp_path}/s").documents().count() == 0


def test_pieces_that_collide_under_polynomial_hashes(spark, tmp_path):
    pieces = ["".join("ab"[(bin(i).count("1") + k) % 2] for i in range(1024)) for k in (0, 1)]
    whole = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    got = tokens.write(spark.createDataFrame(list(enumerate(pieces)), "doc_id long, text string"), f"file://{tmp_path}/s").token_ids().collect()
    assert {r.doc_id: list(r.token_ids) for r in got} == {i: [*whole.encode(p, add_special_tokens=False).ids, 1] for i, p in enumerate(pieces)}


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens.textvec, "word_hashes", lambda data, starts, sizes: np.arange(len(starts), dtype=np.uint64) % 3)
    path = public_tokenizers.path(tokens.TOKENIZER)
    encode, whole = tokens.WordEncoder(path), Tokenizer.from_file(path)
    for text in ("one two three four five", "two five one six", "six six three one seven two"):
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab\0é中\U0001f600"), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=12), min_size=1, max_size=30))
def test_hashes_tell_words_apart(words):
    raw = [w.encode() for w in words]
    sizes = np.array([len(w) for w in raw])
    got = tokens.textvec.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert len(set(zip(got.tolist(), raw))) == len(set(raw)) == len(set(got.tolist()))


def test_siphash_as_published():
    data = np.arange(64, dtype=np.uint8)
    each = np.ndarray((57,), "<u8", data.data, 0, (1,))
    got = tokens.textvec.siphash(each, np.array([0, 0, 0, 0]), np.array([15, 0, 8, 7]))
    assert [hex(int(g)) for g in got] == ["0xa129ca6149be45e5", "0x726fdb47dd0e0e31", "0x93f5f5799a932462", "0xab0200f58b01d137"]


def test_a_few_new_pieces_cost_little_beside_many_held():
    rng = np.random.Generator(np.random.PCG64(4))
    keys = np.unique(rng.integers(0, 1 << 64, 400_000, dtype=np.uint64))
    one = lambda k: (k, np.ones(len(k), np.int64), np.arange(len(k), dtype="<u4"), np.ones(len(k), np.int64), np.zeros(len(k), np.uint8))
    pieces = tokens.Pieces()
    pieces.add(*one(keys))
    more = np.concatenate([keys[:50], keys[:50] + np.uint64(1), [np.uint64(0), np.uint64(2**64 - 1)] * 2])
    began = time.perf_counter()
    np.isin(more, keys)
    whole = time.perf_counter() - began
    began = time.perf_counter()
    pieces.add(*one(more))
    assert time.perf_counter() - began < whole / 2
    assert pieces.keys.tolist() == sorted({*keys.tolist(), *more.tolist()})
