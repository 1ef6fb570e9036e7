"""Operators 3 and 5: against the libraries whose results they must equal."""

import base64
import hashlib
import json
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandweave.llm import bpe, records
from strandweave.llm.common import ranges

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
TOKENS = bpe.read_ranks(RANKS)
CODEC = bpe.Codec(TOKENS)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})
LIBRARY = Tokenizer.from_file(WORDS)
WORD_CODEC = records.WordCodec(open(WORDS, "rb").read())
TEXT = st.text(st.one_of(st.sampled_from("abT 'sR\n\t09.,!_-éÉßŉſİıǅΣ中😀\x00\x1c\x85\xa0\xad́"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_codecs_equal_the_libraries(text):
    ids = TIKTOKEN.encode_ordinary(text)
    assert CODEC.encode(text) == struct.pack(f"<{len(ids)}I", *ids)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()
    assert WORD_CODEC.encode(text) == np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


def test_special_strings_and_long_runs():
    for text in ("<|endoftext|>", "a <|startoftext|> b", "z" * 100_000, "9" * 5000):
        assert WORD_CODEC.encode(text) == np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        ids = TIKTOKEN.encode_ordinary(text)
        assert CODEC.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_every_entry_is_its_own_piece():
    sample = TOKENS[::97]
    spell = dict(enumerate(bpe.byte_alphabet()))
    assert [CODEC.processor.encode(t.decode("latin-1").translate(spell)) for t in sample] == [[i] for i in range(0, len(TOKENS), 97)]


def test_documents_round_trip(odd_docs, no_docs):
    got = bpe.decode_documents(bpe.encode_documents(odd_docs, RANKS), RANKS).select("text", "ids", "decoded", "key").collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert bytes(r["decoded"]) == (r["text"] or "").encode() and r["key"] == "k"
        assert bytes(r["ids"]) == struct.pack(f"<{len(i := TIKTOKEN.encode_ordinary(r['text'] or ''))}I", *i)
    assert bpe.encode_documents(no_docs, RANKS).count() == 0


def test_records_read_back(spark, odd_docs, no_docs):
    path, index = records.encode_to_records(spark, odd_docs, WORDS)
    rows = records.read_records(index, path).collect()
    want = sorted(((r["doc_id"], r["text"] or "") for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    rows = sorted(rows, key=lambda r: r["start"])
    assert [r["key"] for r in rows] == [k for k, _ in want]
    start = 0
    for r in rows:
        assert r["start"] == start
        start += len(r["ids"]) // 4
    count = lambda pairs: sorted((k is not None, k or 0, zlib.crc32(b)) for k, b in pairs)
    assert count((r["key"], bytes(r["ids"])) for r in rows) == count((k, np.array([*LIBRARY.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for k, t in want)
    some = records.read_records(index.where("key in (3, 9)"), path).collect()
    assert sorted(r["key"] for r in some) == [3, 9]
    path, index = records.encode_to_records(spark, no_docs, WORDS)
    assert records.read_records(index, path).count() == 0


def test_other_tokenizer_files_go_to_the_library():
    with open(P.path("byte_bpe_50k.json"), "rb") as f:
        blob = f.read()
    codec, library = records.WordCodec(blob), Tokenizer.from_buffer(blob)
    assert WORD_CODEC.by_words and not codec.by_words
    for text in ("Don't Shout, 12 times", " two  blanks", "é<|endoftext|>"):
        assert codec.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    changed = json.loads(open(WORDS).read())
    changed["normalizer"] = None
    codec = records.WordCodec(json.dumps(changed).encode())
    library = Tokenizer.from_str(json.dumps(changed))
    assert codec.encode("Ab CD") == np.array(library.encode("Ab CD", add_special_tokens=False).ids, "<u2").tobytes() != WORD_CODEC.encode("Ab CD")


def test_damage_is_seen():
    record = records.frame(records.serialize(5, np.array([1, 70000], "<u4").tobytes(), 4))
    key, ids = records.deserialize(records.unframe(record))
    assert key == 5 and ids.tolist() == [1, 70000]
    for at in (0, 9, 15, len(record) - 1):
        bad = bytearray(record)
        bad[at] ^= 1
        with pytest.raises((ValueError, struct.error)):
            records.unframe(bytes(bad))


def test_ranges_are_sorted_and_joined():
    got = ranges([("b", 0, 5), ("a", 100, 10), ("a", 0, 50), ("a", 50, 50), ("a", 10**6, 1)], gap=0, most=200)
    assert got == [("a", 0, 110, [2, 3, 1]), ("a", 10**6, 10**6 + 1, [4]), ("b", 0, 5, [0])]


def test_vocabulary_file_is_read_in_rank_order():
    with open(RANKS, "rb") as f:
        first = base64.b64decode(f.readline().split()[0])
    assert TOKENS[0] == first and hashlib.md5(b"".join(TOKENS)).hexdigest()
