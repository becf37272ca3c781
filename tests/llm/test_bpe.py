"""Byte-level BPE against the tiktoken library."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import tiktoken

from stationlake.llm import bpe
from tests.llm.conftest import make_docs

CONTENT = open(public_tokenizers.path(bpe.VOCABULARY), "rb").read()
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(CONTENT), special_tokens={}
)
NASTY = [
    "", " ", "a", "don't they'll I'VE", "  two  spaces\n\n\tand tab ", "naïve Größe œuvre 漢字 ไทย 🙂🙂", "x" * 3000,
    "<|endoftext|> is text", "\x1c\x1d\x85\xa0 odd spaces", "12 345,678.90", "é" * 50 + "1" * 50,
]


def test_encoder_equals_library():
    codec = bpe.Codec(CONTENT, public_tokenizers.PATTERN)
    chance = random.Random(3)
    made = ["".join(chance.choice("aeé ñb\n1!üsœ漢'’") for _ in range(n)) for n in range(1, 60)]
    latin = ["".join(chance.choice([chr(c) for c in range(1, 256)]) for _ in range(40)) for _ in range(200)]
    for text in NASTY + made + latin:
        ids = codec.encode(text)
        assert ids == LIBRARY.encode_ordinary(text)
        assert codec.decode(ids).decode() == text


def test_columns(corpus):
    docs = make_docs(corpus, [*NASTY, None]).selectExpr("*", "'x' as token_ids", "1 as n_tokens")
    coded = bpe.decode(bpe.encode(docs))
    for row in coded.collect():
        text = row.text or ""
        assert list(row.token_ids) == LIBRARY.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()
        assert row.n_tokens == 1
    digests = {r.doc_id: r for r in bpe.round_trip_digests(docs).collect()}
    ids = ",".join(map(str, LIBRARY.encode_ordinary(NASTY[5])))
    assert digests[5].ids_sha256 == hashlib.sha256(ids.encode()).hexdigest()
    missing = corpus.createDataFrame([(None,)], "token_ids array<int>")
    assert bpe.decode(missing).first().decoded is None


def test_packed_ids_through_full_memos_and_sliced_lists(corpus, monkeypatch):
    import pyarrow as pa
    import pytest

    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    codec = bpe.Codec(CONTENT, public_tokenizers.PATTERN)
    text = " ".join(f"wörd{n % 11}x{n % 5}" for n in range(300)) + "y" * 200
    assert codec.encode(text) == LIBRARY.encode_ordinary(text) and len(codec.memo) <= 3
    made = {}
    monkeypatch.setattr(bpe, "add_columns", lambda frame, inputs, fields, compute: made.update(run=compute))
    bpe.decode(corpus.range(1))
    words = ["", "one two", None, "漢字 é", "three", ""]
    lists = pa.array([None if w is None else LIBRARY.encode_ordinary(w) for w in words], pa.list_(pa.int32()))
    for start, size in ((0, 6), (1, 3), (2, 1), (4, 2), (5, 1)):
        found = made["run"](lists.slice(start, size))[0].to_pylist()
        assert found == [None if w is None else w.encode() for w in words[start : start + size]]
    for bad in (1 << 30, -1):
        with pytest.raises((KeyError, IndexError)):
            made["run"](pa.array([[bad]], pa.list_(pa.int32())))
